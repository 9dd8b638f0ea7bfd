"""Corpora as DataFrames: files(path, dir, name, ext, body, n_bytes) and lines(path, ext, line_no, line)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("rs", "swift", "ts", "tsx", "js", "jsx", "py", "kt", "kts", "md")
# Extension and language.
LANGUAGES = {"rs": "rust", "swift": "swift", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "py": "python", "kt": "kotlin", "kts": "kotlin"}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share: spark.checkpoint.dir, or the warehouse where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stages"
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table seen as a tree of files: a source is a directory, the extension follows from doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ext = F.get(F.array(*map(F.lit, EXTENSIONS)), F.pmod("doc_id", F.lit(len(EXTENSIONS))).cast("int"))
    named = docs.select("doc_id", F.col("source").alias("dir"), ext.alias("ext"), F.col("text").alias("body"))
    name = F.concat_ws(".", F.col("doc_id").cast("string"), "ext")
    return named.select("doc_id", F.concat_ws("/", "dir", name).alias("path"), "dir", name.alias("name"), "ext", "body", F.octet_length("body").cast("long").alias("n_bytes"))


IGNORE_FILES = (".gitignore", ".ignore")


def ignore_rule(line: str, folder: str) -> tuple[str, bool] | None:
    """A line of an ignore file in a folder (relative, "" for the root) as (pattern of paths, whether it ignores or keeps)."""
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    keeps = line.startswith("!")
    line = line[1:] if keeps else line.removeprefix("\\") if line[:2] in ("\\!", "\\#") else line
    folder_only = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    parts = re.split(r"(\*\*/|/\*\*$|\*|\?|\[!?[^\]]+\]|\\.)", line.lstrip("/"))
    meaning = {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}
    text = "".join(meaning.get(p) or (p.replace("[!", "[^") if p.startswith("[") and p.endswith("]") else re.escape(p.removeprefix("\\") if len(p) == 2 and p[0] == "\\" else p)) for p in parts if p)
    base = re.escape(folder + "/") if folder else ""
    return f"^{base}{'' if anchored else '(?:.*/)?'}{text}{'/.*' if folder_only else '(?:/.*)?'}$", not keeps


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that matches a path ignores it."""
    out = F.lit(False)
    for pattern, ignores in rules:
        out = F.when(F.rlike(path, F.lit(pattern)), F.lit(ignores)).otherwise(out)
    return out


def _ignore_rules(spark: SparkSession, root: str, depth: int) -> list[tuple[str, bool]]:
    """Rules of the tree's ignore files, those of deeper folders last. They are settings: few, and read on the driver.

    Spark's sources pass over names that begin with a dot, so the files are found and read through Hadoop, a level at once.
    """
    jvm, rules = spark._jvm, []
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = fs.resolvePath(base).toString().rstrip("/")
    for level in range(depth):
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{top}/{'*/' * level}" + "{" + ",".join(IGNORE_FILES) + "}")) or []
        for path in sorted(str(f.getPath().toString()) for f in found):
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(path))
            lines = bytes(stream.readAllBytes()).decode("utf-8", "replace").splitlines()
            stream.close()
            folder = path.removeprefix(top).strip("/").rpartition("/")[0]
            rules += [rule for line in lines if (rule := ignore_rule(line, folder))]
    return rules


def tree_files(spark: SparkSession, root: str, extensions: list[str] | None = None, max_bytes: int | None = None, ignore: bool = True) -> DataFrame:
    """A real tree of files. Hidden files and directories are skipped, and so is what ignore files name; bytes that are not
    UTF-8 make the body null. Spark's file sources also pass over names that begin with an underscore."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if max_bytes is not None:
        raw = raw.where(F.col("length") <= max_bytes)
    path = normalize_path(F.regexp_replace("path", "^file:/*", "/"), root)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    name = F.element_at(F.split(path, "/"), -1)
    raw = raw.where(~path.rlike(r"(^|/)\."))
    if ignore:
        depth = raw.agg(F.max(F.size(F.split(path, "/")))).first()[0] or 1
        raw = raw.where(~ignored(path, _ignore_rules(spark, root, depth)))
    files = raw.select(path.alias("path"), F.regexp_replace(path, "/?[^/]*$", "").alias("dir"), name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), text.alias("body"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"))
    return files.where(F.col("ext").isin(extensions)) if extensions else files


def tree_pages(files: DataFrame) -> DataFrame:
    """The pages of a tree as lines of their text: (url, line_no, line), the path as url."""
    return _page_lines(files.where(F.col("ext").isin("html", "htm", "xhtml")).select(F.col("path").alias("url"), F.col("body").alias("html")))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rich documents (pages) as lines of their text without tags: (url, line_no, line)."""
    return _page_lines(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _page_lines(pages: DataFrame) -> DataFrame:
    body = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", "\n"), "\n+", "\n")
    return pages.select("url", F.posexplode(split_lines(body)).alias("i", "line")).select("url", (F.col("i") + 1).cast("long").alias("line_no"), "line")


def normalize_path(path: Column, root: str) -> Column:
    """The path below root; a path outside root stays."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def split_lines(body: Column) -> Column:
    """Lines without their ends; a final empty piece is no line."""
    parts = F.split(body, "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(kept, lambda x: F.regexp_replace(x, "\r$", ""))


def lines_of(files: DataFrame, symbol: str | None = None) -> DataFrame:
    """Numbered lines; with a symbol only those of files that hold it, so the test reaches the scan."""
    if symbol is not None:
        files = files.where(F.contains("body", F.lit(symbol)))
    cut = files.select("path", "ext", F.posexplode(split_lines(F.col("body"))).alias("i", "line"))
    return cut.select("path", "ext", (F.col("i") + 1).cast("long").alias("line_no"), "line")


# What line number modulo 8 renders, for each language of the synthetic code view; {w}: the line's first word.
RENDER = {
    "rs": ("mod {w} {", "#[derive({w})]", "pub fn {w}(x: &str) -> T {", None, "}", "impl {w} {", "// {w}", ""),
    "swift": ("extension {w} {", "@MainActor", "func {w}(id: Int) async -> T {", None, "}", "public struct {w} {", "// {w}", ""),
    "tsx": ("export const {w}: React.FC<P> = (p) => (", "  <{w} prop={x} />", "export async function {w}(id: number): Promise<string> {", None, "}", "interface {w}<T> {", "const v = await {w}(1) satisfies T", ""),
}


def _rendered(line: Column, n: Column, render: dict) -> Column:
    w, out = F.regexp_extract(line, "[A-Za-z]+", 0), line
    for ext, forms in render.items():
        for i, form in enumerate(forms):
            if form is not None:
                text = F.concat(*(F.lit(p) if j % 2 == 0 else w for j, p in enumerate(_around(form)))) if "{w}" in form else F.lit(form)
                out = F.when((F.col("ext") == ext) & (F.pmod(n, F.lit(8)) == i), text).otherwise(out)
    return out


def code_files(files: DataFrame, render: dict = RENDER) -> DataFrame:
    """(path, ext, lines): rs, swift and tsx files with their lines rendered as code, since the prose holds none."""
    held = files.where(F.col("ext").isin(*render))
    return held.select("path", "ext", F.transform(split_lines(F.col("body")), lambda x, i: _rendered(x, i + 1, render)).alias("lines"))


def code_lines(files: DataFrame) -> DataFrame:
    """As code_files, a row for each line."""
    cut = code_files(files).select("path", "ext", F.posexplode("lines").alias("i", "line"))
    return cut.select("path", "ext", (F.col("i") + 1).cast("long").alias("line_no"), "line")


# As RENDER, with statements that go over several lines.
RENDER_BROKEN = {
    "rs": ("pub fn {w}(", "    x: &str, // (", "    {w}: u8,", ") -> T {", None, "}", "impl<T>", "Show for {w}<T> {"),
    "swift": ("  func {w}(", "    id: Int", "  ) async {", None, "}", "public struct {w}: Codable {", "  init(", "    {w}: Int) {"),
    "tsx": ("export const {w} = (", "  a: number,", ") => {", None, "}", "export {", "  {w},", "}"),
}


def broken_code(files: DataFrame) -> DataFrame:
    """(path, ext, body): rs, swift and tsx files whose lines are pieces of statements."""
    return code_files(files, RENDER_BROKEN).select("path", "ext", F.array_join("lines", "\n").alias("body"))


def _around(form: str) -> list[str]:
    a, b = form.split("{w}", 1)
    return [a, "{w}", b]


FILES_SQL = f"""files AS (
  SELECT doc_id, source || '/' || doc_id || '.' || ext AS path, source AS dir, doc_id || '.' || ext AS name, ext, text AS body, strlen(text)::BIGINT AS n_bytes
  FROM (SELECT *, ({list(EXTENSIONS)})[(doc_id % 10) + 1] AS ext FROM documents)
)"""
LINES_SQL = (
    FILES_SQL
    + """, pieces AS (SELECT path, ext, string_split(body, chr(10)) AS a FROM files),
cut AS (SELECT path, ext, CASE WHEN a[-1] = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM pieces),
lines AS (SELECT path, ext, generate_subscripts(a, 1)::BIGINT AS line_no, regexp_replace(unnest(a), '\\r$', '') AS line FROM cut)"""
)


def _code_sql(render: dict, name: str) -> str:
    cases = ""
    for ext, forms in render.items():
        for i, form in enumerate(forms):
            if form is not None:
                text = " || ".join("w" if p == "{w}" else f"'{p}'" for p in _around(form)) if "{w}" in form else f"'{form}'"
                cases += f" WHEN ext = '{ext}' AND line_no % 8 = {i} THEN {text}"
    return f"""{LINES_SQL}, worded AS (SELECT *, regexp_extract(line, '[A-Za-z]+') AS w FROM lines WHERE ext IN ('rs', 'swift', 'tsx')),
{name} AS (SELECT path, ext, line_no, CASE{cases} ELSE line END AS line FROM worded)"""


CODE_SQL = _code_sql(RENDER, "code")
BROKEN_SQL = _code_sql(RENDER_BROKEN, "broken")
