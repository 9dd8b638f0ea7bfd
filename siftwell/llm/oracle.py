"""SQL of the queries that SQL can express on whole tables, written independently of the operators' plans."""

from __future__ import annotations

from siftwell.llm.licenses import COVER, DRIFT, TELLING, TEMPLATES, VOTES

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"



def _linked(k: int, percent: int) -> str:
    """CTEs sets (doc_id, g: its shingles of k words) and least (node, component_id), by all pairs that share a shingle."""
    run = " || ' ' || ".join(f"a[i + {j}]" if j else "a[i]" for j in range(k))
    return f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(a) = 0 THEN [] WHEN len(a) < {k} THEN [array_to_string(a, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(a) - {k - 2}), lambda i: {run}))) END AS g FROM words),
each AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM sets),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM each x JOIN each y ON x.t = y.t AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS other FROM sets UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
"""


JACCARD = f"""{_linked(3, 90)}SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, CASE WHEN len(g) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY g) END::BIGINT AS set_docs FROM sets JOIN least ON node = doc_id"""

MINHASH = f"""{_linked(2, 80)}SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON node = doc_id"""


def _clusters(k: int = 40, size: int = 64, rounds: int = 5) -> str:
    """Every vector against every centroid in each round."""
    order = "sha256('2:' || vec_id), v"
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: isfinite(x))) = {size})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {order}) - 1 AS j, v FROM kept ORDER BY {order} LIMIT {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT n, any_value(x.vec_id) AS vec_id, any_value(x.v) AS v, min(list_sum(list_transform(range(1, {size + 1}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::BIGINT * 64 + j) AS best FROM kept x, c{i} c GROUP BY n)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT best % 64 AS j, i, sum(v[i]) AS s, count(*) AS m FROM a{i}, range(1, {size + 1}) r(i) GROUP BY ALL)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT j, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS v FROM s{i} GROUP BY j) m ON c.j = m.j)")
    last = "sum(best // 64) OVER"
    return f"WITH {', '.join(parts)} SELECT vec_id, (best % 64)::INTEGER AS cluster, (best // 64)::BIGINT AS distance, ({last} (PARTITION BY best % 64))::BIGINT AS cluster_inertia, ({last} ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c ON best % 64 = c.j"


CLUSTERS = _clusters()

RESAMPLE = f"""WITH bits AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (SELECT row_number() OVER () AS n, doc_id, TRUE AS own, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS a FROM documents
  UNION ALL SELECT row_number() OVER (), NULL, FALSE, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
grams AS MATERIALIZED (SELECT n, own, unnest(list_concat(a, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]))) AS gram FROM texts),
bytes AS (SELECT gram, list_transform(range(0, length(h) // 2), lambda i: 16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) AS b FROM (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM grams))),
hashed AS MATERIALIZED (SELECT gram, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[xor(c & 255, x) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM bytes, bits),
placed AS MATERIALIZED (SELECT n, own, bucket FROM grams JOIN hashed USING (gram)),
sums AS (SELECT r.bucket, count(p.bucket) FILTER (own) AS s, count(p.bucket) FILTER (NOT own) AS t FROM range(0, 10000) r(bucket) LEFT JOIN placed p USING (bucket) GROUP BY r.bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM sums),
means AS (SELECT n, count(*) AS m, sum(gain) AS g FROM placed JOIN gains USING (bucket) WHERE own GROUP BY n),
noise AS (SELECT n, doc_id, len(a) AS words, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: instr('0123456789abcdef', sha256('7:' || doc_id)[i]) - 1)), lambda x, y: 16 * x + y) AS h FROM texts WHERE own),
scored AS (SELECT doc_id, words, coalesce(m, 0)::BIGINT AS n_features, coalesce((g - ((g % m) + m) % m) // m, 0)::BIGINT AS weight, floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS noise FROM noise LEFT JOIN means USING (n)),
placed_docs AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY words >= 20 ORDER BY weight + noise DESC, doc_id) AS r, count(*) FILTER (words >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND r <= 25 * able // 100 THEN r END AS rank FROM placed_docs"""

REPEATS = """WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
places AS (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 399)) AS i FROM hexed WHERE length(x) >= 800),
keys AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS m FROM places),
again AS (SELECT doc_id, i FROM keys QUALIFY count(*) OVER (PARTITION BY m) > 1),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM again),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT r.doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r.doc_id ORDER BY lo), 0) AS since FROM runs r),
kept AS (SELECT g.doc_id, string_agg(substr(x, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS head, max(hi) AS last, sum(hi - lo) AS gone, count(*) AS spans FROM gaps g JOIN hexed h ON g.doc_id = h.doc_id GROUP BY g.doc_id)
SELECT h.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM hexed h LEFT JOIN kept k ON h.doc_id = k.doc_id"""


def _templates() -> str:
    """Rows of (template, phrase, label, base, k, grams, tpos, gram, tells, numbers)."""
    rows = []
    for t, (phrase, label, base) in enumerate(TEMPLATES):
        w, k = phrase.split(), 2 if base else 3
        numbers = any(x.isdigit() for x in w)
        tells = " ".join(x for x in w if x in TELLING or numbers and x.isdigit())
        rows += [f"({t}, '{phrase}', '{label}', {str(base).upper()}, {k}, {len(w) - k + 1}, {i}, '{' '.join(w[i : i + k])}', '{tells}', {str(numbers).upper()})" for i in range(len(w) - k + 1)]
    return "template(template, phrase, label, base, k, grams, tpos, gram, tells, numbers) AS (VALUES " + ", ".join(rows) + ")"


LICENSES = f"""WITH {_templates()},
kinds AS (SELECT DISTINCT template, phrase, label, tells, numbers FROM template),
words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS a FROM documents),
rolling AS (SELECT doc_id, 2 AS k, unnest(range(0, len(a) - 1)) AS pos, a FROM words WHERE len(a) > 1 UNION ALL SELECT doc_id, 3, unnest(range(0, len(a) - 2)), a FROM words WHERE len(a) > 2),
named AS (SELECT doc_id, k, pos, array_to_string(a[pos + 1 : pos + k], ' ') AS gram FROM rolling),
votes AS (SELECT doc_id, template, base, t.k, grams, pos - tpos AS diagonal, count(*) AS v, min(pos) AS lo, max(pos) AS hi FROM named n JOIN template t ON n.gram = t.gram AND n.k = t.k GROUP BY ALL),
joined AS (SELECT p.doc_id, p.template, p.diagonal, any_value(p.k) AS k, any_value(p.grams) AS grams, any_value(p.v) AS v, any_value(p.v) + coalesce(sum(q.v), 0) AS whole, least(any_value(p.lo), coalesce(min(q.lo), any_value(p.lo))) AS s, greatest(any_value(p.hi), coalesce(max(q.hi), any_value(p.hi))) AS e,
  coalesce(bool_or(q.v > p.v OR q.v = p.v AND q.diagonal < p.diagonal), FALSE) AS beaten FROM votes p LEFT JOIN votes q ON q.doc_id = p.doc_id AND q.template = p.template AND abs(q.diagonal - p.diagonal) <= {DRIFT}
  AND (q.hi < p.lo AND q.hi - q.diagonal < p.lo - p.diagonal OR q.lo > p.hi AND q.lo - q.diagonal > p.hi - p.diagonal) WHERE NOT p.base GROUP BY p.doc_id, p.template, p.diagonal),
asked AS (SELECT doc_id, template, TRUE AS base, diagonal AS s, hi + k AS e FROM votes WHERE base AND v = grams
  UNION ALL SELECT DISTINCT doc_id, template, FALSE, s, e + k FROM joined WHERE NOT beaten AND whole >= {VOTES} * grams),
reads AS (SELECT q.doc_id, q.template, base, s, e, phrase, label, tells, numbers, a[s + 1 : e] AS w FROM asked q JOIN words d ON q.doc_id = d.doc_id JOIN kinds k ON q.template = k.template),
judged AS (SELECT *, CASE WHEN base THEN 1.0 ELSE 1 - levenshtein(regexp_replace(array_to_string(w, ' '), '[^\\x00-\\x7F]', '?', 'g'), phrase)::DOUBLE / length(phrase) END AS cover,
  array_to_string(list_filter(w, lambda x: x IN ({", ".join(f"'{x}'" for x in TELLING)}) OR numbers AND regexp_matches(x, '^[0-9]+$')), ' ') AS told FROM reads),
good AS (SELECT * FROM judged WHERE base OR (cover >= {COVER} AND told = tells)),
spans AS (SELECT doc_id, label, base, s, cover FROM good g WHERE base OR NOT EXISTS (SELECT 1 FROM good o WHERE NOT o.base AND o.doc_id = g.doc_id AND o.s < g.e AND g.s < o.e
  AND (o.cover > g.cover OR o.cover = g.cover AND (o.e - o.s > g.e - g.s OR o.e - o.s = g.e - g.s AND o.template < g.template)))),
found AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(cover) AS score FROM spans GROUP BY doc_id)
SELECT w.doc_id, len(a)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM words w LEFT JOIN found f ON w.doc_id = f.doc_id"""
