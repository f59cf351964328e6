"""SQL for those operators that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)
"""


def _spans(rank: int, pattern: str, group: int, keep: str) -> str:
    """Offsets of one kind: pieces between matches and the matches, summed up."""
    p = pattern.replace("'", "''")
    return f"""
SELECT doc_id, {rank} AS r, start, start + len AS end_ FROM (
  SELECT doc_id, part, whole, list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0) AS start, length(whole) AS len
  FROM (
    SELECT doc_id, gaps, found, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS whole, unnest(parts) AS part
    FROM (SELECT doc_id, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', 0) AS found, regexp_extract_all(text, '{p}', {group}) AS parts FROM d)
  )
) WHERE {keep}"""


def secret_scan() -> str:
    from chronoweave.llm.secret_scan import KINDS, SCOPE

    keep = {
        "assign": "length(part) >= 8",
        "access": "length(part) >= 16",
        "hex": "length(part) >= 32",
        "weak_id": "length(part) >= 4",
        "weak_secret": "regexp_matches(part, '[0-9]') AND regexp_matches(part, '[a-z]') AND regexp_matches(part, '[A-Z]')",
        "endpoint": "length(part) >= 8",
    }
    every = "\nUNION ALL\n".join(_spans(i, k.pattern, k.group, keep[k.name]) for i, k in enumerate(KINDS))
    names = ", ".join(f"'{k.name}'" for k in KINDS)
    roles = ", ".join(f"'{k.role}'" for k in KINDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({every}),
m AS (SELECT *, [{roles}][r + 1] AS role, r >= 3 AS weak FROM s),
kept AS (
  SELECT doc_id, r, start, end_, weak, [{names}][r + 1] || ':' || start || ':' || end_ AS span FROM m
  WHERE NOT weak OR EXISTS (
    SELECT 1 FROM m AS o WHERE o.doc_id = m.doc_id AND o.role <> m.role
    AND CASE WHEN (o.start, o.end_, o.r) < (m.start, m.end_, m.r) THEN m.start - o.end_ ELSE o.start - m.end_ END <= {SCOPE})
),
a AS (
  SELECT doc_id, count(*) FILTER (r = 0) AS n_assign, count(*) FILTER (r = 1) AS n_access, count(*) FILTER (r = 2) AS n_hex, count(*) FILTER (weak) AS n_linked,
    string_agg(span, ',' ORDER BY start, r) FILTER (NOT weak) AS base, string_agg(span, ',' ORDER BY start, r) AS spans
  FROM kept GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN a USING (doc_id)
"""


def _words(text: str) -> str:
    lowered = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"list_filter(string_split_regex({lowered}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _shingles(words: str) -> str:
    return f"CASE WHEN len({words}) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len({words}) - 4, 1) + 1), lambda i: array_to_string({words}[i:i + 4], ' '))) END"


CONTAMINATION = f"""
WITH dw AS (SELECT doc_id, {_words('text')} AS w FROM documents), iw AS (SELECT DISTINCT item_id, {_words('text')} AS w FROM benchmark),
i AS (SELECT item_id, len(w) AS n_words, unnest({_shingles('w')}) AS s FROM iw),
d AS (SELECT doc_id, len(w) AS n_words, unnest({_shingles('w')}) AS s FROM dw),
n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id),
b AS (SELECT d.doc_id, i.item_id, count(*) AS shared_shingles FROM d JOIN i ON d.s = i.s AND (i.n_words >= 5 OR d.n_words < 5) GROUP BY d.doc_id, i.item_id)
SELECT doc_id, item_id, item_shingles, shared_shingles FROM b JOIN n USING (item_id) WHERE 100 * shared_shingles >= 80 * item_shingles
"""

NEAR_DEDUP = f"""
WITH RECURSIVE dw AS (SELECT doc_id, {_words('text')} AS w FROM documents), s AS (SELECT doc_id, unnest({_shingles('w')}) AS s FROM dw),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents AS d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_LINE_WORDS = r"len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> ''))"

#: Chunks between boundaries, and beside them the shortest runs of 50 words from and up to each line; of either, all but the first place go.
LINE_DEDUP = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line, len(lines) AS n, ('0x' || substr(md5(lines[i]), 1, 6))::BIGINT AS v FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
e AS (SELECT *, (v + 31 * coalesce(lag(v) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 3 = 0 AS last_line, {_LINE_WORDS} AS words FROM l),
c AS (SELECT *, coalesce(sum(last_line::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_no,
  sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM e),
k AS (SELECT doc_id, min(i) AS first, max(i) AS last, sum(words) AS words FROM c GROUP BY doc_id, chunk_no),
f AS (SELECT x.doc_id, x.i AS first, min(y.i) AS last FROM c AS x JOIN c AS y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.upto - x.upto + x.words >= 50 GROUP BY x.doc_id, x.i),
u AS (SELECT y.doc_id, max(x.i) AS first, y.i AS last FROM c AS x JOIN c AS y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.upto - x.upto + x.words >= 50 GROUP BY y.doc_id, y.i),
s AS (SELECT 'chunk' AS kind, doc_id, first, last FROM k WHERE last > first AND words >= 10 UNION ALL SELECT 'run', doc_id, first, last FROM (SELECT * FROM f UNION SELECT * FROM u)),
m AS (SELECT s.*, row_number() OVER (PARTITION BY kind, array_to_string(d.lines[first:last], chr(10)) ORDER BY s.doc_id, first) AS seen FROM s JOIN d ON s.doc_id = d.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM m WHERE seen > 1),
kept AS (SELECT c.doc_id, string_agg(line, chr(10) ORDER BY c.i) AS clean FROM c LEFT JOIN gone ON c.doc_id = gone.doc_id AND c.i = gone.i WHERE gone.i IS NULL GROUP BY c.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.lines) AS n_lines, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.clean, '')) AS clean_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL_SEARCH = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
r AS (
  SELECT q.item_id, p.doc_id, sum(q.repeats * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (100 - 25 + (25 * p.n * s.n_docs) // s.n_terms))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY q.item_id, p.doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""

HARD_NEGATIVES = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": EXACT_DEDUP, "op4_near_dedup": NEAR_DEDUP, "op5_decontaminate": CONTAMINATION, "op6_line_dedup": LINE_DEDUP, "op8_secret_scan": secret_scan(), "op11_lexical_search": LEXICAL_SEARCH, "op12_hard_negatives": HARD_NEGATIVES}
