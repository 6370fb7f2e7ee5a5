"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tidegate.llm import quality

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _top_k() -> str:
    return """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def _quality() -> str:
    lists = "MAP {" + ", ".join(f"'{k}': [{', '.join(repr(w) for w in v)}]" for k, v in {**quality.COMMON_WORDS, quality.OTHER: quality.COMMON_WORDS["en"]}.items()) + "}"
    n = len(quality.COMMON_WORDS["en"])
    known = ", ".join(repr(k) for k in quality.COMMON_WORDS)

    def distance(p: str, q: str, size: int) -> str:
        each = " + ".join(
            f"(CASE WHEN a[{i}] > 0 THEN a[{i}] * log2(a[{i}] / ((a[{i}] + b[{i}]) / 2)) ELSE 0 END + CASE WHEN b[{i}] > 0 THEN b[{i}] * log2(b[{i}] / ((a[{i}] + b[{i}]) / 2)) ELSE 0 END) / 2"
            for i in range(1, size + 1)
        )
        norm = lambda h: f"list_transform({h}, lambda x: CAST(x AS DOUBLE) / CAST(list_sum({h}) AS DOUBLE))"
        return f"(SELECT CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, {each})) ELSE 0 END FROM (SELECT {norm(p)} AS a, {norm(q)} AS b))"

    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IN ({known}) THEN lang ELSE '{quality.OTHER}' END AS lang, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, {_WORDS.format("text")} AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), tri AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t FROM (SELECT r, words, unnest(range(1, greatest(1, len(words) - 1))) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM tri) WHERE c > 1
), covered AS (
  SELECT r, count(*) AS c FROM (SELECT DISTINCT r, i + o AS at FROM twice, (SELECT unnest([0, 1, 2]) AS o)) GROUP BY r
), m AS (
  SELECT w.r, doc_id, lang, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words, length(text) AS n_chars,
    length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS upper, length(regexp_replace(text, '[^0-9]+', '', 'g')) AS digit,
    length(regexp_replace(text, '[^!-/:-@\[-`{{-~]+', '', 'g')) AS punct, length(regexp_replace(text, '[\x00-\x7F]+', '', 'g')) AS wide,
    list_transform(({lists})[lang], lambda x: len(list_filter(words, lambda y: lower(y) = x))) AS hits
  FROM w LEFT JOIN covered ON covered.r = w.r
), h AS (
  SELECT *, [n_chars - upper - digit - (n_chars - word_chars) - punct - wide, upper, digit, n_chars - word_chars, punct, wide] AS classes,
    list_append(hits, CAST(n_words - list_sum(hits) AS BIGINT)) AS common FROM m
), ref AS (
  SELECT lang, [{", ".join(f"sum(classes[{i}])" for i in range(1, 7))}] AS all_classes, [{", ".join(f"sum(common[{i}])" for i in range(1, n + 2))}] AS all_common FROM h GROUP BY lang
), far AS (
  SELECT h.*, {distance("classes", "all_classes", 6)} AS cd, {distance("common", "all_common", n + 1)} AS wd,
    n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM h JOIN ref ON h.lang = ref.lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_chars >= {quality.CLASS_MIN_CHARS} AND cd > {quality.CLASS_MAX_DISTANCE})
  AND NOT (n_words >= {quality.WORD_MIN_WORDS} AND wd > {quality.WORD_MAX_DISTANCE}) AS kept
FROM far
"""


def _preferences() -> str:
    return r"""
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT pair_id, turn AS last_turn, text AS own FROM c WHERE role = 'assistant' AND turn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC, text DESC NULLS LAST) = 1),
b AS (SELECT l.pair_id, l.last_turn, x.own AS other FROM l JOIN l x ON x.pair_id = xor(l.pair_id, 1)),
t AS (
  SELECT pair_id, true AS chosen, turn, role, text FROM c
  UNION ALL SELECT c.pair_id, false, turn, role, text FROM c LEFT JOIN b ON b.pair_id = c.pair_id WHERE b.pair_id IS NULL OR turn IS NULL OR turn < b.last_turn
  UNION ALL SELECT pair_id, false, last_turn, 'assistant', other FROM b
), o AS (
  SELECT pair_id, chosen, role, text, row_number() OVER (PARTITION BY pair_id, chosen ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS position FROM t
), same AS (
  SELECT pair_id, position, count(*) = 2 AND max(role) IS NOT DISTINCT FROM min(role) AND max(text) IS NOT DISTINCT FROM min(text)
    AND count(role) <> 1 AND count(text) <> 1 AS equal FROM o GROUP BY pair_id, position
), fork AS (SELECT pair_id, min(position) FILTER (NOT equal) AS fork FROM same GROUP BY pair_id)
SELECT pair_id, CASE WHEN common THEN 'prompt' WHEN chosen THEN 'chosen' ELSE 'rejected' END AS part, position, role,
  '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS rendered,
  NOT common AND coalesce(role = 'assistant', false) AS learned
FROM (SELECT o.*, fork IS NULL OR position < fork AS common FROM o JOIN fork USING (pair_id)) WHERE NOT common OR chosen
"""


def _jaccard() -> str:
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM l JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), r AS (
  SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reach
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) m ON m.node = d.doc_id
"""


ORACLE: dict[str, str] = {
    "op2_exact_top_k": _top_k(),
    "op4_distribution_divergence": _quality(),
    "op7_preference_formatting": _preferences(),
    "op8_ngram_jaccard_join": _jaccard(),
}
