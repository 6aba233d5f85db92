"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe
from .common import load
from .conversation_repair import damaged, repair_report
from .hamming_search import nearest
from .ngram_join import near_duplicates
from .packing import packed
from .pii import BASE, pii_spans, span_text
from .quality_rules import ALPHA, DELTA, MAX_REPEATED, MIN_WORDS, OTHER, RULES, STRATA, least_labels, quality_rules
from .resampling import resampled
from .suffix_dedup import deduplicated
from .token_counts import token_counts
from .topk_search import search
from .toxicity import DECISION, fit, scored
from .url_filters import url_verdicts


def held_out(id_col: str = "doc_id"):
    """The rows whose labels no model may learn: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = fit(docs, load(spark, sf_dir, "labels").where(~held_out()))
    return scored(docs, model, ["doc_id"]).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted"), "toxic")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), pooled=True)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe(load(spark, sf_dir, "documents"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_spans(load(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(span_text("spans", BASE), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packed(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(load(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(load(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(load(spark, sf_dir, "conversations")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), max_n=1)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_quality_rules, op4_ngram_join, op5_byte_bpe, op6_pii, op7_topk_search, op8_packing, op9_url_filters, op10_suffix_dedup, op11_hamming_search, op12_conversation_repair, op13_importance_resampling)}

WORD = r"'[^\x20\x09-\x0D]+'"


def _cuts_sql() -> str:
    tests = ", ".join(f"('{rule}', {k}, {cut})" for rule, (_, cuts) in RULES.items() for k, cut in enumerate(cuts))
    measures = {"symbols": "1000 * n_symbols // n_words", "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)", "repeats": "1000 * n_repeat_words // n_words", "long_words": "100 * word_chars // n_words", "short_words": "-(100 * word_chars // n_words)"}
    values = " UNION ALL ".join(f"SELECT doc_id, stratum, base_failed, '{r}' AS rule, {m} AS v FROM b WHERE n_words > 0" for r, m in measures.items())
    level = DELTA / ((len(STRATA) + 1) * len(RULES))
    a = f"CAST({ALPHA} AS DOUBLE)"
    tail = lambda x, n: f"list_sum([exp(lgamma({n} + 1) - lgamma(j + 1) - lgamma({n} - j + 1) + j * ln({a}) + ({n} - j) * ln(1 - {a})) FOR j IN range(0, {x} + 1)])"
    strata = ", ".join(f"('{s}')" for s in (*STRATA, OTHER))
    return f"""v AS ({values}), label AS (SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL GROUP BY 1), t(rule, k, cut) AS (VALUES {tests}), strata(stratum) AS (VALUES {strata}),
  seen AS (SELECT stratum, rule, k, count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 1 AND v > cut) AS x, count(*) FILTER (good = 0 AND v > cut) AS y FROM v JOIN label USING (doc_id) JOIN t USING (rule) WHERE NOT base_failed GROUP BY 1, 2, 3),
  c AS (SELECT stratum, rule, k, cut, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(x, 0) AS BIGINT) AS x, CAST(coalesce(y, 0) AS BIGINT) AS y FROM strata CROSS JOIN t LEFT JOIN seen USING (stratum, rule, k)),
  w AS (SELECT *, CAST(sum(n) OVER a AS BIGINT) AS all_n, CAST(sum(x) OVER a AS BIGINT) AS all_x, CAST(sum(y) OVER a AS BIGINT) AS all_y, bool_or(n < {least_labels()}) OVER a AS unspent FROM c WINDOW a AS (PARTITION BY rule, k)),
  p AS (SELECT *, CASE WHEN x >= n * {a} THEN 1 ELSE {tail('x', 'n')} END <= {level} AS ok, CASE WHEN all_x >= all_n * {a} THEN 1 ELSE {tail('all_x', 'all_n')} END <= {level} AND unspent AND x <= n * {a} AS all_ok FROM w),
  s AS (SELECT *, bool_and(ok) OVER q AS stands, bool_and(all_ok) OVER q AS all_stands FROM p WINDOW q AS (PARTITION BY stratum, rule ORDER BY k)),
  cuts AS (SELECT stratum, rule, coalesce(arg_max(cut, y * 100 - k) FILTER (stands), arg_max(cut, all_y * 100 - k) FILTER (all_stands)) AS cut FROM s WHERE stands OR all_stands GROUP BY 1, 2),
  bad AS (SELECT DISTINCT doc_id FROM v JOIN cuts USING (stratum, rule) WHERE v > cut)"""


#: CRC-32 of each text w of a table named `distinct_words`, as a table crc(w, c): the byte table by its rule, then bytes one by one.
CRC_SQL = """tab AS (SELECT [list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS t),
  byte AS (SELECT w, list_transform(range(0, strlen(w)), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT)) AS b FROM distinct_words),
  crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS c FROM byte, tab)"""



def _repair_sql() -> str:
    """Conversations by dynamic programming over the last role put: n (none yet), s, u, a, each with its least (cost, audit) and lines."""
    add = lambda x, cost, edit, line: f"CASE WHEN {x} IS NOT NULL THEN {{'cost': {x}.cost + {cost}, 'audit': {x}.audit || {edit}, 'line': {x}.line || {line}}} END"
    least = lambda *xs: f"list_sort([{', '.join(xs)}], 'ASC', 'NULLS LAST')[1]"
    new = lambda name: f"chr(10) || '{NAMES_OF[name]}:'"
    put_u = least("u", *[add(x, 3, "'I'", new("u")) for x in "nsa"])
    put_a = least("a", add("pu", 3, "'I'", new("a")))
    gone = lambda x: add(x, 4, "'D'", "''")
    keep = lambda x, name: f"CASE WHEN NOT must_go AND initial = '{name}' THEN {add(x, '3 * short::INT', repr('K'), 'chr(10) || role || chr(58) || text')} END"
    rerole = lambda x, name: f"CASE WHEN NOT must_go THEN {add(x, '3 + 3 * short::INT', repr('R'), new(name) + ' || text')} END"
    to_u = [f(x, "u") for x in ("n", "s", "pa") for f in (keep, rerole)]
    to_a = [f("pu", "a") for f in (keep, rerole)]
    return f"""steps(conv_id, i, n, s, u, a) AS (SELECT conv_id, 0::BIGINT, {{'cost': 0, 'audit': '', 'line': ''}}, NULL::{STATE}, NULL::{STATE}, NULL::{STATE} FROM convs
    UNION ALL SELECT conv_id, i, {gone('n')}, {least(gone('s'), keep('n', 's'))}, {least(gone('pu'), *to_u)}, {least(gone('pa'), *to_a)}
    FROM (SELECT *, {put_a} AS pa FROM (SELECT g.*, n, s, u, a, {put_u} AS pu FROM steps r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i + 1))),
  ends AS (SELECT conv_id, i, {least('n', put_a)} AS best FROM (SELECT *, {put_u} AS pu FROM steps))"""


NAMES_OF, STATE = {"u": "user", "a": "assistant"}, "STRUCT(cost INTEGER, audit VARCHAR, line VARCHAR)"

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": rf"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents),
  lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, {WORD}) GROUP BY 1),
  g AS (SELECT doc_id, i, ws[i:i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
  rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), (VALUES (0), (1), (2)) o(k) GROUP BY 1),
  b0 AS (SELECT doc_id, CASE WHEN lang IN {STRATA} THEN lang ELSE '{OTHER}' END AS stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_lines, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
  b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM b0),
  {_cuts_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM b""",
    "op4_ngram_join": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i:i + 4], ' ') ELSE array_to_string(ws, ' ') END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1, 2""",
    "op7_topk_search": """WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 20""",
    "op10_suffix_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
  m AS (SELECT g, min(doc_id) AS f FROM w GROUP BY 1),
  x AS (SELECT doc_id, i, i > lag(i, 1, -100) OVER (PARTITION BY doc_id ORDER BY i) + 50 AS new FROM w JOIN m USING (g) WHERE f < doc_id),
  y AS (SELECT doc_id, i, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM x),
  r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM y GROUP BY 1, 2),
  z AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM r UNION ALL SELECT d.doc_id, coalesce(max(r.b), 0), max(length(h)) // 2 FROM d LEFT JOIN r USING (doc_id) GROUP BY 1),
  k AS (SELECT doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a) AS h FROM z JOIN d USING (doc_id) GROUP BY 1),
  t AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n, count(*) AS c FROM r GROUP BY 1)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256 FROM d JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op13_importance_resampling": rf"""WITH w AS (SELECT doc_id, 0 AS target, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
    UNION ALL SELECT item_id, 1, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
  n AS (SELECT doc_id, target, w, count(*) AS n FROM w GROUP BY ALL),
  distinct_words AS (SELECT DISTINCT w FROM n), {CRC_SQL},
  f AS (SELECT doc_id, target, c % 10000 AS bucket, n FROM n JOIN crc USING (w)),
  g AS (SELECT bucket, coalesce(sum(n) FILTER (target = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (target = 1), 0)::DOUBLE AS t FROM f GROUP BY 1),
  a AS (SELECT coalesce(sum(n) FILTER (target = 0), 0)::DOUBLE AS s_all, coalesce(sum(n) FILTER (target = 1), 0)::DOUBLE AS t_all FROM f),
  gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM g, a),
  x AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM f JOIN gain USING (bucket) WHERE target = 0 GROUP BY 1),
  y AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT)::DOUBLE AS h FROM documents d LEFT JOIN x USING (doc_id)),
  z AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM y),
  r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS able FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * able // 100 THEN r END AS rank FROM r""",
    "op12_conversation_repair": rf"""WITH RECURSIVE k AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS w FROM conversations),
  distinct_words AS (SELECT DISTINCT w FROM k), {CRC_SQL},
  d AS (SELECT conv_id, turn, c % 20 AS harm, CASE WHEN harm = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text FROM k JOIN crc USING (w)),
  e AS (SELECT *, unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
  f AS (SELECT *, left(role, 1) AS initial, row_number() OVER c AS i, lag(left(role, 1)) OVER c || left(role, 1) AS two, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS stopped FROM e WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
  g AS (SELECT *, blank OR again AS must_go, NOT (blank OR again OR stopped) AS short FROM f),
  counted AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (short) AS truncated,
    count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY 1),
  convs AS (SELECT DISTINCT conv_id FROM conversations),
  {_repair_sql()}
SELECT ends.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.cost::BIGINT AS cost, best.audit AS audit, sha256(substr(best.line, 2)) AS repaired_sha256 FROM ends LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM ends.conv_id WHERE i = coalesce(rows, 0)""",
}
