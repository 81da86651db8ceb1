"""The registered queries ``opN_<name>`` and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithwork.llm import decontamination, html_text, jaccard, lines, mixing, pii, quality, sharding, substrings, toxicity

SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontamination.build_index(table(spark, sf_dir, "documents"))
    rows = decontamination.search(index, table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), decontamination.contaminated().alias("contaminated"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(table(spark, sf_dir, "documents"), with_text=False)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign(table(spark, sf_dir, "documents"), [1.0] * SHARDS, grown=1.0)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.score(docs, model, ["doc_id"])
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.score(table(spark, sf_dir, "documents"))
    kept = ~quality.base_failed() & (F.col("posterior") >= 0.5)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.base_failed().alias("base_failed"), kept.alias("kept"), "posterior")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html": op1_html,
        "op2_pii": op2_pii,
        "op3_decontaminate": op3_decontaminate,
        "op4_lines": op4_lines,
        "op5_substrings": op5_substrings,
        "op6_mix": op6_mix,
        "op7_shards": op7_shards,
        "op8_toxicity": op8_toxicity,
        "op9_jaccard": op9_jaccard,
        "op10_quality": op10_quality,
    }


OP3_SQL = r"""
WITH words AS (
    SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i
    FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
), items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS phrase
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows), grams AS (
    SELECT d.doc_id, s.size, k AS i, array_to_string(w[k : k + s.size - 1], ' ') AS phrase
    FROM (SELECT doc_id, list(word ORDER BY i) AS w FROM words GROUP BY doc_id) d, sizes s, unnest(range(1, len(w) - s.size + 2)) AS u(k)
), found AS (SELECT g.doc_id, g.i, g.size, w.item_id FROM grams g JOIN windows w ON g.size = w.size AND g.phrase = w.phrase
), hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM found) GROUP BY doc_id
), named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
), counted AS (SELECT doc_id, count(*) AS n_words FROM words GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(c.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(m.listed, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= coalesce(c.n_words, 0) AS contaminated
FROM documents d LEFT JOIN counted c USING (doc_id) LEFT JOIN hit h USING (doc_id) LEFT JOIN named m USING (doc_id)
"""


OP4_SQL = r"""
WITH lines AS (
    SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), again AS (
    SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (SELECT l.*, a.first IS NOT NULL AND l.doc_id <> a.first AS gone FROM lines l LEFT JOIN again a USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP5_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
    SELECT doc_id, i, sha256(array_to_string(w[i : i + 34], ' ')) AS h FROM words, unnest(range(1, len(w) - 33)) AS u(i)
), again AS (SELECT h FROM grams GROUP BY h HAVING count(*) > 1
), gone AS (SELECT doc_id, list(DISTINCT j) AS places FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM grams SEMI JOIN again USING (h)) GROUP BY doc_id
), kept AS (
    SELECT doc_id, len(w) AS n, k.words AS left_over
    FROM words LEFT JOIN gone USING (doc_id), LATERAL (
        SELECT list(x ORDER BY p) AS words FROM (SELECT unnest(w) AS x, generate_subscripts(w, 1) AS p) WHERE places IS NULL OR NOT list_contains(places, p)) k
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - coalesce(len(left_over), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(left_over, ' '), '')) AS kept_sha256
FROM kept
"""


OP9_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 5 * c.n >= 4 * (x.n + y.n - c.n)
), reach AS (
    SELECT DISTINCT a AS root, a AS node FROM links UNION SELECT r.root, l.b FROM reach r JOIN links l ON l.a = r.node
), named AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node
), counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, coalesce(m.class_id, d.doc_id) AS class_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN named m ON m.node = d.doc_id LEFT JOIN counted c ON c.a = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3_SQL, "op4_lines": OP4_SQL, "op5_substrings": OP5_SQL, "op9_jaccard": OP9_SQL}
