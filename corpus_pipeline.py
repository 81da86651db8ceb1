"""Corpus pipeline: toxic documents, near duplicates and benchmark passages go, sources are mixed, the rest is sharded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's rows to the shared folder
and reads them again, so a stage starts from files and lineage is short. All stages but the last return the columns
that they got. Documents are told apart by a hash of id and text; rows alike in both are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithwork.functions.storage import discard, stored
from kithwork.llm import decontamination, jaccard, mixing, sharding, toxicity

SHARDS = 24
KEY = "__kw_key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the lexicon is learned from the labels that are not held out."""
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, docs.columns, out="__kw_score")
    return scored.filter(F.col("__kw_score") < toxicity.THRESHOLD).drop("__kw_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a full window of a benchmark item (decontamination.WINDOW words in a row).

    An item of fewer words is one window of its own; one common word may be an item, so such items count only where
    the words hit make up a twentieth of the document.
    """
    index = decontamination.build_index(_keyed(docs), doc_id=KEY)
    hits = decontamination.search(index, _table(spark, sf_dir, "benchmark"))
    bad = hits.filter(decontamination.holds_window() | decontamination.contaminated())
    bad = stored(bad.select(F.col("doc_id").alias(KEY)).distinct(), "contaminated")
    discard(index)
    return _keyed(docs).join(bad, KEY, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: words that its slots cover by size, rounded, so none to three times.

    The slots decide what goes on and how often. Their order does not: columns stay, and sharding numbers rows by hash.
    """
    rows = mixing.mix(_keyed(docs), doc_id=KEY)[0]
    copies = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    taken = rows.filter("size > 0").groupBy(F.col("doc_id").alias(KEY)).agg(F.sum(copies).cast("int").alias("__kw_copies"), F.count(F.lit(1)).alias("__kw_rows"))
    # as many rows as documents: shuffled at every size, never broadcast
    found = _keyed(docs).join(stored(taken.filter("__kw_copies > 0"), "taken").hint("merge"), KEY)
    alike = found.filter("__kw_rows > 1").dropDuplicates([KEY])
    both = found.filter("__kw_rows = 1").unionByName(alike)
    return both.withColumn("__kw_copy", F.explode(F.sequence(F.lit(1), F.col("__kw_copies")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``shard`` and ``slot``; columns of these names in the input are replaced."""
    placed = _keyed(docs.drop("shard", "slot")).withColumn("shard", sharding.shard_of(F.col("doc_id"), [1.0] * SHARDS))
    return sharding.with_slots(placed, "shard", "slot", ["doc_id", KEY]).drop(KEY)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Learned weights and MinHash have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
