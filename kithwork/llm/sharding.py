"""Rendezvous hashing of stable record keys over weighted shards, with DataFrame functions only.

A record goes to the shard with the highest score ``-weight / ln(u)``, where ``u`` in (0, 1) comes from a hash of
the record's key and the shard's number. A shard's score for a key depends on nothing else, so one more shard takes
records only into itself, and a heavier shard takes its share of all records.

Defined results: a null key hashes like any other value (all null keys share a shard); a null text has no bytes;
equal rows get the same shard and different slots; an empty table gives an empty result; columns other than the key
and the text are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard are numbered in this many parts, so that no task sorts a whole shard.
SLOT_PARTS = 256


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard (an int column) that wins ``key`` among ``weights`` (all above 0)."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    base = F.xxhash64(key)

    def score(shard: int, weight: float) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(base, F.lit(shard).cast("long")), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.lit(float(weight)) / F.ln(unit)).alias("score"), F.lit(-shard).alias("number"))

    return (-F.array_max(F.array(*(score(i, w) for i, w in enumerate(weights))))["number"]).cast("int")


def with_slots(rows: DataFrame, shard: str, slot: str, order: Sequence[str]) -> DataFrame:
    """Add ``slot``: a gapless number from 0 in each shard, in hash order of the columns ``order``.

    Rows are numbered in SLOT_PARTS parts of each shard, and every part starts where the one before ends; the table of
    starts has one row for each shard and part, whatever the input's size, so it is broadcast.
    """
    part, start, last = "__kw_part", "__kw_start", "__kw_n"
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(SLOT_PARTS)).cast("int"))
    counts = dealt.groupBy(shard, part).agg(F.count(F.lit(1)).alias(last))
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, part, F.coalesce(F.sum(last).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(shard, part).orderBy(*order)
    numbered = dealt.withColumn(slot, F.row_number().over(inside).cast("long") - 1)
    joined = numbered.join(F.broadcast(starts), [shard, part])
    return joined.withColumn(slot, F.col(slot) + F.col(start)).drop(part, start)


def assign(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown: float | None = None) -> DataFrame:
    """One narrow row a record: key, size, text_crc32, shard, slot, and grown_shard if one more shard of weight ``grown`` is asked for."""
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        shard_of(F.col(key), weights).alias("shard"),
        (shard_of(F.col(key), [*weights, grown]) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return with_slots(narrow, "shard", "slot", [key, "size", "text_crc32"])


def write_shards(docs: DataFrame, weights: Sequence[float], path: str, key: str = "doc_id") -> None:
    """Write ``docs`` as one Parquet folder a shard (``__shard=N``), all columns kept."""
    docs.withColumn("__shard", shard_of(F.col(key), weights)).write.partitionBy("__shard").parquet(path)
