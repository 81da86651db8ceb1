"""Mixing sources to target weights by a low-discrepancy schedule.

1. Targets: sources in code-point order (null last) get weights; all words are shared by weight, no source above
   ``max_epochs`` times its own words, the excess going to the others by weight until none is above.
2. Streams: a source's documents, in a shuffled order fixed by a hash, form one stream of words. The source gives as
   many words as its target, rounded: the stream from its start on, going round at the end.
3. Slots: those words are cut into blocks of the source's own length, as many as its share of SLOTS, or LEAST_SLOTS
   (one a word) if that is more. The k-th of n blocks lies at ``(k + u) / n`` of the schedule, where u is the
   golden-ratio point of the source's number, so any stretch of slots is near the weights.
4. A document is cut where slots end, once for each pass over the stream. Its pieces are joined with the slots; what it
   gives is the sum of what slots cover, and ``first_slot`` is the least of them. The blocks tile the words that the
   source gives, so each source gives its target (rounded), at any size. Pieces are at most slots plus passes of
   documents; the join is shuffled by source and rank, so a slot or source of many documents is no task of its own.

A source's stream positions come from two levels (sizes of hash parts, then a running sum in each part), so a source
that holds a third of all rows is spread over PARTS tasks. What reaches the driver is one row a source; at most
MAX_SOURCES of them.

Defined results: null or empty texts have size 0 and are never taken; a null source is a source of its own, ordered
last; equal rows are separate documents, each taken up to ``max_epochs`` times; an empty table gives no rows; only
doc_id, text and source are read, whatever else the table has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kithwork.functions.storage import stored

#: Parts of a source's stream that are summed apart.
PARTS = 256
#: Slots that the sources share; how many words a source gives does not depend on it.
SLOTS = 1 << 20
#: Slots of a source that gives at least as many words.
LEAST_SLOTS = 64
#: More sources than this are refused: the table of sources is handled as a whole.
MAX_SOURCES = 200_000
GOLDEN = 0.6180339887498949


def word_count(text: str):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a column; null has none."""
    body = F.coalesce(F.col(text), F.lit(""))
    flat = F.trim(F.translate(body, "\t\n\x0b\x0c\r", "     "))
    gaps = F.length(flat) - F.length(F.regexp_replace(flat, " (?! )", ""))
    return F.when(flat == "", F.lit(0)).otherwise(gaps + 1).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], max_epochs: int = 3) -> list[float]:
    """Share ``sum(sizes)`` by weight with no target above ``max_epochs`` times its size; what is cut off is shared again."""
    total, cap = float(sum(sizes)), [float(max_epochs * s) for s in sizes]
    out, open_ = [0.0] * len(sizes), [i for i in range(len(sizes))]
    left = total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > cap[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        # the caps of all that are above come off at once; the others' shares can only rise
        for i in over:
            out[i] = cap[i]
            left -= cap[i]
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return out


def schedule(sources: DataFrame) -> DataFrame:
    """Slots of all sources in the order of their places: slot, number and source, rank, begin (word that the source gives), first (word of its stream), words."""
    # cells of the unit interval are counted, and numbered inside
    grid = 1024
    drawn = sources.filter("n_slots > 0").withColumn("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slots") - 1)))
    drawn = drawn.withColumn("place", (F.col("rank") + ((F.col("number") + 0.5) * GOLDEN) % 1.0) / F.col("n_slots")).withColumn("cell", F.floor(F.col("place") * grid))
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = drawn.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("cell").orderBy("place", "number")) - 1
    # given * rank may pass 64 bits
    cut = lambda k: F.expr(f"CAST(CAST(given AS DECIMAL(19, 0)) * {k} DIV n_slots AS LONG)")
    slots = drawn.join(F.broadcast(cells), "cell").withColumn("slot", F.col("ahead") + inside).withColumn("begin", cut("rank"))
    return slots.select("slot", "number", "source", "rank", "begin", (F.col("begin") % F.expr("nullif(source_size, 0)")).alias("first"), (cut("(rank + 1)") - F.col("begin")).alias("words"))


def covered(placed: DataFrame, slots: DataFrame) -> DataFrame:
    """``placed`` (documents in their sources' streams) with first_slot and taken, by the slots that their words lie in."""
    columns = [c for c in placed.columns if c not in ("given", "n_slots")]
    passes = F.expr("CASE WHEN size > 0 AND given > start THEN sequence(0L, (given - start - 1) DIV source_size) ELSE array(CAST(NULL AS LONG)) END")
    pieces = placed.withColumn("pass", F.explode(passes)).withColumn("from", F.expr("start + pass * source_size")).withColumn("to", F.expr("least(from + size, given)"))
    # the slot of word x: the last k with given * k DIV n_slots <= x; a document that no pass reaches gets a rank of its own without slot
    slot_of = lambda x: f"CAST((CAST({x} AS DECIMAL(19, 0)) * n_slots - 1) DIV nullif(given, 0) AS LONG)"
    ranks = F.expr(f"CASE WHEN pass IS NULL THEN array(-nth) ELSE sequence({slot_of('from + 1')}, {slot_of('to')}) END")
    pieces = pieces.withColumn("rank", F.explode(ranks)).select(*columns, "from", "to", "rank")
    # estimates of exploded slots are far too low: shuffled at every size, never broadcast
    found = pieces.join(slots.select("number", "rank", "slot", "begin", "words").hint("merge"), ["number", "rank"], "left")
    words = F.expr("greatest(0L, least(to, begin + words) - greatest(from, begin))")
    return found.groupBy(*columns).agg(F.min(F.when(words > 0, F.col("slot"))).alias("first_slot"), F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), words)), F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, cycle: Sequence[float] = (1, 2, 3), max_epochs: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, slots). documents: doc_id, source, size, source_size, target, start, taken, first_slot (null if not taken); slots as in schedule()."""
    spark = docs.sparkSession
    # text hash in the order key: documents that share an id still have a fixed order
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(doc_id, text).alias("shuffle_key"))
    sized = stored(sized.withColumn("part", F.pmod(F.col("shuffle_key"), F.lit(PARTS)).cast("int")), "mix-sizes")
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("words"))
    by_source = [tuple(r) for r in parts.groupBy("source").agg(F.sum("words").alias("words")).limit(MAX_SOURCES + 1).collect()]
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    by_source.sort(key=lambda r: (r[0] is None, r[0] or ""))
    weights = [float(cycle[i % len(cycle)]) for i in range(len(by_source))]
    aims = targets([s for _, s in by_source], weights, max_epochs)
    total = sum(int(aim + 0.5) for aim in aims)

    rows = []
    for number, ((name, words), aim) in enumerate(zip(by_source, aims, strict=True)):
        given = int(aim + 0.5)
        rows.append((number, name, int(words), float(aim), given, min(given, max(LEAST_SLOTS, -(-SLOTS * given // max(1, total))))))
    schema = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("given", T.LongType()), T.StructField("n_slots", T.LongType())])
    sources = spark.createDataFrame(rows, schema)

    slots = schedule(sources)

    # where each document's words lie in its source's stream
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    part_starts = parts.select("source", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("part_start"))
    named = sources.select(F.col("source").alias("s_source"), "number", "source_size", "target", "given", "n_slots")
    lookup = part_starts.join(named, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    order = Window.partitionBy("source", "part").orderBy("shuffle_key", "doc_id", "size")
    ahead = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumns({"ahead": ahead, "nth": F.row_number().over(order).cast("long")}).alias("d")
    lookup = lookup.alias("l")
    placed = placed.join(lookup, F.col("d.source").eqNullSafe(F.col("l.source")) & (F.col("d.part") == F.col("l.part")))
    # equal rows stay apart by their number in the part
    placed = placed.select("d.doc_id", "d.source", "l.number", "d.part", "d.nth", "d.size", F.col("l.source_size").cast("long"), "l.target", "l.given", "l.n_slots", (F.col("l.part_start") + F.col("d.ahead")).alias("start"))
    documents = covered(placed, slots).select("doc_id", "source", "size", "source_size", "target", "start", "taken", "first_slot")
    return documents, slots
