import datetime

from kithwork.operators import weights
from kithwork.streaming import replies

SCHEMA = "comment_id long, p1 long, p2 long, ts timestamp"


def rows(low, high):
    start = datetime.datetime(2024, 1, 1)
    return [(i, i % 3, i % 4, start + datetime.timedelta(hours=i)) for i in range(low, high)]


def test_totals_of_batches_equal_one_count(spark, tmp_path):
    source, out, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))
    for low in (0, 20, 40):
        spark.createDataFrame(rows(low, low + 20), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        replies.keep_totals(stream, out, mark).awaitTermination()
    got = {tuple(r) for r in replies.current(spark, out).select("p1", "p2", "n").collect()}
    whole = spark.createDataFrame(rows(0, 60), SCHEMA).filter("p1 <> p2")
    assert got == {tuple(r) for r in weights.pair_counts(whole).select("p1", "p2", "n").collect()}


def test_windows_are_closed_by_the_watermark(spark, tmp_path):
    source, mark = (f"file://{tmp_path}/{x}" for x in ("in", "mark"))
    spark.createDataFrame(rows(0, 60), SCHEMA).coalesce(1).write.parquet(source)
    stream = replies.windowed(spark.readStream.schema(SCHEMA).parquet(source))
    query = stream.writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", mark).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(str(r["start"].date()), r["p1"], r["p2"]): r["n"] for r in spark.table("closed").collect()}
    assert got and {k[0] for k in got} <= {"2024-01-01", "2024-01-02"}
    want = sum(1 for _, a, b, t in rows(0, 60) if a != b and t.date() == datetime.date(2024, 1, 1))
    assert sum(n for k, n in got.items() if k[0] == "2024-01-01") == want
