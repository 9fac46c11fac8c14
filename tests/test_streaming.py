import random

from pyspark.sql import functions as F

from stepweave import EventSource, run
from stepweave.streaming import match_stream

TEXT = """
foreach %t,#k in @z
    a ->
        receive
            type = %t -> yield $n, yield k to #s, b
            k = "3" -> yield $three
            * -> repeat
    b ->
        receive
            k in #k -> yield $hit, a
            * -> repeat
        after 20s -> yield $late, a
"""
PARAMS = {"@z": [["x", ["1"]], ["y", ["2", "3"]], ["none", []]]}


def source(df):
    return EventSource(df, "id", "ts", {"type": "type", "k": "k"}, ("seq",))


def test_stream_gives_what_a_batch_does(spark, tmp_path):
    rng = random.Random(3)
    schema = "id string, ts long, seq long, type string, k string"
    whole = []
    for part in range(3):
        rows = [(f"u{rng.randrange(4)}", part * 1000 + rng.randrange(1000), i, rng.choice("xyz"), rng.choice("123")) for i in range(60)]
        whole += [(*r[:2], part * 100 + r[2], *r[3:]) for r in rows]
        spark.createDataFrame(whole[-60:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={part}"))
    # an event of another key, far ahead, moves the watermark past all histories
    spark.createDataFrame([("far", 10**6, 0, "q", "9")], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "part=3"))
    spark.createDataFrame([("far", 10**6 + 1, 1, "q", "9")], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "part=4"))
    stream = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = match_stream(TEXT, source(stream), idle_seconds=5000, params=PARAMS)
    q = out.writeStream.format("memory").queryName("deltas").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r["tuple_idx"], r["var"], tuple(r["key"])): r["n"] for r in spark.table("deltas").groupBy("tuple_idx", "var", "key").agg(F.sum("n").alias("n")).where("n <> 0").collect()}
    batch = run(TEXT, source(spark.createDataFrame(whole, schema)), PARAMS)
    want = {(r["tuple_idx"], r["var"], tuple(r["key"])): r["n"] for r in batch.partial.groupBy("tuple_idx", "var", "key").agg(F.sum("n").alias("n")).where("n <> 0").collect()}
    assert got == want and want
