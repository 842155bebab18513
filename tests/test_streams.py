"""Confirmations as a stream against the batch form."""

import random

from pyspark.sql import functions as F

from factloom.operators import relations
from factloom.streaming import confirmations

SCHEMA = "id string, asks boolean, user string, tool string, nonce string, ts timestamp"


def made(n=160):
    rng = random.Random(2)
    rows = []
    for k in range(n):
        asks = rng.random() < 0.5
        rows.append((f"e{k:03}", asks, rng.choice("ab"), rng.choice(["mine", "attack", "fly", "place"]) if asks else None, f"n{rng.randrange(6)}", 1_000_000 + rng.randrange(0, 400) * 500_000))
    return rows


def streamed(spark, path, files, late):
    """Each file is a batch of its own; the last one moves the watermark past everything."""
    for k, rows in enumerate(files):
        df = spark.createDataFrame(rows, "id string, asks boolean, user string, tool string, nonce string, at long")
        df.withColumn("ts", F.timestamp_micros("at")).drop("at").coalesce(1).write.json(f"{path}/in/{k:03}")
    was = spark.conf.get(confirmations.STATE_STORE[0], None)
    spark.conf.set(*confirmations.STATE_STORE)
    try:
        events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"{path}/in")
        out = confirmations.dispatch_stream(events, (2,), late)
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start(f"{path}/out")
        query.awaitTermination(300)
        assert query.exception() is None
    finally:
        spark.conf.unset(confirmations.STATE_STORE[0]) if was is None else spark.conf.set(confirmations.STATE_STORE[0], was)
    return sorted((tuple(r) for r in spark.read.parquet(f"{path}/out").where("partner is not null or id <> 'last'").collect()), key=str)


def test_any_order_within_the_watermark_equals_the_batch(spark, tmp_path):
    rows = made()
    rng = random.Random(7)
    mixed = sorted(rows, key=lambda r: r[-1] + rng.randrange(0, 20_000_000))  # up to 20 seconds out of order
    files = [mixed[i::1][k * 40 : (k + 1) * 40] for k in range(4) for i in (0,)]
    last = [("last", True, "a", "mine", "other", 10**12)]
    got = streamed(spark, str(tmp_path), [*files, last], "1 minute")
    df = spark.createDataFrame(rows, "id string, asks boolean, user string, tool string, nonce string, at long").withColumn("ts", F.timestamp_micros("at"))
    asked = df.where("asks").select(F.col("id").alias("request_id"), F.col("user").alias("user_id"), "tool", "nonce", "ts")
    said = df.where("not asks").select(F.col("id").alias("confirm_id"), F.col("user").alias("user_id"), "nonce", "ts")
    want = sorted((tuple(r) for r in relations.dispatch(asked, said, (2,)).select("id", "kind", "outcome", "partner").collect()), key=str)
    assert {o for _, _, o, _ in want} == {"executed", "unconfirmed", "unknown", "disabled", "none", "expired", "other_user", "used"}
    assert got == want


def test_ties_by_number(spark, tmp_path):
    """Ids of the same moment are ordered as numbers: 9 comes before 10; one timer for a nonce takes all rows."""
    rows = [(9, True, 1, "mine", 1, 0), (10, True, 2, "mine", 1, 0), (11, False, 2, "mine", 1, 60), (12, True, 3, "mine", 2, 30), (13, False, 3, "mine", 2, 90), (-1, True, -1, "mine", -1, 10**9)]
    made = spark.createDataFrame(rows, "id long, asks boolean, user long, tool string, nonce long, s long").selectExpr("id", "asks", "user", "tool", "nonce", "timestamp_seconds(s + 1000) AS ts")
    made.write.parquet(f"{tmp_path}/in")
    spark.conf.set(*confirmations.STATE_STORE)
    try:
        stream = confirmations.dispatch_stream(spark.readStream.schema(made.schema).parquet(f"{tmp_path}/in"), (2,), "1 minute", 7200)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    finally:
        spark.conf.unset(confirmations.STATE_STORE[0])
    got = {(r.id, r.kind, r.outcome, r.partner) for r in spark.read.parquet(f"{tmp_path}/out").where("id <> '-1'").collect()}
    assert got == {
        ("9", "request", "unconfirmed", None), ("10", "request", "executed", "11"), ("11", "confirm", "executed", "10"), ("12", "request", "executed", "13"), ("13", "confirm", "executed", "12"),
    }
