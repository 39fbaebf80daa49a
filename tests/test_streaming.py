"""Streams give what the batch windows give."""

from pyspark.sql import functions as F

from ledgerlens.operators import windows as W
from ledgerlens.plans.testmap import transactions
from ledgerlens.streaming.velocity import trailing_counts, windowed_counts


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    tx = transactions(spark, sf_dir).select("id", "client_id", "tsec", F.col("date").cast("timestamp").alias("date"), "amount").cache()
    cut = tx.agg(F.percentile("tsec", F.lit(0.5))).first()[0]
    for i, part in enumerate((tx.where(F.col("tsec") < cut), tx.where(F.col("tsec") >= cut))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={i}"))

    def run(make, name, mode):
        stream = spark.readStream.schema("id long, client_id long, tsec long, date timestamp, amount double, part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    got = {r.id: r.trailing for r in run(trailing_counts, "trailing", "append").collect()}
    want = {r.id: r.n for r in tx.select("id", W.trailing_count("client_id").alias("n")).collect()} if "date" in tx.columns else {}
    assert got == want
    counts = run(windowed_counts, "windows", "complete").agg(F.sum("n")).first()[0]
    assert counts == tx.count()


def test_late_rows_and_expiry(spark, tmp_path):
    """A late row counts only what is up to its time, too late ones (by the watermark of two batches ago) go, and so do dead entities."""
    schema = "id long, client_id long, tsec long"
    for i, rows in enumerate(([(1, 1, 1000), (2, 2, 1000)], [(3, 1, 500), (4, 1, 1100)], [(5, 3, 100_000)], [(6, 3, 100_000), (7, 2, 1000)], [(8, 1, 1000), (9, 3, 200_000)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = trailing_counts(stream).writeStream.format("memory").queryName("late_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "late_rows")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.id: r.trailing for r in spark.table("late_rows").collect()} == {1: 1, 2: 1, 3: 1, 4: 3, 5: 1, 6: 2, 7: 2, 9: 1}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
