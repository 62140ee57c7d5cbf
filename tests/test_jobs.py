"""ST2: the one-slot job machine, as a stream against events taken one by one, and against the batch repair."""

import random

from pyspark.sql import functions as F

from chronotile.operators import catalog
from chronotile.streaming import jobs

SCHEMA = "runner string, job_id long, kind string, ts timestamp"


def stream(spark, tmp_path, batches, **options):
    """Final rows of the stream over Parquet files, one micro-batch each."""
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(r, j, kind, at) for r, j, kind, at in rows], "runner string, job_id long, kind string, ms long")
        df.select("runner", "job_id", "kind", F.timestamp_millis("ms").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = jobs.job_changes(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), **options)
        run = query.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination(120)
    return sorted((r.runner, r.at, r.job_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_stream_equals_events_one_by_one(spark, tmp_path):
    rng, batches, slots, now = random.Random(3), [], {"a": jobs.Slot(), "b": jobs.Slot()}, 0
    job = 0
    for _ in range(3):
        rows = []
        for _ in range(40):
            now += rng.randrange(1, 9)
            runner = rng.choice("ab")
            slot, kind = slots[runner], rng.choice(["queued", "queued", "completed", "failed", "repair", "restart", "started"])
            if kind in ("queued", "started"):
                job += 1
                of = job
            else:
                of = slot.running if kind in ("completed", "failed") and rng.random() < 0.8 else 0
            slot.take(of, kind, now)
            rows.append((runner, of, kind, now))
        batches.append(rows)
    want = sorted((k, at, j, s) for k, slot in slots.items() for j, s, at in slot.changes)
    assert stream(spark, tmp_path, batches) == want
    for slot in slots.values():  # one job at a time, oldest first
        running, started = None, []
        for j, s, _ in slot.changes:
            if s == "running":
                assert running is None
                running = j
                started.append(j)
            elif j == running:
                running = None
        assert len(started) > 3


def test_stream_equals_batch_repair(spark, tmp_path):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(400)
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "completed"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    table = orders.select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_at"))
    before = {r.job_id: r.status for r in table.collect()}
    want = {r.job_id: r.status for r in catalog.repaired(table, False).collect()}
    kinds = {"queued": "waiting", "running": "started"}
    rows = [("x", r.job_id, kinds[r.status], r.created_at) for r in table.collect() if r.status in kinds]
    last = max(r[3] for r in rows) + 1
    got = dict(before)
    for _, _, job, state in stream(spark, tmp_path, [rows, [("x", 0, "repair", last)]]):
        got[job] = state
    assert got == want and want != before


def test_stale_jobs_are_released_by_a_timer(spark, tmp_path):
    day = 86_400_000
    batches = [[("a", 1, "queued", day), ("a", 2, "queued", day + 1)], [("b", 9, "queued", day + 3_600_000)], [("b", 10, "queued", day + 3_700_000)]]
    got = stream(spark, tmp_path, batches, stale_after_ms=600_000, delay="1 second")
    assert ("a", day + 600_000, 1, "failed") in got and ("a", day + 600_000, 2, "running") in got and ("b", day + 3_600_000, 9, "running") in got
