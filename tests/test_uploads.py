"""Upload outcomes as a stream: ends, timeouts, late rows, restarts."""

import datetime as dt

import pytest

from kgloom.streaming.uploads import STATE_STORE, upload_outcomes

LOG = "upload_id string, at timestamp, status string"
DAY = dt.datetime(2024, 5, 1)


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


@pytest.fixture
def feed(spark, tmp_path):
    spark.conf.set(*STATE_STORE)
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([], LOG).write.parquet(src)

    def step(rows):
        """A batch of rows in a run of its own, from the checkpoint of the one before; all outcomes so far."""
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(src)
        got = upload_outcomes(spark.readStream.schema(LOG).parquet(src), "1 hour", "10 minutes")
        q = got.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        told = spark.read.parquet(out).collect()
        assert len({r["upload_id"] for r in told}) == len(told)
        return {r["upload_id"]: (r["status"], r["started_at"], r["ended_at"], r["processing_ms"], r["n_events"], r["error"]) for r in told}

    yield step
    spark.conf.unset(STATE_STORE[0])


def test_life(feed):
    got = feed([("a", at(0), "processing"), ("a", at(5), "completed"), ("b", at(1), "processing"), ("c", at(2), "processing"), ("c", at(2), "processing"), ("d", at(3), "processing"), (None, at(3), "failed"), ("x", None, "failed"), ("x", at(3), None)])
    a = ("completed", at(0), at(5), 300_000, 2, None)
    assert got == {"a": a}
    # the end of b comes in another run; a's second end changes nothing; ties go to completed, the earliest end counts
    got = feed([("b", at(31), "failed"), ("a", at(32), "failed"), ("e", at(30), "failed"), ("e", at(20), "processing"), ("e", at(30), "completed"), ("e", at(33), "failed")])
    b, e = ("failed", at(1), at(31), 1_800_000, 2, None), ("completed", at(20), at(30), 600_000, 4, None)
    assert got == {"a": a, "b": b, "e": e}
    # an end after the limit comes too late; the watermark (at 71 less 10) hasn't passed c's and d's limit
    got = feed([("d", at(71), "completed")])
    d = ("failed", at(3), at(63), 3_600_000, 2, "timeout")
    assert got == {"a": a, "b": b, "d": d, "e": e}
    # now it has passed c's
    got = feed([("f", at(80), "processing")])
    c = ("failed", at(2), at(62), 3_600_000, 2, "timeout")
    assert got == {"a": a, "b": b, "c": c, "d": d, "e": e}
    # a row older than the watermark (at 70) is dropped, not begun as a new upload
    assert feed([("g", at(10), "completed"), ("f", at(81), "completed")]) == got | {"f": ("completed", at(80), at(81), 60_000, 2, None)}


@pytest.mark.parametrize("groups", [1, 5])
def test_uploads_share_a_group(spark, tmp_path, groups):
    """Uploads that share a row of state live and time out on their own."""
    spark.conf.set(*STATE_STORE)
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    try:
        for rows in ([(f"u{i}", at(i), "processing") for i in range(60)] + [(f"u{i}", at(i + 1), "completed") for i in range(0, 60, 3)], [(f"u{i}", at(i + 2), "failed") for i in range(55, 60)] + [("z", at(100), "processing")]):
            spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(src)
            got = upload_outcomes(spark.readStream.schema(LOG).parquet(src), "1 hour", "10 minutes", groups)
            got.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(STATE_STORE[0])
    want = {f"u{i}": ("completed", at(i + 1), 2, None) for i in range(0, 60, 3)}
    want |= {f"u{i}": ("failed", at(i + 2), 2, None) for i in range(55, 60) if i % 3}
    want |= {f"u{i}": ("failed", at(i + 60), 1, "timeout") for i in range(31) if i % 3}  # the watermark is at 90
    rows = spark.read.parquet(out).collect()
    assert len(rows) == len(want) and {r["upload_id"]: (r["status"], r["ended_at"], r["n_events"], r["error"]) for r in rows} == want
