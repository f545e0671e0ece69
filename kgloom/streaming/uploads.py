"""The life of uploads as a stream: one outcome an upload, also of those whose end never comes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.iterate import shared_folder

#: What the processor puts out; times are microseconds, as pandas' times would be read in the session's time zone.
_ROW = "upload_id string, status string, started_us long, ended_us long, n_events long, error string"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
#: Needed by queries with upload_outcomes: their state is kept there.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ENDS = {"completed": 0, "failed": 1}
_MICRO = 1000


#: A group's open uploads are one row of state, read and written at once.
_OPEN = "upload_id array<string>, first array<long>, ended array<long>, end array<int>, n array<long>, told array<boolean>"


class _Life:
    """State of a group's open uploads: first event, first end and number of events, in microseconds, and whether the outcome was told;
    a timer at the earliest of their latest ends."""

    def __init__(self, limit_ms: int) -> None:
        self.limit = limit_ms * _MICRO

    def _row(self, upload: str, first: int, ended: int | None, end: int | None, n: int) -> tuple:
        late = ended is None or ended > first + self.limit
        ended = first + self.limit if late else ended
        status = "failed" if late or end == ENDS["failed"] else "completed"
        return upload, status, first, ended, n, "timeout" if late else None

    def _due(self, first: int) -> int:
        return -(-(first + self.limit) // _MICRO)

    def __call__(self, key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        life = {u: (first, ended, end, n, told) for u, first, ended, end, n, told in zip(*state.get, strict=True)} if state.exists else {}
        touched, watermark, rows = set(), state.getCurrentWatermarkMs(), []
        for b in () if state.hasTimedOut else pieces:  # a batch of a group's rows comes in pieces
            for upload, us, kind in zip(b["upload_id"].tolist(), b["us"].tolist(), b["end"].tolist(), strict=True):
                first, ended, end, n, told = life.get(upload) or (us, None, None, 0, False)
                if told:  # what comes after an outcome was told changes nothing
                    continue
                if kind >= 0 and (ended is None or (us, kind) < (ended, end)):
                    ended, end = us, kind
                life[upload] = (min(first, us), ended, end, n + 1, False)
                touched.add(upload)
        for upload in touched:
            first, ended, end, n, _ = life[upload]
            if ended is not None:
                rows.append(self._row(upload, first, ended, end, n))
                life[upload] = (first, ended, end, n, True)
        for upload in [u for u, x in life.items() if self._due(x[0]) <= watermark]:
            first, ended, end, n, told = life.pop(upload)
            if not told:
                rows.append(self._row(upload, first, ended, end, n))
        if life:
            state.update((list(life), *map(list, zip(*life.values(), strict=True))))
            # timers fire once the watermark is beyond them
            state.setTimeoutTimestamp(self._due(min(x[0] for x in life.values())) - 1)
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=_NAMES)


def upload_outcomes(events: DataFrame, limit: str = "1 hour", late: str = "10 minutes", groups: int = 1 << 13) -> DataFrame:
    """One row an upload from a stream of (upload_id, at timestamp with or without zone, status): completed or failed by its earliest end (of equal
    times completed), from its first event; failed with error `timeout` where no end comes within `limit` of the first event.
    An end is told in the batch that brings it, a timeout once the watermark (`late` behind the newest event) has passed it.

    Any status but completed and failed keeps an upload going. Rows without upload_id, time or status are dropped; repeated rows
    count in n_events alone; rows of an upload whose outcome was told change nothing until the limit has passed, and an upload
    that starts anew after that is a new one. Uploads are dealt to `groups` by hash, as a call of Python and its state cost more than
    an upload does. A group's state holds a few numbers for each upload of the last `limit`, whatever the number of its events, and
    is rewritten by a batch that touches one of them; its rows of a batch pass the task in pieces. The session needs STATE_STORE; a
    restart from the checkpoint goes on where it stopped, with the number of groups as it was.
    """
    spark = events.sparkSession
    ms = int(spark.sql(f"SELECT CAST(unix_millis(TIMESTAMP '1970-01-02 00:00:00' + INTERVAL {limit}) - unix_millis(TIMESTAMP '1970-01-02 00:00:00') AS BIGINT) AS ms").first()["ms"])
    end = F.when(F.col("status") == "completed", ENDS["completed"]).when(F.col("status") == "failed", ENDS["failed"]).otherwise(-1)
    kind, moment = events.schema["at"].dataType, F.col("at").cast("timestamp")
    rows = events.where("upload_id is not null and at is not null and status is not null").select(F.col("upload_id").cast("string").alias("upload_id"), moment.alias("at"), F.unix_micros(moment).alias("us"), end.cast("int").alias("end"))
    grouped = rows.withColumn("group", F.pmod(F.xxhash64("upload_id"), F.lit(groups))).withWatermark("at", late).groupBy("group")
    told = grouped.applyInPandasWithState(_Life(ms), _ROW, _OPEN, "append", GroupStateTimeout.EventTimeTimeout)
    spent = F.floor((F.col("ended_us") - F.col("started_us")) / _MICRO).cast("long")
    return told.select("upload_id", "status", F.timestamp_micros("started_us").cast(kind).alias("started_at"), F.timestamp_micros("ended_us").cast(kind).alias("ended_at"), spent.alias("processing_ms"), "n_events", "error")


def outcomes_so_far(events: DataFrame, limit: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The outcomes of all that a stream's source holds now, as a table: the stream runs to its end with a checkpoint of its
    own in the session's shared folder, where its rows are stored too."""
    spark, root = events.sparkSession, f"{shared_folder(events.sparkSession)}/{uuid.uuid4().hex}"
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:
        told = upload_outcomes(events, limit, late)
        told.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STATE_STORE[0], before)
    return spark.read.schema(told.schema).parquet(f"{root}/rows")
