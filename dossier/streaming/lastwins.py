"""A growing result log as a stream whose later rows replace earlier ones, whatever the order or the files they arrive in.

Each sample has a state: its last row, by the place of the row in the log, and how many rows it had. Every row that becomes the last
one is told, with the place of the row it replaces; rows that are older than the last one, or the same again, only count. So
the states after any cut of a log into files, in any order, are those of the whole log, and a file that is delivered again changes
no row. A query that stops goes on from its checkpoint.

With `quiet`, a sample that had no new row for so many seconds is told once more as settled, by a timer; its state stays.

Hot samples: a group's rows are read a bounded number at a time, and only the state is kept. Rows stay rows on the way: a sample has
few in a batch, and a frame for each sample would cost more than they do.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import attrgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.frames import computed
from ..functions.jsonx import is_object, parsed, string_field

STATE = "place long, status string, value string, n_rows long, n_replaced long"
CHANGE = "sample_id string, place long, status string, value string, change string, replaced long"
Change = Row(*(c.split()[0] for c in CHANGE.split(", ")))
#: How many rows of a sample are sorted at a time.
SOME = 10_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastRow(StatefulProcessor):
    def __init__(self, quiet: float | None) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        place, status, value, n_rows, n_replaced = self.last.get() or (None, None, None, 0, 0)
        for some in iter(lambda: list(islice(rows, SOME)), []):
            n_rows += len(some)
            for row in sorted(some, key=attrgetter("place")):
                if place is None or row.place > place:
                    yield Change(key[0], row.place, row.status, row.value, "new" if place is None else "replaced", place)
                    n_replaced += place is not None
                    place, status, value = row.place, row.status, row.value
        self.last.update((place, status, value, n_rows, n_replaced))
        if self.quiet is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.quiet))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            place, status, value, _, _ = self.last.get()
            yield Change(key[0], place, status, value, "settled", place)

    def close(self) -> None:
        pass


def stateful(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep states of any kind; options of the caller's session stay."""
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


def named_rows(lines: DataFrame) -> DataFrame:
    """(sample_id, place, status, value) of the good lines of a stream or table with columns line_no and value."""
    good = computed(lines, {"row": parsed("value")}).where(is_object("row"))
    good = computed(good, {"sample_id": string_field("row", "sample_id"), "status": string_field("row", "status")}).where("sample_id is not null")
    return good.select("sample_id", F.col("line_no").cast("long").alias("place"), "status", "value")


def changes(rows: DataFrame, quiet: float | None = None) -> DataFrame:
    """The stream of changes: a row for each that becomes the last one of its sample, and, with quiet, for samples that have settled."""
    return rows.groupBy("sample_id").transformWithState(LastRow(quiet), CHANGE, outputMode="Append", timeMode="None" if quiet is None else "ProcessingTime")


def followed(rows: DataFrame, log: str, checkpoint: str, quiet: float | None = None, **trigger: object) -> StreamingQuery:
    """Append the changes to a folder of JSON lines: all that is there now, and then end, unless another trigger is given. With quiet,
    the query looks for new rows and settled samples each second until it is stopped, as timers go on without new rows."""
    out = changes(rows, quiet).writeStream.format("json").outputMode("append").option("path", log).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or ({"availableNow": True} if quiet is None else {"processingTime": "1 second"}))).start()


def states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(sample_id, place, status, value, n_rows, n_replaced) of all samples, as the checkpoint of a stream of changes has them."""
    held = spark.read.format("statestore").option("stateVarName", "last").load(checkpoint)
    return held.select(F.col("key.sample_id").alias("sample_id"), "value.*")
