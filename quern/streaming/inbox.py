"""The inbox as a stream [W8, section 3.2]: ids seen before, in a window of days, are dropped; runs over micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quern.config import STATE_DAYS
from quern.operators import inbox
from quern.operators.graph import durable
from quern.sources import sinks


def deduplicated(events: DataFrame, key: str, at: str, days: int = STATE_DAYS) -> DataFrame:
    """The first row of each key inside the watermark; state older than it is dropped."""
    return events.withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, by: str, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows per window and key; rows later than the watermark are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def drained(stream: DataFrame, path: str) -> DataFrame:
    """The stream's rows after all that is there now, from files under ``path`` beside its checkpoint.

    Running it again on the same path goes on where the last run ended.
    """
    q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


KIND = "msg_id string, kind string, at timestamp"


class _Seen(StatefulProcessor):
    """State of one id: when it was processed, for ``days``, and whether it was dismissed, for good [W8]."""

    def __init__(self, days: float):
        self.ttl = int(days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.processed = handle.getValueState("processed", "at timestamp", ttlDurationMs=self.ttl)
        self.dismissed = handle.getValueState("dismissed", "at timestamp")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = None
        for pdf in rows:
            for kind, at in sorted(zip(pdf["kind"], pdf["at"]), key=lambda r: (r[0] != "dismissed", r[1])):
                if kind == "dismissed":
                    self.dismissed.update((at,))
                elif not self.dismissed.exists() and not self.processed.exists():
                    self.processed.update((at,))
                    new = at
        if new is not None:
            yield pd.DataFrame({"msg_id": [key[0]], "at": [new]})

    def close(self) -> None:
        pass


def unprocessed(events: DataFrame, days: float = STATE_DAYS) -> DataFrame:
    """(msg_id, at) of messages neither processed in the last ``days`` nor ever dismissed, as a stream.

    events: ``KIND``; kind is ``message`` or ``dismissed``, which comes first in a batch.
    The state of a processed id goes by the clock, that of a dismissed one never. A batch
    run (``inbox.checked``) prunes only when it has new messages; here the clock alone does.
    Needs the state store that has time to live (``store``).
    """
    return events.groupBy("msg_id").transformWithStateInPandas(_Seen(days), "msg_id string, at timestamp", "Append", "ProcessingTime")


def store(spark: SparkSession) -> None:
    """The state store that ``unprocessed`` needs, and no batches without rows, of which a clock would make endlessly many."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def runs(messages: DataFrame, root: str, account: str = "", at: str = "at") -> StreamingQuery:
    """Every micro-batch of ``messages`` as one run of the inbox, at the batch's last ``at`` [T20, Q11].

    State is a snapshot under ``root``/processed; what was new in a run is added to
    ``root``/new. A batch that is run again after a failure finds its own number in the
    state and adds nothing.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        n = sinks.last_number(spark, f"{root}/processed")
        if n > number or batch.isEmpty():
            return
        none = spark.createDataFrame([], "msg_id string, category string, subject string, processed_at timestamp")
        processed = sinks.load_snapshot(spark, f"{root}/processed") if n else none
        as_of = batch.agg(F.max(at)).head()[0]
        out = inbox.checked(durable(batch), processed, none, as_of, account)
        new = durable(out["new"])
        new.write.mode("overwrite").parquet(f"{root}/new/run={number}")
        sinks.save_snapshot(out["processed"], f"{root}/processed", after=n)

    return messages.writeStream.foreachBatch(one).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
