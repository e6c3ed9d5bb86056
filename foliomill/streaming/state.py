"""State with subscribers: starred pages per reader, kept by a stream and told on as changes.

Commands come as ``owner, seq, action, item``: ``add``, ``remove`` or ``toggle`` a page, or ``clear`` all.
Each owner's set lies in the stream's state store, one entry a page, so a command touches one entry
whatever the size of the set (``clear`` all of them).  What changes goes out as ``owner, seq, item, here``;
a command that changes nothing tells nothing.  After a restart the stream goes on from its checkpoint.

Commands of an owner that arrive in one micro-batch are applied in the order of ``seq``; later batches come
later, whatever their numbers.  Unknown actions, and commands without what they need, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

COMMANDS = "owner string, seq long, action string, item int"
CHANGES = "owner string, seq long, item int, here boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Stars(StatefulProcessor):
    """One owner's starred pages."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "item int", "seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in sorted(rows, key=lambda r: r["seq"]):
            action, item = row["action"], row["item"]
            if action == "clear":
                for gone in sorted(k[0] for k in self.items.keys()):
                    self.items.removeKey((gone,))
                    yield Row(owner=key[0], seq=row["seq"], item=gone, here=False)
                continue
            here = self.items.containsKey((item,))
            if not here and action in ("add", "toggle"):
                self.items.updateValue((item,), (row["seq"],))
                yield Row(owner=key[0], seq=row["seq"], item=item, here=True)
            elif here and action in ("remove", "toggle"):
                self.items.removeKey((item,))
                yield Row(owner=key[0], seq=row["seq"], item=item, here=False)

    def close(self) -> None:
        pass


def star_changes(commands: DataFrame) -> DataFrame:
    """``CHANGES`` of a stream (or table) of ``COMMANDS``."""
    spark = commands.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    whole = (F.col("action") == "clear") | (F.col("action").isin("add", "remove", "toggle") & F.col("item").isNotNull())
    rows = commands.filter("owner is not null and seq is not null").filter(whole)
    return rows.groupBy("owner").transformWithState(Stars(), CHANGES, "Append", "None")


def follow_stars(spark: SparkSession, source: str, out: str, checkpoint: str, files_at_once: int = 100) -> StreamingQuery:
    """Applies what is new below ``source`` (Parquet files of ``COMMANDS``) and appends the changes to the
    table at ``out``; ends when all that is there has been read."""
    commands = spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", files_at_once).parquet(source)
    stream = star_changes(commands).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return stream.outputMode("append").trigger(availableNow=True).start()
