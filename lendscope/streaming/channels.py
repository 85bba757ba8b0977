"""UDF-02: alert channels as a sink of Spark's streaming writer, with commit and abort.

``writeStream.format("alert_channels")`` writes routed alerts (columns ``channel`` and whatever the
alert holds) as JSON lines for a sender of each channel.  Tasks write files of their own; an epoch
counts once the driver has committed its list of files, and an epoch that is committed already is not
delivered again: the files of the repeat go.  Files are on storage that driver and executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


def _storage(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _plain(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


@dataclass
class Delivered(WriterCommitMessage):
    file: str
    alerts: int


class ChannelWriter(DataSourceStreamWriter):
    """One run of a query: ``path``/alerts has the files, ``path``/epochs the list of each committed epoch."""

    def __init__(self, path: str):
        self.path = _plain(path.rstrip("/"))

    def _in(self, folder: str):
        store, root = _storage(self.path)
        store.create_dir(f"{root}/{folder}", recursive=True)
        return store, f"{root}/{folder}"

    def write(self, iterator: Iterator[Row]) -> Delivered:
        store, folder = self._in("alerts")
        name, n = f"{uuid.uuid4().hex}.json", 0
        with store.open_output_stream(f"{folder}/{name}") as out:
            for row in iterator:
                out.write((json.dumps(row.asDict(recursive=True), default=str) + "\n").encode())
                n += 1
        return Delivered(name, n)

    def commit(self, messages: list, batchId: int) -> None:
        from pyarrow import fs
        store, folder = self._in("epochs")
        target = f"{folder}/epoch={batchId:020d}.json"
        if store.get_file_info(target).type != fs.FileType.NotFound:
            self._drop(messages)                      # delivered before a restart
            return
        files = [m.file for m in messages if m is not None and m.alerts]
        temporary = f"{folder}/_{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as out:
            out.write(json.dumps({"epoch": batchId, "files": files}).encode())
        store.move(temporary, target)
        self._drop([m for m in messages if m is not None and not m.alerts])

    def abort(self, messages: list, batchId: int) -> None:
        self._drop(messages)

    def _drop(self, messages: list) -> None:
        store, folder = self._in("alerts")
        for m in messages:
            if m is not None:
                store.delete_file(f"{folder}/{m.file}")


class AlertChannels(DataSource):
    """Options: ``path``, a folder for this query's alerts."""

    @classmethod
    def name(cls) -> str:
        return "alert_channels"

    def streamWriter(self, schema: StructType, overwrite: bool) -> ChannelWriter:
        return ChannelWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AlertChannels)


def test_channel(path: str) -> bool:
    """Whether the folder of a channel takes files."""
    try:
        writer = ChannelWriter(path)
        writer._drop([writer.write(iter([]))])
        return True
    except OSError:
        return False


test_channel.__test__ = False            # not a test


def deliver(alerts: DataFrame, path: str, checkpoint: str) -> None:
    """Hand over what is available of a stream of routed alerts."""
    register(alerts.sparkSession)
    alerts.writeStream.format("alert_channels").option("path", path).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def delivered(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The alerts of committed epochs, each once, with their ``epoch``."""
    epochs = spark.read.schema("epoch long, files array<string>").json(f"{path}/epochs/epoch=*.json")
    files = epochs.select("epoch", F.explode("files").alias("_file"))
    rows = spark.read.schema(schema).json(f"{path}/alerts").withColumn("_file", F.col("_metadata.file_name"))
    return rows.join(files, "_file").drop("_file")
