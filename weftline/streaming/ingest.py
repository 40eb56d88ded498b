"""Incremental loads: the batch merge run on every micro-batch of a stream."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.ingest import upsert

#: Shares of the table by a hash of uid; a batch rewrites only those that it touches.
SHARES = 32


class EventTable:
    """Events in a shared folder, cut into shares by uid. A version is a small file that says where each share was last written.

    A version is complete once that file is there. A batch that runs again after a loss finds its own number and does
    nothing, so every batch counts once. Shares that neither of the last two versions needs are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, schema, shares: int = SHARES):
        self.spark, self.folder, self.schema, self.shares = spark, folder, schema, shares
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the complete versions, in order."""
        place = self.path(f"{self.folder}/versions")
        names = [s.getPath().getName() for s in self.files.listStatus(place)] if self.files.exists(place) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def _shares(self, number: int | None) -> dict[str, int]:
        """Which version wrote each share last."""
        return json.loads(self.spark.read.text(f"{self.folder}/versions/{number}.json", wholetext=True).first()[0]) if number is not None else {}

    def _rows(self, shares: dict[str, int]) -> DataFrame:
        paths = [f"{self.folder}/v{version}/share={share}" for share, version in sorted(shares.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, before: int | None = None) -> DataFrame:
        """The last complete version, or the last one before a number; empty at first."""
        held = [v for v in self.versions() if before is None or v < before]
        return self._rows(self._shares(held[-1] if held else None))

    def merge(self, batch: DataFrame, number: int, forgotten: DataFrame, arrival: Column | None = None) -> None:
        """A batch merged into the version before it. `arrival` orders the rows of a uid; without it a hash of the row does, the same in every run."""
        held = self.versions()
        if number in held:
            return
        order = F.xxhash64(*(F.to_json(c) if kind.startswith(("map", "struct", "array")) else F.col(c) for c, kind in batch.dtypes)) if arrival is None else arrival
        ordered = batch.withColumn("arrival", F.row_number().over(Window.partitionBy("uid").orderBy(order)))
        share = F.pmod(F.xxhash64("uid"), F.lit(self.shares)).cast("int")
        touched = {str(r[0]) for r in batch.select(share).distinct().collect()}
        known = self._shares(max((v for v in held if v < number), default=None))
        merged = upsert(self._rows({s: v for s, v in known.items() if s in touched}), ordered, forgotten)
        merged.drop("outcome").withColumn("share", share).write.mode("overwrite").partitionBy("share").parquet(f"{self.folder}/v{number}")
        place = self.path(f"{self.folder}/v{number}")
        written = {s.getPath().getName().removeprefix("share=") for s in self.files.listStatus(place) if s.getPath().getName().startswith("share=")}
        self._write(number, {s: v for s, v in known.items() if s not in touched} | {s: number for s in written})
        self._clean()

    def _write(self, number: int, shares: dict[str, int]) -> None:
        """The version's file, written aside and put in place at once."""
        aside = self.path(f"{self.folder}/versions/.{number}.tmp")
        out = self.files.create(aside, True)
        out.write(bytearray(json.dumps(shares).encode()))
        out.close()
        self.files.rename(aside, self.path(f"{self.folder}/versions/{number}.json"))

    def _clean(self) -> None:
        last = self.versions()[-2:]
        needed = {(version, share) for number in last for share, version in self._shares(number).items()}
        for status in self.files.listStatus(self.path(self.folder)):
            name = status.getPath().getName()
            if name.startswith("v") and name[1:].isdigit() and int(name[1:]) <= last[-1]:
                for part in self.files.listStatus(status.getPath()):
                    share = part.getPath().getName().removeprefix("share=")
                    if part.isDirectory() and (int(name[1:]), share) not in needed:
                        self.files.delete(part.getPath(), True)


def ingest(stream: DataFrame, store: EventTable, forgotten: Callable[[], DataFrame], checkpoint: str, once: bool = True, arrival: str | None = None) -> StreamingQuery:
    """A streaming load: every micro-batch is merged by the same rules as a batch load. `arrival` names a column of the stream that orders it."""

    def load(batch: DataFrame, number: int) -> None:
        store.merge(batch, number, forgotten(), F.col(arrival) if arrival else None)

    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, at: str, late: str, window: str, *by: str) -> DataFrame:
    """Events by tumbling window, late ones dropped by the watermark. (An extension: the activity model has no windows of its own.)"""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")
