"""A table kept as a log of sorted runs, for sinks that write whole states or changed rows per micro-batch.

Every micro-batch adds one run, a folder of Parquet files. A level of `fanout` runs is merged into one run of the next
level, so n micro-batches leave at most (fanout - 1) * log(n) runs to read. Which runs count is told by a manifest, one small
file per version that is written aside and renamed: readers see a version whole or not at all. Runs and manifests that neither the newest
nor the last manifest names are removed, so a reader of the last version is not disturbed. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 8
VERSION = "_v"  # column of a run: the micro-batch that a row comes from


class RunLog:
    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path, fanout
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str) -> list[str]:
        at = self._Path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _remove(self, name: str):
        self._fs.delete(self._Path(f"{self.path}/{name}"), True)

    def versions(self) -> list[int]:
        """Versions whose manifests are in place, ascending."""
        return sorted(int(n.split(".")[0]) for n in self._names("manifest") if n.endswith(".json"))

    def runs(self, version: int) -> list[dict]:
        """Name and level of the runs of a version."""
        file = self._fs.open(self._Path(f"{self.path}/manifest/{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def _publish(self, version: int, runs: list[dict]):
        aside, place = (self._Path(f"{self.path}/manifest/{n}") for n in (f"{version}-{uuid.uuid4().hex}.tmp", f"{version}.json"))
        file = self._fs.create(aside, True)
        file.write(bytearray(json.dumps(runs).encode()))
        file.close()
        self._fs.delete(place, False)  # of the same micro-batch, written before the stream could commit it
        if not self._fs.rename(aside, place):
            raise OSError(f"cannot put the manifest of version {version} in place under {self.path}")

    def _write(self, rows: DataFrame, version: int, level: int) -> dict:
        name = f"{version}-{level}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/runs/{name}")
        return {"run": name, "level": level}

    def _rows(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/runs/{r['run']}" for r in runs])

    def add(self, rows: DataFrame, version: int, merge: Callable[[DataFrame], DataFrame] | None = None):
        """Makes `rows` a run and publishes `version`. `merge` makes one run of the rows of several and keeps column `_v`; without it,
        the new run replaces all before it. A micro-batch that comes again replaces what it published."""
        known = self.versions()
        if known and version < known[-1]:
            raise ValueError(f"{self.path} is at version {known[-1]} and belongs to another stream than the one that writes version {version}")
        before = [v for v in known if v < version]
        runs = self.runs(before[-1]) if before and merge else []
        runs.append(self._write(rows.withColumn(VERSION, F.lit(version)), version, 0))
        level = 0
        while len(full := [r for r in runs if r["level"] == level]) >= self.fanout:
            runs = [r for r in runs if r["level"] != level] + [self._write(merge(self._rows(full)), version, level + 1)]
            level += 1
        self._publish(version, runs)
        kept = {r["run"] for v in (*before[-1:], version) for r in self.runs(v)}
        for name in self._names("runs"):
            if name not in kept:
                self._remove(f"runs/{name}")
        for name in self._names("manifest"):
            if name not in {f"{v}.json" for v in (*before[-1:], version)}:
                self._remove(f"manifest/{name}")

    def rows_of(self, version: int) -> DataFrame:
        """Rows of all runs of a version, with column `_v`."""
        return self._rows(self.runs(version))

    def read(self) -> DataFrame:
        """Rows of all runs of the newest version, with column `_v`."""
        known = self.versions()
        if not known:
            raise FileNotFoundError(f"no version has been published under {self.path}")
        return self.rows_of(known[-1])


def newest(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A merge that keeps the newest row per key, laid in the order of the keys."""

    def merge(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in (*keys, VERSION)]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values, VERSION), VERSION).alias("_row"))
        return last.select(*keys, "_row.*").repartitionByRange(*keys).sortWithinPartitions(*keys)

    return merge
