"""Incremental forms: prediction sink, running confusion table, running votes, slow-batch detector."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.operators.voting import POINT, logit_sums, mean_of_sums
from cloudloom.session import new_table_path
from cloudloom.streaming.runs import FANOUT, VERSION, RunLog, newest

ALPHA = 0.05  # fixed value: weight of a new duration in the running mean


def _place(df, name, checkpoint):
    return checkpoint or new_table_path(df.sparkSession, f"stream-{name}")


def stream_predictions(predictions: DataFrame, path: str, checkpoint: str | None = None):
    """Appends each micro-batch to per-file parts; the file sink records what it has committed, so
    a restarted run neither loses nor repeats rows."""
    return (
        predictions.writeStream.format("parquet")
        .partitionBy("file_id")
        .option("path", path)
        .option("checkpointLocation", _place(predictions, "predictions", checkpoint))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_confusion(predictions: DataFrame, path: str, keys=("epoch",), ignore_index=-1, checkpoint: str | None = None):
    """Running confusion counts per epoch. State and result hold classes^2 rows per epoch.

    Every micro-batch publishes the whole counts as a version (see `runs`), so that one which fails leaves the last good ones;
    `read_confusion` takes the newest, and old ones are removed."""
    keys = list(keys)
    df = predictions.filter(F.col("target") != ignore_index)
    counts = df.groupBy(*keys, "target", "pred").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.writeStream.outputMode("complete")
        .foreachBatch(lambda rows, version: RunLog(rows.sparkSession, path).add(rows, version))
        .option("checkpointLocation", _place(predictions, "confusion", checkpoint))
        .trigger(availableNow=True)
        .start()
    )


def read_confusion(spark, path: str) -> DataFrame:
    return RunLog(spark, path).read().drop(VERSION)


def stream_votes(
    predictions: DataFrame, path: str, num_classes: int, checkpoint: str | None = None, arrival: str | None = None, late: str | None = None, fanout: int = FANOUT
):
    """Running logit sums per point. A micro-batch adds a run with the new state of the points it touched, and full levels
    of runs are merged (see `runs`); `read_votes` keeps the newest. With `arrival` and `late`, sums are kept per point and arrival, and a
    watermark drops the state of arrivals that are over; `read_votes` adds them up."""
    keys = list(POINT)
    if arrival:
        predictions = predictions.withWatermark(arrival, late)
        keys.append(arrival)
    sums = logit_sums(predictions, num_classes, keys)
    return (
        sums.writeStream.outputMode("update")
        .foreachBatch(lambda rows, version: RunLog(rows.sparkSession, path, fanout).add(rows, version, newest(keys)))
        .option("checkpointLocation", _place(predictions, "votes", checkpoint))
        .trigger(availableNow=True)
        .start()
    )


def read_votes(spark, path: str, num_classes: int) -> DataFrame:
    cols = ["votes", *[f"s{c}" for c in range(num_classes)]]
    rows = RunLog(spark, path).read()
    state = [c for c in rows.columns if c not in (*cols, VERSION)]  # the point, and the arrival where one was named
    last = rows.groupBy(*state).agg(F.max_by(F.struct(*cols), VERSION).alias("_s")).select(*POINT, "_s.*")
    if len(state) > len(POINT):
        last = last.groupBy(*POINT).agg(*[F.sum(c).alias(c) for c in cols])
    return mean_of_sums(last, num_classes)


class Detector:
    """Decides on one duration at a time; `mean` is the whole state."""

    def __init__(self, slowdown=3.0, absolute=None, interval=0, mean=0.0):
        self.slowdown, self.absolute, self.interval, self.mean = slowdown, absolute, interval, mean

    def step(self, i, duration):
        if self.interval > 0 and (i + 1) % self.interval == 0:
            reason = "periodic"
        elif self.mean > 0 and duration > self.mean * self.slowdown:
            reason = "slowdown"
        elif self.absolute is not None and duration > self.absolute:
            reason = "absolute"
        else:
            reason = ""
            self.mean = duration if self.mean == 0 else self.mean * (1 - ALPHA) + duration * ALPHA
        return reason, self.mean


def _run(pdf, detector):
    got = [detector.step(int(i), float(d)) for i, d in zip(pdf["i"], pdf["duration"])]
    return pdf.assign(reason=[r for r, _ in got], mean=[m for _, m in got])


def _schema(df, keys):
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", i bigint, duration double, reason string, mean double"


def slow_batches(telemetry: DataFrame, keys: list[str], **limits) -> DataFrame:
    """Batch twin of the detector over rows (keys…, i, duration).

    The running mean depends on every decision before it, so a key is followed in order; its rows
    pass through as a sorted stream of Arrow batches and only the running mean is kept.
    """
    cols = [*keys, "i", "duration"]
    laid = telemetry.select(*keys, F.col("i").cast("long"), "duration").repartition(*keys).sortWithinPartitions(*keys, "i")

    def follow(batches):
        here, detector = None, None
        for pdf in batches:
            parts = []
            for key, rows in pdf.groupby(keys, sort=False):
                if key != here:
                    here, detector = key, Detector(**limits)
                parts.append(_run(rows, detector))
            if parts:
                yield pd.concat(parts)[[*cols, "reason", "mean"]]

    return laid.mapInPandas(follow, _schema(telemetry, keys))


def _settle(rows: DataFrame, keys: list[str], wait: bool, limits: dict) -> DataFrame:
    """Decides on the steps of a micro-batch. `rows` (keys…, i, duration, mean, next) also hold the state of every key, with a null `i`.
    Returns decided steps (kind 0), steps that wait (1) and the new state (2)."""
    cols = [*keys, "i", "duration", "mean", "next", "reason", "kind"]
    laid = rows.repartition(*keys).sortWithinPartitions(*keys, F.col("i").asc_nulls_first())

    def state_row(key, detector, after):
        return pd.DataFrame([(*key, None, None, detector.mean, after, None, 2)], columns=cols)

    def follow(batches):
        here, detector, after = None, None, 0
        for pdf in batches:  # one Arrow batch at a time; a key goes on in the next one
            parts = []
            for key, group in pdf.groupby(keys, sort=False, dropna=False):
                names = tuple(None if pd.isna(k) else k for k in key)
                if names != here:
                    if here is not None:
                        parts.append(state_row(here, detector, after))
                    here, detector, after = names, Detector(**limits), 0
                held = group[group["i"].isna()]
                if len(held):
                    detector.mean, after = float(held["mean"].iloc[0]), int(held["next"].iloc[0])
                group = group[group["i"].notna()]
                if wait:  # steps before the first gap are decided
                    number = group["i"].to_numpy("int64")
                    ready = number <= after + np.arange(len(number))
                    n = len(number) if ready.all() else int(ready.argmin())
                    parts.append(group.iloc[n:].assign(reason=None, kind=1))
                    group = group.iloc[:n]
                if len(group):
                    after = int(group["i"].iloc[-1]) + 1
                    parts.append(_run(group, detector).assign(kind=0))
            if parts:
                yield pd.concat([p[cols].astype(object) for p in parts])
        if here is not None:
            yield state_row(here, detector, after)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", i bigint, duration double, mean double, next bigint, reason string, kind int"
    return laid.mapInPandas(follow, schema)


def stream_slow_batches(telemetry: DataFrame, path: str, keys: list[str], checkpoint: str | None = None, wait: bool = False, **limits):
    """Streaming detector. Decided steps (keys…, i, duration, reason, mean) go to `path`, one folder per micro-batch.

    Spark sorts a micro-batch by key and step, spilling as it needs to, and a task follows it one Arrow batch at a time: the
    memory of a task does not grow with the steps of a key. The state, a running mean per key, is a table of its own (see `runs`).
    With `wait`, steps are numbered 0, 1, 2, … per key and a step waits, in the state, until all before it have come, so the
    order of arrival does not matter; what still misses a predecessor stays undecided. Without it, steps are decided by number within a
    micro-batch. Steps without a number are left out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in telemetry.schema}
    slim = telemetry.select(*keys, F.col("i").cast("long").alias("i"), F.col("duration").cast("double").alias("duration")).filter("i IS NOT NULL")
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", i bigint, duration double, mean double, next bigint"

    def store(rows, version):
        spark = rows.sparkSession
        log = RunLog(spark, f"{path}/_state")
        fresh = rows.withColumns({"mean": F.lit(None).cast("double"), "next": F.lit(None).cast("long")})
        before = [v for v in log.versions() if v < version]
        held = log.rows_of(before[-1]).filter("kind > 0").select(*fresh.columns) if before else spark.createDataFrame([], schema)
        log.add(_settle(held.unionByName(fresh), keys, wait, limits), version)
        done = log.read().filter("kind = 0").select(*keys, "i", "duration", "reason", "mean")
        done.write.mode("overwrite").parquet(f"{path}/version={version}")

    return (
        slim.writeStream.foreachBatch(store)
        .option("checkpointLocation", _place(telemetry, "slow", checkpoint))
        .trigger(availableNow=True)
        .start()
    )
