import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from cloudloom.catalog.shapes import finish
from cloudloom.operators.voting import vote_logits
from cloudloom.session import new_table_path
from cloudloom.sources.points import scan_points
from cloudloom.sources.records import RecordSource, scan_records, write_records
from cloudloom.streaming import predictions as streams
from cloudloom.streaming.runs import RunLog, newest


def test_records_written_by_hand(spark, tmp_path):
    dtype = [("x", "<f8"), ("intensity", "<u2"), ("flag", "|u1")]
    rows = np.zeros(1000, dtype=np.dtype(dtype))
    rows["x"], rows["intensity"], rows["flag"] = np.arange(1000) / 8, np.arange(1000) * 65, 200
    (tmp_path / "a.bin").write_bytes(rows.tobytes())
    (tmp_path / "a.json").write_text(json.dumps({"dtype": dtype}))
    (tmp_path / "lone.bin").write_bytes(b"123")  # no layout: left out
    df = scan_records(spark, str(tmp_path), recordsPerSplit=130)
    assert df.rdd.getNumPartitions() == 8
    got = df.orderBy("point_id").toPandas()
    assert got["point_id"].tolist() == list(range(1000)) and set(got["file_id"]) == {"a"}
    assert (got["x"] == rows["x"]).all() and (got["intensity"] == rows["intensity"]).all() and (got["flag"] == 200).all()


def test_broken_record_file(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    (tmp_path / "a.json").write_text(json.dumps({"dtype": [["x", "<f8"]]}))
    with pytest.raises(Exception, match="no multiple"):
        scan_records(spark, str(tmp_path)).count()


def test_record_round_trip(spark, cloud, tmp_path):
    path = str(tmp_path / "out")
    write_records(cloud.select(F.col("point_id").alias("id"), "x", "intensity"), path)
    back = scan_records(spark, path).select("id", "x", "intensity")
    assert back.exceptAll(cloud.select(F.col("point_id").alias("id"), "x", "intensity")).isEmpty()
    assert back.count() == cloud.count()


def test_records_keep_clouds_ids_and_nulls(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("a", 7, 1.5, 3, True), ("b", 8, None, None, None), ("a", 9, 2.5, -(2**31), False), ("b", 7, float("inf"), 0, True)]
    df = spark.createDataFrame(rows, "file_id string, point_id bigint, x double, n int, flag boolean").repartition(2)
    write_records(df, path)
    back = scan_records(spark, path)
    assert sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, df.collect()))
    assert back.filter("file_id = 'b'").count() == 2
    reader = RecordSource({"path": path}).reader(back.schema)
    every, _ = reader.partitions(), list(reader.pushFilters([EqualTo(("file_id",), "b")]))
    assert {s.stem for s in every} == {"a", "b"} and {s.stem for s in reader.partitions()} == {"b"}
    with pytest.raises(Exception, match="file_id holds nulls"):
        write_records(df.withColumn("file_id", F.lit(None).cast("string")), path)


def test_records_of_several_layouts(spark, tmp_path):
    for name, code in (("a", "<i2"), ("b", "<u2"), ("c", "<f4")):
        rows = np.array([(5,), (6,)], dtype=[("v", code)])
        (tmp_path / f"{name}.bin").write_bytes(rows.tobytes())
        (tmp_path / f"{name}.json").write_text(json.dumps({"dtype": [["v", code]]}))
    got = scan_records(spark, str(tmp_path))
    assert got.schema["v"].dataType.simpleString() == "double" and got.agg(F.sum("v")).first()[0] == 33


def test_votes_with_a_watermark(spark):
    src, path, ck = (new_table_path(spark, n) for n in ("late-in", "late-out", "late-ck"))
    rows = spark.range(80).select(
        F.lit(0).cast("long").alias("file_id"), (F.col("id") % 10).alias("point_id"), F.array(F.col("id") / 8, F.col("id") % 5 / 4).alias("logits"),
        F.timestamp_seconds(1_700_000_000 + F.floor(F.col("id") / 10) * 60).alias("at"),
    )
    for k in range(4):  # in time order, several arrivals a point
        rows.filter((F.col("at").cast("long") - 1_700_000_000) / 120 == k).unionByName(rows.filter((F.col("at").cast("long") - 1_700_000_060) / 120 == k)).coalesce(1).write.mode("append").parquet(src)
    flow = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    finish(streams.stream_votes(flow, path, 2, ck, "at", "1 hour"))
    want = vote_logits(spark.read.parquet(src), 2)
    assert streams.read_votes(spark, path, 2).exceptAll(want).isEmpty() and want.count() == 10


def test_votes_over_several_micro_batches(spark):
    src, path, ck = (new_table_path(spark, n) for n in ("votes-in", "votes-out", "votes-ck"))
    rows = spark.range(60).select(
        (F.col("id") % 2).alias("file_id"), (F.col("id") % 9).alias("point_id"), F.array(F.col("id") / 8, F.col("id") % 5 / 4).alias("logits")
    )
    rows.repartition(3).write.parquet(src)
    for extra in (None, rows.limit(10)):  # the second run resumes from the checkpoint
        if extra is not None:
            extra.write.mode("append").parquet(src)
        flow = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
        finish(streams.stream_votes(flow, path, 2, ck))
        want = vote_logits(spark.read.parquet(src), 2)
        assert streams.read_votes(spark, path, 2).exceptAll(want).isEmpty()


def test_detector_stream_equals_batch(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(i), float(d)) for k in ("train", "val") for i, d in enumerate(rng.exponential(1.0, 120))]
    src, path = new_table_path(spark, "steps"), new_table_path(spark, "flags")
    df = spark.createDataFrame(rows, "stage string, i bigint, duration double")
    for lo in (0, 60):  # two files in time order
        df.filter((F.col("i") >= lo) & (F.col("i") < lo + 60)).coalesce(1).write.mode("append").parquet(src)
    limits = {"slowdown": 2.5, "absolute": 1.5, "interval": 30}
    flow = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    finish(streams.stream_slow_batches(flow, path, ["stage"], **limits))
    got = spark.read.parquet(path).select("stage", "i", "reason", "mean")
    want = streams.slow_batches(df, ["stage"], **limits).select("stage", "i", "reason", "mean")
    assert got.exceptAll(want).isEmpty() and got.count() == 240
    assert {r[0] for r in want.select("reason").distinct().collect()} == {"", "periodic", "slowdown", "absolute"}


def test_steps_out_of_order_wait_for_those_before(spark):
    rng = np.random.default_rng(2)
    rows = [(k, int(i), float(d)) for k in ("train", None) for i, d in enumerate(rng.exponential(1.0, 90))]
    src, path, ck = (new_table_path(spark, n) for n in ("steps", "flags", "steps-ck"))
    df = spark.createDataFrame(rows, "stage string, i bigint, duration double")
    limits = {"slowdown": 2.5, "absolute": 1.5}
    want = streams.slow_batches(df.fillna("-"), ["stage"], **limits).select("stage", "i", "reason", "mean")
    df.filter("i % 3 <> 1 AND i < 60").coalesce(1).write.parquet(src)  # step 1 is missing: only step 0 can be decided
    flow = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    finish(streams.stream_slow_batches(flow, path, ["stage"], ck, wait=True, **limits))
    assert spark.read.parquet(path).select("i").distinct().collect() == [(0,)]
    df.filter("i % 3 = 1 AND i < 60").coalesce(1).write.mode("append").parquet(src)
    finish(streams.stream_slow_batches(flow, path, ["stage"], ck, wait=True, **limits))
    assert spark.read.parquet(path).count() == 120
    df.filter("i >= 60").coalesce(1).write.mode("append").parquet(src)
    finish(streams.stream_slow_batches(flow, path, ["stage"], ck, wait=True, **limits))
    got = spark.read.parquet(path).fillna("-", ["stage"]).select("stage", "i", "reason", "mean")
    assert got.exceptAll(want).isEmpty() and got.count() == 180


def test_one_key_of_many_steps_passes_in_batches(spark):
    src, path = new_table_path(spark, "steps"), new_table_path(spark, "flags")
    df = spark.range(60_000, numPartitions=4).select(F.lit("a").alias("stage"), (59_999 - F.col("id")).alias("i"), (F.col("id") % 7 / 2).alias("duration"))
    df.write.parquet(src)
    finish(streams.stream_slow_batches(spark.readStream.schema(df.schema).parquet(src), path, ["stage"], slowdown=1.5))
    want = streams.slow_batches(df, ["stage"], slowdown=1.5).select("stage", "i", "reason", "mean")
    got = spark.read.parquet(path).select("stage", "i", "reason", "mean")
    assert got.exceptAll(want).isEmpty() and got.count() == 60_000


def test_log_of_runs(spark):
    path = new_table_path(spark, "log")
    log, merge, want = RunLog(spark, path, fanout=3), newest(["k"]), {}

    def add(version, keys):
        rows = [(k, 100 * version) for k in keys]
        want.update(rows)
        log.add(spark.createDataFrame(rows, "k long, x long"), version, merge)

    def state():
        return {r["k"]: r["x"] for r in merge(log.read()).collect()}

    with pytest.raises(FileNotFoundError):
        log.read()
    for v in range(14):
        add(v, {v % 4, v % 5, None})
    assert state() == want and len(want) == 6
    assert [r["level"] for r in log.runs(13)] == [2, 1, 0, 0]  # 14 = 9 + 3 + 1 + 1
    spark.createDataFrame([(1, -1, 99)], "k long, x long, _v int").write.parquet(f"{path}/runs/99-0-half")  # a run that no manifest names
    assert state() == want
    add(13, {1, 7})  # the micro-batch comes again, with other rows: the first ones go
    for k in (13 % 4, 13 % 5, None):
        want[k] = 1300 if k == 1 else max(100 * v for v in range(13) if k in {v % 4, v % 5, None})
    assert state() == want
    assert len(log._names("runs")) <= 6 and log.versions() == [12, 13]
    with pytest.raises(ValueError, match="another stream"):
        add(3, {1})


def test_a_scan_reads_the_files_and_columns_asked_for(spark, cloud, tmp_path):
    path = str(tmp_path / "points")
    cloud.write.partitionBy("file_id").parquet(path)
    got = scan_points(spark, path, files=[1], columns=["file_id", "x"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<x:double>" in plan and "PartitionFilters: [isnotnull(file_id" in plan
    assert got.count() == cloud.filter("file_id = 1").count() > 0


def test_headers_per_file(spark, cloud):
    from cloudloom.sources.points import file_metadata

    vlr = "array<struct<user_id: string, record_id: int, description: string, record_data: binary>>"
    headers = spark.createDataFrame([(0, "1.4", "EPSG:25832", [("u", 7, "d", bytearray(b"x"))], 5.0), (9, "1.0", None, None, None)], f"file_id long, version string, crs string, vlrs {vlr}, x_offset double")
    got = {r["file_id"]: r for r in file_metadata(cloud, header={"generating_software": "s"}, headers=headers).collect()}
    assert set(got) == {0, 1}  # one row per file that has points
    a, b = got[0], got[1]
    assert (a["header"]["version"], a["header"]["crs"], a["header"]["x_offset"], a["vlrs"][0][1]) == ("1.4", "EPSG:25832", 5.0, 7)
    assert (b["header"]["version"], b["header"]["crs"], b["vlrs"]) == ("1.2", None, []) and b["header"]["x_offset"] == b["header"]["x_min"]
    assert a["header"]["generating_software"] == b["header"]["generating_software"] == "s"
