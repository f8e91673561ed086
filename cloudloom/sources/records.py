"""Fixed-width binary point records as a Spark data source.

A cloud is `{stem}.bin`, one record after another, beside `{stem}.json` with the record layout:
`{"dtype": [["x", "<f8"], …]}`. Records have one width, so a file splits anywhere; each task reads
its own byte range and hands over Arrow batches. Files of different layouts are read as the widest types. A filter on
`file_id` opens only the files of those clouds.

The writer keeps clouds apart: each task writes one file per cloud, whose layout names its `file_id`. A stored `point_id` is read back; without
one, it is the position of the record. Nulls are kept in a byte per nullable field, named with NULL_MARK in front.

    spark.dataSource.register(RecordSource)
    spark.read.format("pointrecords").load(folder)
    df.write.format("pointrecords").mode("append").save(folder)
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

RECORDS_PER_SPLIT = 4_000_000
RECORDS_PER_BATCH = 64_000

# numpy kind+width -> SQL type; unsigned types widen because SQL has none
SQL_TYPE = {
    "f8": "double", "f4": "float", "i1": "smallint", "u1": "smallint", "i2": "smallint",
    "u2": "int", "i4": "int", "u4": "bigint", "i8": "bigint", "b1": "boolean",
}
NUMPY_TYPE = {
    "double": "<f8", "float": "<f4", "smallint": "<i2", "int": "<i4", "bigint": "<i8", "boolean": "|b1", "tinyint": "|i1",
}
NULL_MARK = "_null_"
WIDTH = ["boolean", "smallint", "int", "bigint", "float", "double"]  # each holds those before it, but for bigint in float
ARROW_TYPE = {
    "double": pa.float64(), "float": pa.float32(), "smallint": pa.int16(), "int": pa.int32(),
    "bigint": pa.int64(), "boolean": pa.bool_(),
}


def _open(path):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _sql_type(code):
    return SQL_TYPE[np.dtype(code).str[1:]]


def _widest(a, b):
    if a is None or a == b:
        return b
    wide = max(a, b, key=WIDTH.index)
    return "double" if wide == "float" and {a, b} & {"int", "bigint"} else wide


@dataclass
class Split(InputPartition):
    stem: str
    path: str
    dtype: list
    first: int
    count: int


@dataclass
class Written(WriterCommitMessage):
    files: list  # (temporary path, final path without ending, layout)


class RecordSource(DataSource):
    @classmethod
    def name(cls):
        return "pointrecords"

    def _clouds(self):
        """Complete (bin, json) pairs; a file without its other half is left out."""
        fs, root = _open(self.options["path"])
        infos = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        found = {i.path: i.size for i in infos if i.is_file}
        for path in sorted(p for p in found if p.endswith(".bin")):
            side = path[:-4] + ".json"
            if side in found:
                with fs.open_input_stream(side) as f:
                    layout = json.loads(f.read())
                yield path, found[path], layout["dtype"], layout.get("file_id", path.rsplit("/", 1)[-1][:-4])

    def schema(self):
        cols, seen = ["file_id string", "point_id bigint"], {}
        for _, _, dtype, _ in self._clouds():
            for name, code in dtype:
                if name != "point_id" and not name.startswith(NULL_MARK):
                    seen[name] = _widest(seen.get(name), _sql_type(code))
        return ", ".join(cols + [f"`{n}` {t}" for n, t in seen.items()])

    def reader(self, schema: StructType):
        return RecordReader(schema, list(self._clouds()), int(self.options.get("recordsPerSplit", RECORDS_PER_SPLIT)), self.options["path"])

    def writer(self, schema: StructType, overwrite: bool):
        if overwrite:
            raise ValueError("pointrecords appends only; choose a new folder instead of overwriting")
        return RecordWriter(schema, self.options["path"])


class RecordReader(DataSourceReader):
    def __init__(self, schema, clouds, per_split, path):
        self.schema, self.clouds, self.per_split, self.root = schema, clouds, per_split, path

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("file_id",):
                self.clouds = [c for c in self.clouds if c[3] == f.value]
            elif isinstance(f, In) and f.attribute == ("file_id",):
                self.clouds = [c for c in self.clouds if c[3] in f.value]
            yield f  # Spark looks at the rows again

    def partitions(self):
        out = []
        for path, size, dtype, stem in self.clouds:
            width = np.dtype([tuple(d) for d in dtype]).itemsize
            if size % width:
                raise ValueError(f"{path}: {size} bytes is no multiple of the record width {width}")
            for first in range(0, size // width, self.per_split):
                out.append(Split(stem, path, dtype, first, min(self.per_split, size // width - first)))
        return out or [Split("", "", [], 0, 0)]

    def read(self, split: Split):
        if not split.count:
            return
        fs, _ = _open(self.root)
        dtype = np.dtype([tuple(d) for d in split.dtype])
        with fs.open_input_file(split.path) as f:
            for at in range(split.first, split.first + split.count, RECORDS_PER_BATCH):
                n = min(RECORDS_PER_BATCH, split.first + split.count - at)
                rows = np.frombuffer(f.read_at(n * dtype.itemsize, at * dtype.itemsize), dtype=dtype)
                arrays = []
                for field in self.schema:
                    kind = ARROW_TYPE.get(field.dataType.simpleString(), pa.string())
                    if field.name == "file_id":
                        arrays.append(pa.array([split.stem] * n, pa.string()))
                    elif field.name == "point_id" and "point_id" not in dtype.names:
                        arrays.append(pa.array(np.arange(at, at + n), pa.int64()))
                    elif field.name in dtype.names:
                        mark = NULL_MARK + field.name
                        gone = np.ascontiguousarray(rows[mark]).astype(bool) if mark in dtype.names else None
                        arrays.append(pa.array(np.ascontiguousarray(rows[field.name]), mask=gone).cast(kind))
                    else:
                        arrays.append(pa.nulls(n, kind))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in self.schema])


class RecordWriter(DataSourceArrowWriter):
    """Each task writes its rows of each cloud to a file under a temporary name; the commit renames those of the tasks
    that succeeded, so a retried task leaves nothing behind that a reader could see. A cloud may have several files."""

    def __init__(self, schema, path):
        self.path = path
        self.fields = [(f.name, NUMPY_TYPE[f.dataType.simpleString()]) for f in schema if f.name != "file_id"]
        self.nullable = [f.name for f in schema if f.nullable and f.name != "file_id"]
        self.by_file = "file_id" in schema.names

    def write(self, iterator):
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        dtype = np.dtype([*self.fields, *((NULL_MARK + n, "|b1") for n in self.nullable)])
        out = {}
        for batch in iterator:
            rows = np.zeros(batch.num_rows, dtype=dtype)
            for name, code in self.fields:
                column = batch.column(batch.schema.get_field_index(name))
                if column.null_count:
                    if name not in self.nullable:
                        raise ValueError(f"{name} holds nulls, but its field is not nullable")
                    rows[NULL_MARK + name] = column.is_null().to_numpy(zero_copy_only=False)
                    column = column.fill_null(False if code == "|b1" else 0)
                rows[name] = column.to_numpy(zero_copy_only=False)
            clouds = batch.column(batch.schema.get_field_index("file_id")).dictionary_encode() if self.by_file else None
            names = [None] if clouds is None else clouds.dictionary.cast(pa.string()).to_pylist()
            which = np.zeros(len(rows), np.int64) if clouds is None else clouds.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
            if clouds is not None and (which == len(names)).any():
                raise ValueError("file_id holds nulls")
            for k in np.unique(which):
                if names[k] not in out:
                    stem = f"part-{uuid.uuid4().hex}"
                    out[names[k]] = (fs.open_output_stream(f"{root}/_{stem}.tmp"), stem)
                out[names[k]][0].write(rows[which == k].tobytes())
        layout = [[n, dtype[n].str] for n in dtype.names]
        done = []
        for name, (f, stem) in out.items():
            f.close()
            done.append((f"{root}/_{stem}.tmp", f"{root}/{stem}", json.dumps({"dtype": layout} | ({} if name is None else {"file_id": name}))))
        return Written(done)

    def commit(self, messages):
        fs, _ = _open(self.path)
        for temp, final, layout in (f for m in messages if m is not None for f in m.files):
            fs.move(temp, final + ".bin")
            with fs.open_output_stream(final + ".json") as f:
                f.write(layout.encode())

    def abort(self, messages):
        fs, _ = _open(self.path)
        for temp, _, _ in (f for m in messages if m is not None for f in m.files):
            fs.delete_file(temp)


def scan_records(spark, path, **options):
    spark.dataSource.register(RecordSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("pointrecords").options(**options).load(path)


def write_records(df, path):
    df.sparkSession.dataSource.register(RecordSource)
    df.write.format("pointrecords").mode("append").save(path)
