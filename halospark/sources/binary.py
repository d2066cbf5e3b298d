"""Binary record files: an optional header, then records of a fixed layout, read by ranges of records and written one file a task.

A layout is a list of `name:code` with codes of numpy (f4, f8, i4, i8, u8, i2), `[k]` behind a code for arrays. Paths are URIs of any
file system that pyarrow opens (a mounted folder, object stores, HDFS). Reads of a range are a task each, so one large file is
read in parallel. Written files come in place together when all tasks are done, with the least and greatest values of their
ranges beside them, by which a filter skips ranges."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Record layouts and the header's end (fixed values of the formats).
SNAPSHOT = "x:f4,y:f4,z:f4,vx:f4,vy:f4,vz:f4,indx:i8"
HALO = "np:u8,x:f4,y:f4,z:f4,vx:f4,vy:f4,vz:f4"
HALO_HEADER = "size:f4,hubble:f4,npower:f4,omep:f4,omepb:f4,omeplam:f4,bias:f4,nx:i4,nspace:i4,amax:f4,astep:f4,anow:f4"
HALO_HEADER_DE = HALO_HEADER.replace("omeplam:f4,", "omeplam:f4,w0:f4,wa:f4,")
MEMBER = "x:f4,y:f4,z:f4,vx:f4,vy:f4,vz:f4,indx:i8"
HALO_PROP = "hid:i8,mbp:i8,mass:f4,x:f4,y:f4,z:f4,vx:f4,vy:f4,vz:f4,paraspin:f4,sigv:f4,rotation:f4,radius:f4,q:f4,s:f4,kw:f4,ang_mom:f4[3],axes:f4[9]"
TREE = "gid:i8,mbp:i8[{n}],nowhid:i8[{n}],mass:f4[{n}]"
ASCII_END = b"#End of Ascii Header\n"
_SQL = {"f4": "float", "f8": "double", "i2": "smallint", "i4": "int", "i8": "bigint", "u8": "bigint"}


def fields(layout: str) -> list[tuple[str, str, int]]:
    """(name, code, length; 0 for a scalar)."""
    out = []
    for part in layout.split(","):
        name, code, many = re.fullmatch(r"\s*(\w+):([fiu]\d)(?:\[(\d+)\])?\s*", part).groups()
        out.append((name, code, int(many or 0)))
    return out


def record_type(layout: str) -> np.dtype:
    return np.dtype([(n, "<" + c) if not m else (n, "<" + c, (m,)) for n, c, m in fields(layout)])


def schema_of(layout: str) -> str:
    return ", ".join(f"{n} array<{_SQL[c]}>" if m else f"{n} {_SQL[c]}" for n, c, m in fields(layout)) + ", file string, row bigint"


#: Records whose least and greatest values are kept together, about, and the file in which they are.
BLOCK, INDEX = 262_144, "_ranges"


def opened(path: str) -> tuple[files.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"file:/[^/]", path):  # as Hadoop writes local paths
        path = path.removeprefix("file:")
    return files.FileSystem.from_uri(path)


def _names(fs: files.FileSystem, root: str) -> list[str]:
    info = fs.get_file_info(root)
    if info.type != files.FileType.Directory:
        return [root]
    return sorted(f.path for f in fs.get_file_info(files.FileSelector(root)) if f.path.endswith(".bin"))


def header_size(fs: files.FileSystem, path: str, header: str) -> int:
    """header: `ascii`, `none`, or a layout of scalars."""
    if header == "none":
        return 0
    if header != "ascii":
        return record_type(header).itemsize
    with fs.open_input_file(path) as f:
        data = b""
        while (at := data.find(ASCII_END)) < 0:
            more = f.read(4096)
            if not more:
                raise ValueError(f"{path} has no end of header")
            data += more
        return at + len(ASCII_END)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    first: int
    count: int


def _arrow(a: np.ndarray, code: str, many: int) -> pa.Array:
    a = np.ascontiguousarray(a).astype("i8") if code == "u8" else np.ascontiguousarray(a)
    if not many:
        return pa.array(a)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, many, dtype=np.int32)), pa.array(a.ravel()))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.layout, self.header, self.size = options["path"], options["layout"], options.get("header", "none"), int(options.get("records", 1_000_000))
        self.bounds: list[tuple[str, str, float]] = [tuple(x) for x in json.loads(options.get("bounds", "[]"))]

    def pushFilters(self, filters):
        """Comparisons of scalars with numbers skip ranges; Spark applies all filters again to what is read."""
        kinds = {LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">=", EqualTo: "="}
        scalars = {n for n, _, m in fields(self.layout) if not m}
        for f in filters:
            op = kinds.get(type(f))
            if op and len(f.attribute) == 1 and f.attribute[0] in scalars and isinstance(f.value, (int, float)):
                self.bounds.append((f.attribute[0], op, float(f.value)))
            yield f

    def _may(self, block: dict) -> bool:
        for name, op, v in self.bounds:
            low, high = block["low"].get(name), block["high"].get(name)
            if low is not None and ((op == "<" and low >= v) or (op == "<=" and low > v) or (op == ">" and high <= v) or (op == ">=" and high < v) or (op == "=" and not low <= v <= high)):
                return False
        return True

    def partitions(self):
        (fs, root), step, out = opened(self.path), record_type(self.layout).itemsize, []
        known = {}
        if self.bounds and fs.get_file_info(f"{root}/{INDEX}").type == files.FileType.Directory:
            for f in fs.get_file_info(files.FileSelector(f"{root}/{INDEX}")):
                with fs.open_input_file(f.path) as g:
                    known.update(json.loads(g.read()))
        for path in _names(fs, root):
            start = header_size(fs, path, self.header)
            total, rest = divmod(fs.get_file_info(path).size - start, step)
            if rest:
                raise ValueError(f"{path}: {rest} bytes after the last record")
            blocks = known.get(path.rsplit("/", 1)[-1], [{"first": 0, "count": total, "low": {}, "high": {}}])
            for b in filter(self._may, blocks):
                out += [Range(path, start + (b["first"] + k) * step, b["first"] + k, min(self.size, b["count"] - k)) for k in range(0, b["count"], self.size)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition):
        if not partition.count:
            return
        kind, at, (fs, _) = record_type(self.layout), 0, opened(self.path)
        with fs.open_input_file(partition.path) as f:
            f.seek(partition.start)
            while at < partition.count:
                n = min(50_000, partition.count - at)
                a = np.frombuffer(f.read(n * kind.itemsize), kind)
                cols = [_arrow(a[name], c, m) for name, c, m in fields(self.layout)]
                cols += [pa.array([partition.path.rsplit("/", 1)[-1]] * n), pa.array(np.arange(n) + partition.first + at)]
                yield pa.RecordBatch.from_arrays(cols, names=[x[0] for x in fields(self.layout)] + ["file", "row"])
                at += n


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    name: str
    blocks: list


class _Writer(DataSourceArrowWriter):
    """Tasks write under a folder of this write; commit() puts the files of the tasks that counted in place, abort() removes it."""

    def __init__(self, options: dict):
        self.path, self.layout, self.header = options["path"], options["layout"], options.get("header", "none")
        self.values = {k: float(v) for k, v in (x.split("=") for x in options.get("values", "").split(";") if x)}
        self.job = uuid.uuid4().hex[:12]

    def _folder(self, root: str) -> str:
        return f"{root}/_temporary-{self.job}"

    def write(self, iterator):
        from pyspark import TaskContext

        (fs, root), task, kind = opened(self.path), TaskContext.get(), record_type(self.layout)
        fs.create_dir(self._folder(root), recursive=True)
        name = f"part-{task.partitionId():05d}-{self.job}.bin"
        temporary, blocks, first = f"{self._folder(root)}/{task.taskAttemptId()}-{name}", [], 0
        with fs.open_output_stream(temporary) as f:
            if self.header == "ascii":
                f.write("".join(f"define {k} = {v:g}\n" for k, v in self.values.items()).encode() + ASCII_END)
            elif self.header != "none":
                f.write(np.array([tuple(self.values.get(n, 0) for n in record_type(self.header).names)], record_type(self.header)).tobytes())
            for b in iterator:
                if not b.num_rows:
                    continue
                a = np.empty(b.num_rows, kind)
                for n, _, many in fields(self.layout):
                    column = b.column(n)
                    if column.null_count or (many and column.flatten().null_count):
                        raise ValueError(f"{n}: records have no nulls")
                    a[n] = column.flatten().to_numpy().reshape(-1, many) if many else column.to_numpy()
                f.write(a.tobytes())
                scalars = [n for n, _, many in fields(self.layout) if not many]
                low, high = ({n: float(g(a[n])) for n in scalars} for g in (np.min, np.max))
                if blocks and blocks[-1]["count"] < BLOCK:
                    old = blocks[-1]
                    old["count"] += len(a)
                    old["low"], old["high"] = {n: min(v, old["low"][n]) for n, v in low.items()}, {n: max(v, old["high"][n]) for n, v in high.items()}
                else:
                    blocks.append({"first": first, "count": len(a), "low": low, "high": high})
                first += len(a)
        return _Written(temporary, name, blocks)

    def commit(self, messages):
        fs, root = opened(self.path)
        done = [m for m in messages if m is not None]
        for m in done:
            fs.move(m.temporary, f"{root}/{m.name}")
        if done:
            fs.create_dir(f"{root}/{INDEX}", recursive=True)
            with fs.open_output_stream(f"{root}/{INDEX}/{self.job}") as f:
                f.write(json.dumps({m.name: m.blocks for m in done}).encode())
        self.abort(())

    def abort(self, messages):
        fs, root = opened(self.path)
        if fs.get_file_info(self._folder(root)).type == files.FileType.Directory:
            fs.delete_dir(self._folder(root))


class BinaryRecords(DataSource):
    """format("binary_records"), options path, layout, header, records (a task's, when read), bounds, values (the header's, when written: k=v;...)."""

    @classmethod
    def name(cls):
        return "binary_records"

    def schema(self):
        return schema_of(self.options["layout"])

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def read_records(spark: SparkSession, path: str, layout: str, header: str = "none", records: int = 1_000_000, bounds: list[tuple[str, str, float]] = ()) -> DataFrame:
    """Rows of the layout with the file's name and the record's number in it. Ranges of records that cannot hold what bounds,
    such as ("z", "<", 100), or a filter ask for, are not read; with bounds all rows of the others come. For filters the session's
    spark.sql.python.filterPushdown.enabled is set."""
    spark.dataSource.register(BinaryRecords)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("binary_records").options(path=path, layout=layout, header=header, records=str(records), bounds=json.dumps(list(bounds))).load()


def write_records(df: DataFrame, path: str, layout: str, header: str = "none", values: dict | None = None) -> None:
    """One file for each of df's partitions."""
    df.sparkSession.dataSource.register(BinaryRecords)
    names = [f[0] for f in fields(layout)]
    df.select(*names).write.format("binary_records").options(path=path, layout=layout, header=header, values=";".join(f"{k}={v}" for k, v in (values or {}).items())).mode("append").save()


def read_header(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """S3: the scalars at the start of each file, a row each, with the file's name."""
    kind = record_type(layout)
    names = ", ".join(f"{n} {_SQL[c]}" for n, c, _ in fields(layout))

    def run(batches):
        for b in batches:
            got = [np.frombuffer(c.as_py()[: kind.itemsize], kind)[0] for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array([p.rsplit('/', 1)[-1] for p in b.column(0).to_pylist()]), *(pa.array([g[n].item() for g in got], pa.float32() if c == "f4" else None) if c == "f4" else pa.array([int(g[n]) for g in got], pa.int32() if c == "i4" else pa.int64()) for n, c, _ in fields(layout))], names=["file", *(f[0] for f in fields(layout))])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"file string, {names}")
