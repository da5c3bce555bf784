"""Runoff from series files: NetCDF classic files with a matrix of time steps and reaches, as a Python data source.

A file holds the ids of its reaches and a variable over (time, reach) or (reach,
time).  It is read in splits by ranges of reaches and of time, so that a split
has a bounded number of values whatever the file's size; conditions on reach_id
and t are pushed down and decide which splits and which parts of rows are read.
Wide rows come out as the long runoff table: batch, reach_id, t, value.  Missing
values (not a number, or the variable's fill value) give no row.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds

SCHEMA = "batch string, reach_id long, t int, value double"
VALUES = 1 << 22  # of a split
#: Of the file format: numpy kinds by type number, tags of the header's lists.
KINDS = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 10: ">i8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12


# --- files ---


@dataclass
class Variable:
    """Where a variable lies: its dimensions, type, first byte, and for one that grows by records the bytes between these."""

    dims: tuple[str, ...]
    shape: tuple[int, ...]
    kind: str
    begin: int
    stride: int | None
    attributes: dict


def _open(path: str):
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, at


def read_header(f) -> tuple[dict[str, Variable], dict]:
    """Variables and global attributes of an open file."""
    magic = f.read(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2):
        raise ValueError("not a NetCDF classic file (versions 1 and 2)")
    offset = ">i" if magic[3] == 1 else ">q"
    number = lambda kind=">i": struct.unpack(kind, f.read(struct.calcsize(kind)))[0]
    padded = lambda n: f.read(n + -n % 4)[:n]
    name = lambda: padded(number()).decode()

    def listed(tag: int, one) -> list:
        found, n = number(), number()
        if found not in (0, tag):
            raise ValueError("the header is broken")
        return [one() for _ in range(n)]

    def attribute():
        key, kind, n = name(), KINDS[number()], number()
        data = padded(n * np.dtype(kind).itemsize)
        return key, data.decode(errors="replace") if kind == "S1" else np.frombuffer(data, kind).tolist()

    records = number()
    dims = listed(DIMENSION, lambda: (name(), number()))
    attributes = dict(listed(ATTRIBUTE, attribute))

    def variable():
        key, of = name(), [number() for _ in range(number())]
        own, kind, size, begin = dict(listed(ATTRIBUTE, attribute)), KINDS[number()], number(), number(offset)
        return key, of, own, kind, size, begin

    rows = listed(VARIABLE, variable)
    grows = lambda of: bool(of) and dims[of[0]][1] == 0
    step = sum(size for _, of, _, _, size, _ in rows if grows(of))
    out = {}
    for key, of, own, kind, _, begin in rows:
        shape = tuple(records if dims[d][1] == 0 else dims[d][1] for d in of)
        out[key] = Variable(tuple(dims[d][0] for d in of), shape, kind, begin, step if grows(of) else None, own)
    return out, attributes


def read_part(f, v: Variable, rows: slice, columns: slice) -> np.ndarray:
    """The part of a matrix variable, row by row where it isn't whole rows that lie behind each other."""
    size, width = np.dtype(v.kind).itemsize, v.shape[1]
    stride = v.stride or width * size
    n, m = rows.stop - rows.start, columns.stop - columns.start
    if m == width and stride == width * size:
        f.seek(v.begin + rows.start * stride)
        return np.frombuffer(f.read(n * stride), v.kind).reshape(n, width).astype(np.float64)
    out = np.empty((n, m))
    for i in range(n):
        f.seek(v.begin + (rows.start + i) * stride + columns.start * size)
        out[i] = np.frombuffer(f.read(m * size), v.kind)
    return out


def read_vector(f, v: Variable) -> np.ndarray:
    f.seek(v.begin)
    return np.frombuffer(f.read(v.shape[0] * np.dtype(v.kind).itemsize), v.kind).astype(np.int64)


def file_bytes(ids: np.ndarray, values: np.ndarray, names: tuple[str, str, str, str], batch: str) -> bytes:
    """A version 2 file of ``values`` [steps, reaches] in double precision; ``names``: time, reach, ids and matrix."""
    time, reach, id_name, matrix = names
    name = lambda s: struct.pack(">i", len(s.encode())) + s.encode() + b"\0" * (-len(s.encode()) % 4)
    text = lambda key, s: name(key) + struct.pack(">ii", 2, len(s.encode())) + s.encode() + b"\0" * (-len(s.encode()) % 4)
    head = b"CDF\x02" + struct.pack(">i", 0) + struct.pack(">ii", DIMENSION, 2) + name(time) + struct.pack(">i", values.shape[0]) + name(reach) + struct.pack(">i", values.shape[1])
    head += struct.pack(">ii", ATTRIBUTE, 1) + text("batch", batch) + struct.pack(">ii", VARIABLE, 2)
    none = struct.pack(">ii", 0, 0)
    data = [np.ascontiguousarray(ids, ">f8").tobytes(), np.ascontiguousarray(values, ">f8").tobytes()]  # ids as doubles: exact up to 2 ** 53

    def variables(begin: int) -> bytes:
        one = name(id_name) + struct.pack(">ii", 1, 1) + none + struct.pack(">iiq", 6, min(len(data[0]), 2**31 - 4), begin)
        return one + name(matrix) + struct.pack(">iii", 2, 0, 1) + none + struct.pack(">iiq", 6, min(len(data[1]), 2**31 - 4), begin + len(data[0]))

    return head + variables(len(head) + len(variables(0))) + b"".join(data)


# --- reading ---


@dataclass
class Split(ds.InputPartition):
    path: str
    batch: str
    low: int  # reaches of the file, by place
    high: int
    first: int  # steps
    last: int


class SeriesSource(ds.DataSource):
    """Options: path (a file or a folder of .nc files), variable, ids, time, batch, values (of a split)."""

    @classmethod
    def name(cls) -> str:
        return "river_series"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SeriesReader:
        return SeriesReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> SeriesWriter:
        return SeriesWriter(dict(self.options))


class SeriesReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.variable, self.ids, self.time = options["path"], options.get("variable", "runoff"), options.get("ids", "rivid"), options.get("time", "time")
        self.batch, self.values = options.get("batch"), int(options.get("values", VALUES))
        self.low, self.high, self.first, self.last = -(1 << 62), 1 << 62, 0, 1 << 31
        self.wanted: np.ndarray | None = None

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Takes bounds and lists of reach_id and bounds of t; what it takes it keeps to the letter."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("reach_id",) and isinstance(f, ds.In):
                wanted = np.array(sorted(x for x in f.value if x is not None), np.int64)
                self.wanted = wanted if self.wanted is None else np.intersect1d(self.wanted, wanted)
            elif column in (("reach_id",), ("t",)) and isinstance(value, int) and isinstance(f, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)):
                at_least = value + isinstance(f, ds.GreaterThan) if isinstance(f, (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual)) else None
                below = value + (not isinstance(f, ds.LessThan)) if isinstance(f, (ds.EqualTo, ds.LessThan, ds.LessThanOrEqual)) else None
                if column == ("reach_id",):
                    self.low, self.high = max(self.low, at_least if at_least is not None else self.low), min(self.high, below if below is not None else self.high)
                else:
                    self.first, self.last = max(self.first, at_least if at_least is not None else 0), min(self.last, below if below is not None else self.last)
            elif not (isinstance(f, ds.IsNotNull) and column in (("reach_id",), ("t",))):
                yield f

    def files(self) -> list[str]:
        system, at = _open(self.path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.Directory:
            return sorted(x.path for x in system.get_file_info(fs.FileSelector(at, recursive=True)) if x.path.endswith(".nc"))
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        return [at]

    def matrix(self, f) -> tuple[Variable, bool, np.ndarray, str]:
        """The variable, whether its rows are time steps, the file's ids, and its batch."""
        variables, attributes = read_header(f)
        v = variables[self.variable]
        if len(v.shape) != 2 or self.time not in v.dims:
            raise ValueError(f"{self.variable} isn't a matrix of {self.time} and reaches")
        return v, v.dims[0] == self.time, read_vector(f, variables[self.ids]), self.batch or attributes.get("batch", "all")

    def partitions(self) -> Sequence[Split]:
        system, _ = _open(self.path)
        out = []
        for path in self.files():
            with system.open_input_file(path) as f:
                v, by_time, ids, batch = self.matrix(f)
            steps, place = v.shape[0 if by_time else 1], np.flatnonzero(self.chosen(ids))
            first, last = self.first, min(self.last, steps)
            if not len(place) or first >= last:
                continue
            low, high = int(place[0]), int(place[-1]) + 1
            wide = max(1, min(high - low, self.values))
            tall = max(1, self.values // wide)
            out += [Split(path, batch, a, min(a + wide, high), t, min(t + tall, last)) for a in range(low, high, wide) for t in range(first, last, tall)]
        return out

    def chosen(self, ids: np.ndarray) -> np.ndarray:
        inside = (ids >= self.low) & (ids < self.high)
        return inside if self.wanted is None else inside & np.isin(ids, self.wanted)

    def read(self, part: Split | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # what Spark asks for where there are no splits
            return
        system, _ = _open(self.path)
        with system.open_input_file(part.path) as f:
            v, by_time, ids, _ = self.matrix(f)
            reaches, steps = slice(part.low, part.high), slice(part.first, part.last)
            values = read_part(f, v, steps, reaches) if by_time else read_part(f, v, reaches, steps).T
        keep = np.flatnonzero(self.chosen(ids[reaches]))
        values, own = values[:, keep], ids[reaches][keep]
        fill = v.attributes.get("_FillValue")
        there = ~np.isnan(values) & (values != fill[0] if isinstance(fill, list) else True)
        row, column = np.nonzero(there)
        for at in range(0, len(row), 1 << 16):
            r, c = row[at : at + (1 << 16)], column[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([part.batch] * len(r), pa.string()), pa.array(own[c]), pa.array((r + part.first).astype(np.int32)), pa.array(values[r, c])], names=["batch", "reach_id", "t", "value"])


# --- writing ---


@dataclass
class Written(ds.WriterCommitMessage):
    paths: list[str]


class SeriesWriter(ds.DataSourceArrowWriter):
    """A file for each batch in each task; a task's rows make its matrix, so ``write_series`` deals them by ranges of reaches."""

    def __init__(self, options: dict):
        self.path, self.steps = options["path"], int(options["steps"])
        self.names = options.get("time", "time"), options.get("reach", "rivid"), options.get("ids", "rivid"), options.get("variable", "runoff")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        paths = []
        table = pa.Table.from_batches([b for b in iterator if b.num_rows] or [pa.RecordBatch.from_pylist([], pa.schema([("batch", pa.string()), ("reach_id", pa.int64()), ("t", pa.int32()), ("value", pa.float64())]))])
        batches = table.column("batch").fill_null("all")
        for name in batches.unique().to_pylist():
            part = table.filter(pa.compute.equal(batches, name))
            ids, column = np.unique(np.asarray(part.column("reach_id")), return_inverse=True)
            t = np.asarray(part.column("t"))
            inside = (t >= 0) & (t < self.steps)
            values = np.full((self.steps, len(ids)), np.nan)
            values[t[inside], column[inside]] = 0
            np.add.at(values, (t[inside], column[inside]), np.asarray(part.column("value"))[inside])
            paths.append(f"{folder}/part-{uuid.uuid4().hex}.nc")
            with system.open_output_stream(paths[-1]) as f:
                f.write(file_bytes(ids, values, self.names, name))
        return Written(paths)

    def abort(self, messages) -> None:
        system, _ = _open(self.path)
        for m in messages:
            for path in m.paths if m else ():
                system.delete_file(path)


def read_series(spark: SparkSession, path: str, **options) -> DataFrame:
    """batch, reach_id, t, value of a file or of all .nc files of a folder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SeriesSource)
    return spark.read.format("river_series").options(**{k: str(v) for k, v in options.items()}).load(path)


def write_series(runoff: DataFrame, path: str, steps: int, files: int, **options) -> None:
    """Writes ``runoff`` for 0 <= t < steps as about ``files`` files by ranges of reaches; rows of one place add up."""
    runoff.sparkSession.dataSource.register(SeriesSource)
    rows = runoff.select("batch", "reach_id", F.col("t").cast("int").alias("t"), F.col("value").cast("double").alias("value")).repartitionByRange(files, "reach_id")
    rows.write.format("river_series").options(steps=str(steps), **{k: str(v) for k, v in options.items()}).mode("append").save(path)
