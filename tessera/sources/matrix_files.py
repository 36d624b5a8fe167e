"""A Spark data source over ``.npy`` matrices: row ranges are partitions, and only the bytes asked for are read.

    spark.dataSource.register(NpySource)
    spark.read.format("npy_slices").option("rows", "100:110").option("columns", "5:8").load(path)

Files have one or two dimensions of numbers; where a folder has a ``_manifest`` (``writers.npy``), its files are read. ``rows`` and ``columns`` are ranges of each file; conditions on ``row`` narrow the range
further where Spark hands filters on (its setting PUSHDOWN, and the option ``pushdown``), and are checked by Spark again.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Rows whose bytes one partition, and one batch, holds at most.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SCHEMA = "file string, row bigint, vector array<double>"


class Rows(InputPartition):
    def __init__(self, file: str, first: int, last: int, width: int, offset: int, dtype: str, columns: tuple[int, int], wanted: tuple[int, ...] | None):
        self.file, self.first, self.last, self.width, self.offset, self.dtype, self.columns, self.wanted = file, first, last, width, offset, dtype, columns, wanted


def read_header(f) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """(shape, whether columns lie together, type, where the numbers begin) of an open file."""
    version = np.lib.format.read_magic(f)
    head = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if head is None:
        raise ValueError(f"npy version {version}")
    shape, fortran, dtype = head(f)
    if dtype.hasobject or dtype.kind not in "fiub":
        raise ValueError(f"no numbers: {dtype}")
    return shape, fortran, dtype, f.tell()


def span(text: str | None, n: int) -> tuple[int, int]:
    """A range ``a:b`` within ``n``, all of it for None."""
    a, _, b = (text or ":").partition(":")
    return min(int(a or 0), n), min(int(b) if b else n, n)


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows, self.columns = options["path"], options.get("rows"), options.get("columns")
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))
        self.least, self.most, self.wanted = 0, None, None

    def partitions(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(root)
        files = [info] if info.is_file else [x for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and x.base_name.endswith(".npy")]
        lists = [] if info.is_file else [x for x in system.get_file_info(fs.FileSelector(f"{root}/_manifest", allow_not_found=True)) if x.base_name.endswith(".json")]
        if lists:  # only what attempts that ended well have written
            known = {json.loads(line)["file"] for x in lists for line in system.open_input_stream(x.path).read().splitlines()}
            files = [x for x in files if x.base_name in known]
        out = []
        for x in sorted(files, key=lambda x: x.path):
            with system.open_input_file(x.path) as f:
                shape, fortran, dtype, offset = read_header(f)
            if fortran and len(shape) > 1 or len(shape) > 2:
                raise ValueError(f"{x.path}: rows do not lie together")
            n, width = (shape if len(shape) == 2 else (1, *shape)) if shape else (1, 1)
            a, b = span(self.rows, n)
            a, b = max(a, self.least), b if self.most is None else min(b, self.most)
            wanted = None if self.wanted is None else tuple(w for w in self.wanted if a <= w < b)
            if wanted is not None:
                a, b = (wanted[0], wanted[-1] + 1) if wanted else (0, 0)
            step = max(1, self.size // max(width * dtype.itemsize, 1))
            out += [Rows(x.path, i, min(i + step, b), width, offset, dtype.str, span(self.columns, width), None if wanted is None else tuple(w for w in wanted if i <= w < i + step)) for i in range(a, b, step)]
        return out

    def read(self, part: Rows | None):
        from pyarrow import fs

        if part is None:  # what Spark gives where there are no partitions
            return

        system, _ = fs.FileSystem.from_uri(self.path)
        dtype = np.dtype(part.dtype)
        a, b = part.columns
        line = part.width * dtype.itemsize
        narrow = (b - a) * dtype.itemsize * 8 < line  # few columns: their bytes of each row alone
        step = max(1, BATCH_BYTES // max(line, 1))
        runs = [(w, w + 1) for w in part.wanted] if part.wanted is not None else [(i, min(i + step, part.last)) for i in range(part.first, part.last, step)]
        with system.open_input_file(part.file) as f:
            for i, j in runs:
                if narrow:
                    data = b"".join(f.read_at((b - a) * dtype.itemsize, part.offset + r * line + a * dtype.itemsize) for r in range(i, j))
                    x = np.frombuffer(data, dtype).reshape(j - i, b - a)
                else:
                    x = np.frombuffer(f.read_at((j - i) * line, part.offset + i * line), dtype).reshape(j - i, part.width)[:, a:b]
                flat = pa.array(np.ascontiguousarray(x, np.float64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * (b - a)), flat)
                yield pa.RecordBatch.from_arrays([pa.array([part.file] * (j - i)), pa.array(np.arange(i, j)), lists], ["file", "row", "vector"])


class FilteringReader(NpyReader):
    """Spark refuses a reader with this method where its setting is off."""

    def pushFilters(self, filters):
        """Takes what it can of conditions on ``row``; Spark checks all again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("row",):
                low, high = {GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, 0), LessThanOrEqual: (None, 1), EqualTo: (0, 1)}.get(type(f), (None, None))
                if low is not None:
                    self.least = max(self.least, f.value + low)
                if high is not None:
                    self.most = min(f.value + high, self.most if self.most is not None else f.value + high)
                if isinstance(f, In):
                    self.wanted = tuple(sorted(set(f.value) & set(self.wanted if self.wanted is not None else f.value)))
            yield f


class NpySource(DataSource):
    @classmethod
    def name(cls):
        return "npy_slices"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        options = {k.lower(): v for k, v in self.options.items()}
        return (FilteringReader if options.get("pushdown") == "true" else NpyReader)(options)


def npy_slices(spark, path: str, rows: str | None = None, columns: str | None = None):
    """``file, row, vector`` of the ranges asked for of the matrices below ``path``."""
    spark.dataSource.register(NpySource)
    read = spark.read.format("npy_slices").option("pushdown", spark.conf.get(PUSHDOWN, "false"))
    for k, v in (("rows", rows), ("columns", columns)):
        read = read.option(k, v) if v else read
    return read.load(path)
