"""Matrix Market files as graphs, and complex ones as entries with two values."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pairwright.plans.schema import ARCS
from pairwright.plans.storage import Scratch
from pairwright.sources.files import Joined, listed, opened

#: Fixed values of the format: what a banner may say.
BANNER = "%%MatrixMarket"
LAYOUTS = ("coordinate", "array")
FIELDS = ("real", "complex", "pattern", "integer")
SYMMETRIES = ("general", "symmetric", "skew-symmetric", "hermitian")
SPLIT_BYTES = 16 << 20
READ_BYTES = 4 << 20
#: Entries of a matrix of any field.
ENTRIES = "src long, dst long, re double, im double"


def _true(option) -> bool:
    return str(option).lower() == "true"


@dataclass(frozen=True)
class Kind:
    layout: str
    field: str
    symmetry: str

    @property
    def valid(self) -> bool:
        """Dense patterns, real or integer hermitian and pattern hermitian or skew matrices make no sense."""
        if self.layout not in LAYOUTS or self.field not in FIELDS or self.symmetry not in SYMMETRIES:
            return False
        if self.layout == "array" and self.field == "pattern":
            return False
        if self.symmetry == "hermitian" and self.field != "complex":
            return False
        return not (self.field == "pattern" and self.symmetry == "skew-symmetric")

    @property
    def sparse(self) -> bool:
        return self.layout == "coordinate"

    def banner(self) -> str:
        return f"{BANNER} matrix {self.layout} {self.field} {self.symmetry}\n"


@dataclass(frozen=True)
class Header:
    kind: Kind
    rows: int
    columns: int
    entries: int
    body: int  # offset of the first line after the sizes


def parse_banner(line: str) -> Kind:
    words = line.split()
    if len(words) != 5 or words[0] != BANNER or words[1].lower() != "matrix":
        raise ValueError("no Matrix Market banner")
    kind = Kind(*(w.lower() for w in words[2:]))
    if not kind.valid:
        raise ValueError(f"invalid matrix type: {line.strip()}")
    return kind


def read_header(file: Joined) -> Header:
    data, at = file.read(0, 1 << 16), 0

    def line() -> str:
        nonlocal data, at
        while (end := data.find(b"\n", at)) < 0 and len(data) < file.size:
            data += file.read(len(data), 1 << 16)
        end = len(data) if end < 0 else end + 1
        text, at = data[at:end].decode("latin-1"), end
        return text

    kind = parse_banner(line())
    while (text := line()).startswith("%") or not text.strip() and at < len(data):
        pass
    sizes = [int(x) for x in text.split()]
    if len(sizes) != 2 + kind.sparse:
        raise ValueError("no size line")
    return Header(kind, sizes[0], sizes[1], sizes[2] if kind.sparse else sizes[0] * sizes[1], at)


class Bytes(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class MtxSource(DataSource):
    """``spark.read.format("mtx").load(path)``: arcs ``src, dst, w`` with ids from 0.

    A pattern's weights are 1. Symmetric matrices are mirrored off the diagonal, skew ones with the sign
    changed, unless option ``mirror`` is false. Complex matrices are no graphs: with option ``complex`` a matrix of any field is read as
    ``src, dst, re, im`` instead, where hermitian ones are mirrored as conjugates.
    """

    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return ENTRIES if _true(self.options.get("complex", "false")) else ARCS

    def reader(self, schema) -> DataSourceReader:
        return MtxReader(self.options)


class MtxReader(DataSourceReader):
    def __init__(self, options, dense: bool = False):
        self.file = Joined(listed(options["path"]))
        self.header = read_header(self.file)
        self.mirror, self.complex = _true(options.get("mirror", "true")), _true(options.get("complex", "false"))
        self.split = int(options.get("split", SPLIT_BYTES))
        if self.header.kind.field == "complex" and not self.complex:
            raise ValueError("complex matrices are no graphs: read_complex reads them")
        if not self.header.kind.sparse and not dense:
            raise ValueError("a dense matrix: use read_dense")

    def partitions(self) -> list[Bytes]:
        at = range(self.header.body, self.file.size, self.split)
        return [Bytes(a, min(a + self.split, self.file.size)) for a in at] or [Bytes(self.header.body, self.header.body)]

    def read(self, partition: Bytes):
        for lines in self.lines(partition.start, partition.end):
            yield from self._arcs(lines)

    def lines(self, start: int, end: int):
        """The lines that begin in a range, some at a time."""
        rest = b""
        if start > self.header.body and start < end:
            back = self.file.read(start - 1, 1)
            while back != b"\n":  # the line that is under way belongs to the range before
                part = self.file.read(start, 4096)
                if not part:
                    return
                cut = part.find(b"\n")
                start += cut + 1 if cut >= 0 else len(part)
                back = b"\n" if cut >= 0 else back
        while start < end:
            rest = self.file.read(start, min(READ_BYTES, end - start))
            start += len(rest)
            if start >= end and not rest.endswith(b"\n"):
                while (part := self.file.read(start, 4096)) and (cut := part.find(b"\n")) < 0:
                    rest, start = rest + part, start + len(part)
                rest += part[: cut + 1] if part else b""
            elif not rest.endswith(b"\n"):
                cut = rest.rfind(b"\n") + 1
                if not cut:
                    raise ValueError("a line is too long")
                start -= len(rest) - cut
                rest = rest[:cut]
            yield rest

    def _arcs(self, data: bytes):
        lines = [x for x in data.split(b"\n") if x.strip() and not x.lstrip().startswith(b"%")]
        if not lines:
            return
        kind = self.header.kind
        width = {"pattern": 2, "complex": 4}.get(kind.field, 3)
        words = b" ".join(lines).split()
        if len(words) != width * len(lines):
            raise ValueError("an entry has not the number of values that the banner says")
        src = np.array(words[0::width]).astype(np.int64) - 1
        dst = np.array(words[1::width]).astype(np.int64) - 1
        w = np.ones(len(src)) if width == 2 else np.array(words[2::width]).astype(np.float64)
        im = np.array(words[3::width]).astype(np.float64) if width == 4 else np.zeros(len(src))
        if self.mirror and kind.symmetry != "general":
            src, dst, w, im = _mirrored(kind.symmetry, src, dst, w, im)
        values = [w, im] if self.complex else [w]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (src, dst, *values)], ["src", "dst", "re", "im"] if self.complex else ["src", "dst", "w"])


def _mirrored(symmetry: str, src, dst, re, im) -> tuple:
    """Entries and, off the diagonal, their mirror images: the same, the negative, or the conjugate."""
    off = src != dst
    a, b = {"symmetric": (1.0, 1.0), "skew-symmetric": (-1.0, -1.0), "hermitian": (1.0, -1.0)}[symmetry]
    return np.append(src, dst[off]), np.append(dst, src[off]), np.append(re, a * re[off]), np.append(im, b * im[off])


def read_mtx(spark: SparkSession, path: str, mirror: bool = True, split: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(MtxSource)
    return spark.read.format("mtx").option("mirror", mirror).option("split", split).load(path)


def read_complex(spark: SparkSession, path: str, mirror: bool = True, split: int = SPLIT_BYTES) -> DataFrame:
    """``src, dst, re, im`` of a coordinate matrix of any field."""
    spark.dataSource.register(MtxSource)
    return spark.read.format("mtx").option("mirror", mirror).option("split", split).option("complex", True).load(path)


def _values(data: bytes) -> np.ndarray:
    return np.array(b" ".join(x for x in data.split(b"\n") if not x.lstrip().startswith(b"%")).split()).astype(np.float64)


def _dealt(ranges: DataFrame, n: int) -> DataFrame:
    """Byte ranges over as many tasks. By number, as the adaptive planner would make one task of rows this small; the first
    pass deals them as the second does."""
    return ranges.repartition(max(1, min(n, 10_000)))


def read_dense(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """Arcs of a matrix in array layout: column by column, of symmetric ones the lower half, which is mirrored.
    Entries that are zero are no arcs. A complex matrix gives ``src, dst, re, im``.

    Two passes over byte ranges: the first counts values, so that in the second each range knows its first index.
    """
    reader = MtxReader({"path": path, "split": split, "complex": True}, dense=True)
    kind, n = reader.header.kind, reader.header.rows
    parts = reader.partitions()
    ranges = spark.createDataFrame([(i, p.start, p.end) for i, p in enumerate(parts)], "part int, start long, end long")
    two = kind.field == "complex"

    def count(batches):
        for batch in batches:
            sizes = [sum(len(_values(x)) for x in reader.lines(a, b)) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["part", "n"])

    sizes = dict(_dealt(ranges, len(parts)).mapInArrow(count, "part int, n long").collect())
    first = np.concatenate([[0], np.cumsum([sizes[i] for i in range(len(sizes))])]).tolist()
    columns = np.arange(reader.header.columns, dtype=np.int64)
    lower = 0 if kind.symmetry == "general" else 1
    skew = kind.symmetry == "skew-symmetric"
    starts = columns * n if not lower else columns * (n - skew) - columns * (columns - 1) // 2

    def values(batches):
        for batch in batches:
            for part, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                at, odd = first[part], np.zeros(0)
                for data in reader.lines(a, b):
                    w = _values(data)
                    if two:  # both values stand on one line, so pairs are never cut between ranges
                        w = np.append(odd, w)
                        odd, w = w[len(w) // 2 * 2 :], w[: len(w) // 2 * 2]
                        index = np.arange(at // 2, at // 2 + len(w) // 2)
                        at += len(w)
                        w, im = w[0::2], w[1::2]
                    else:
                        index, im = np.arange(at, at + len(w)), np.zeros(len(w))
                        at += len(w)
                    column = np.searchsorted(starts, index, "right") - 1
                    row = index - starts[column] + (column + skew if lower else 0)
                    here = (w != 0) | (im != 0)
                    found = row[here], column[here], w[here], im[here]
                    if lower:
                        found = _mirrored(kind.symmetry, *found)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found[: 4 if two else 3]], ["src", "dst", "re", "im"] if two else ["src", "dst", "w"])

    return _dealt(ranges, len(parts)).mapInArrow(values, ENTRIES if two else ARCS)


def properties(spark: SparkSession, path: str) -> DataFrame:
    """One row: rows, columns, and the entries there are after mirroring."""
    header = read_header(Joined(listed(path)))
    stored = read_complex(spark, path, mirror=False)
    both = header.kind.symmetry != "general"
    n = F.count("*") * 2 - F.count_if(F.col("src") == F.col("dst")) if both else F.count("*")
    return stored.agg(F.lit(header.rows).cast("long").alias("n_rows"), F.lit(header.columns).cast("long").alias("n_columns"), n.alias("nnz"))


def _half(df: DataFrame, symmetry: str) -> DataFrame:
    """What is stored of a matrix: all, or the lower half, of skew ones without the diagonal."""
    return df if symmetry == "general" else df.filter("src > dst") if symmetry == "skew-symmetric" else df.filter("src >= dst")


def write_mtx(arcs: DataFrame, path: str, n: int, field: str = "real", symmetry: str = "general", columns: int | None = None) -> None:
    """Write arcs with ids 0..n-1 as a folder whose files make a Matrix Market file when joined: a header and a part a task.
    Arcs of field ``complex`` are ``src, dst, re, im``.

    Of a symmetric or hermitian matrix only the arcs with src >= dst are written. The text goes through Spark's own writer.
    """
    spark = arcs.sparkSession
    kind = Kind("coordinate", field, symmetry)
    if not kind.valid:
        raise ValueError("this kind can't be written")
    ends = [F.col("src") + 1, F.col("dst") + 1]
    value = {
        "real": lambda: F.format_string("%d %d %s", *ends, F.col("w").cast("string")),
        "integer": lambda: F.format_string("%d %d %d", *ends, F.col("w").cast("long")),
        "pattern": lambda: F.format_string("%d %d", *ends),
        "complex": lambda: F.format_string("%d %d %s %s", *ends, F.col("re").cast("string"), F.col("im").cast("string")),
    }[field]()
    text = Scratch(spark, "mtx").write(_half(arcs, symmetry).select(value.alias("value")), "text")
    text.write.mode("overwrite").text(path)
    with opened(f"{path}/0-header.mtx", "wb") as f:
        f.write((kind.banner() + f"{n} {columns or n} {text.count()}\n").encode())


def write_dense(arcs: DataFrame, path: str, n: int, field: str = "real", symmetry: str = "general", columns: int | None = None) -> None:
    """Write arcs, each pair of ends once, as a matrix in array layout, column by column; where there is no arc stands 0.

    All positions are made by the cluster, range partitioned by their place in the file, so that each task writes a
    part of its own. The files, by name, are in order.
    """
    spark, columns = arcs.sparkSession, columns or n
    kind = Kind("array", field, symmetry)
    if not kind.valid:
        raise ValueError("this kind can't be written")
    names = ["re", "im"] if field == "complex" else ["w"]
    cells = _half(spark.range(n * columns).select((F.col("id") % n).alias("src"), F.expr(f"id div {n}").alias("dst")), symmetry)
    text = lambda c: F.coalesce(F.col(c).cast("long" if field == "integer" else "double"), F.lit(0)).cast("string")
    lines = cells.join(arcs.select("src", "dst", *names), ["src", "dst"], "left").select("src", "dst", F.concat_ws(" ", *map(text, names)).alias("value"))
    lines.repartitionByRange("dst", "src").sortWithinPartitions("dst", "src").select("value").write.mode("overwrite").text(path)
    with opened(f"{path}/0-header.mtx", "wb") as f:
        f.write((kind.banner() + f"{n} {columns}\n").encode())
