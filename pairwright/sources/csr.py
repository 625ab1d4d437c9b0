"""Binary compressed-row graphs.

Little-endian: nv, ne (int64), nv + 1 arc offsets (int64), then an arc record {target int64, weight double}, or with
option ``pairs`` {source int64, target int64, weight double}. A graph is one file, or a folder whose files, by
name, make one when joined: what :func:`write_csr` leaves, so that no task writes more than its part.
"""

from __future__ import annotations

import struct
import uuid
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pairwright.operators.graph import running_sum
from pairwright.plans.schema import ARCS
from pairwright.plans.storage import Scratch
from pairwright.sources.files import Joined, listed, opened

HEADER = 16
READ_ARCS = 1 << 18


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class CsrSource(DataSource):
    """``spark.read.format("csr").option("parts", 8).load(path)``: arcs ``src, dst, w``."""

    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return ARCS

    def reader(self, schema) -> DataSourceReader:
        return CsrReader(self.options)


class CsrReader(DataSourceReader):
    def __init__(self, options):
        self.file = Joined(listed(options["path"]))
        self.record = 24 if str(options.get("pairs", "false")).lower() == "true" else 16
        self.parts = int(options.get("parts", 8))
        self.nv, ne = struct.unpack("<qq", self.file.read(0, HEADER))
        self.base = self._offset(0)
        self.ne = self._offset(self.nv) - self.base
        if self.nv < 0 or HEADER + 8 * (self.nv + 1) + self.record * self.ne > self.file.size:
            raise ValueError("not a graph, or cut short")
        if ne != self.ne:
            warnings.warn(f"the header says {ne} arcs, the offsets {self.ne}; the offsets count", stacklevel=2)

    def _offset(self, v: int) -> int:
        return struct.unpack("<q", self.file.read(HEADER + 8 * v, 8))[0]

    def partitions(self) -> list[Range]:
        """Ranges of arcs, all as long: a hub's arcs lie in many of them."""
        cuts = [i * self.ne // self.parts for i in range(self.parts + 1)]
        return [Range(a, b) for a, b in zip(cuts, cuts[1:]) if a < b] or [Range(0, 0)]

    def _vertex_of(self, arc: int) -> int:
        """Whose range of arcs holds this one: a binary search of the offsets."""
        low, high = 0, self.nv
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if self._offset(mid) - self.base <= arc else (low, mid)
        return low

    def read(self, partition: Range):
        start = HEADER + 8 * (self.nv + 1)
        kind = np.dtype([("src", "<i8")] * (self.record == 24) + [("dst", "<i8"), ("w", "<f8")])
        for at in range(partition.first, partition.last, READ_ARCS):
            n = min(READ_ARCS, partition.last - at)
            arcs = np.frombuffer(self.file.read(start + self.record * at, self.record * n), kind)
            a, b = self._vertex_of(at), self._vertex_of(at + n - 1)
            offsets = np.frombuffer(self.file.read(HEADER + 8 * a, 8 * (b - a + 1)), "<i8") - self.base
            src = a + np.searchsorted(offsets, np.arange(at, at + n), "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(src.astype(np.int64)), pa.array(np.ascontiguousarray(arcs["dst"])), pa.array(np.ascontiguousarray(arcs["w"]))], ["src", "dst", "w"])


def read_csr(spark: SparkSession, path: str, parts: int = 8, pairs: bool = False) -> DataFrame:
    spark.dataSource.register(CsrSource)
    return spark.read.format("csr").option("parts", parts).option("pairs", pairs).load(path)


def write_csr(arcs: DataFrame, path: str, vertices: int | None = None, pairs: bool = False) -> None:
    """Write arcs with ids 0..vertices-1 (by default up to the largest) as a folder of parts.

    Degrees and arcs are range-partitioned by source and written side by side; the driver sees only part names.
    """
    spark = arcs.sparkSession
    scratch = Scratch(spark, "csr")
    if vertices is None:
        vertices = arcs.agg(F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0))).first()[0]
    degrees = spark.range(vertices).join(arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")), "id", "left").fillna(0)
    ends = running_sum(degrees, ["id"], "n", "end").select("id", F.col("end").cast("long").alias("end"))
    numbers = scratch.write(ends.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(_part(path, "1-offsets", "offset"), "name string, part int, n long"), "numbers")
    ordered = arcs.select("src", "dst", F.col("w").cast("double").alias("w")).repartitionByRange("src", "dst", "w").sortWithinPartitions("src", "dst", "w")
    records = scratch.write(ordered.mapInArrow(_part(path, "2-arcs", "pairs" if pairs else "arcs"), "name string, part int, n long"), "records")
    total = records.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    with opened(f"{path}/0-header.csr", "wb") as f:
        f.write(struct.pack("<qqq", vertices, total, 0))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for rows in (numbers, records):  # only files of tasks that ended get a name that counts
        for x in rows.collect():
            old = jvm.org.apache.hadoop.fs.Path(f"{path}/.{x.name}")
            old.getFileSystem(conf).rename(old, jvm.org.apache.hadoop.fs.Path(f"{path}/{x.name.split('.')[0]}-{x.part:06d}.csr"))
    scratch.drop(numbers, records)


def _part(path: str, label: str, kind: str):
    def run(batches):
        from pyspark import TaskContext

        part, name, n = TaskContext.get().partitionId(), f"{label}.{uuid.uuid4().hex}", 0
        with opened(f"{path}/.{name}", "wb") as f:
            for batch in batches:
                columns = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
                n += batch.num_rows
                if kind == "offset":
                    f.write(columns[1].astype("<i8").tobytes())
                else:
                    names = ["src", "dst", "w"] if kind == "pairs" else ["dst", "w"]
                    out = np.empty(batch.num_rows, [(c, "<f8" if c == "w" else "<i8") for c in names])
                    for c in names:
                        out[c] = columns[["src", "dst", "w"].index(c)]
                    f.write(out.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([n])], ["name", "part", "n"])

    return run
