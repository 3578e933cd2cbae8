"""Files of packed vectors as a Spark data source that reads ranges of bytes: fvecs, ivecs and bvecs (each vector an int32
dimension and its components) and raw files of float32 (components only, the dimension given)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

ITEM = {"fvecs": "<f4", "ivecs": "<i4", "bvecs": "u1", "raw": "<f4"}
READ_BYTES = 4 << 20


@dataclass
class Part(InputPartition):
    """Vectors first..first + n - 1 of one file, the first of which is number `vec_id` over all files."""

    file: str
    first: int
    n: int
    vec_id: int
    dim: int


def _files(paths: list[str]) -> list[str]:
    """Files by name; a folder stands for its files whose names do not begin with a dot or underscore."""
    found = []
    for path in paths:
        fs, at = pafs.FileSystem.from_uri(path)
        scheme = path.split("://")[0] + "://" if "://" in path else ""
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == pafs.FileType.File:
            found.append(path)
        else:
            inside = [i for i in fs.get_file_info(pafs.FileSelector(at)) if i.type == pafs.FileType.File and not i.base_name.startswith((".", "_"))]
            found += sorted(f"{scheme}{i.path}" for i in inside)
    return found


class VecsReader(DataSourceReader):
    def __init__(self, paths: list[str], kind: str, dim: int, rows: int):
        self.paths, self.kind, self.dim, self.rows = paths, kind, dim, rows
        self.low, self.high = 0, None

    def pushFilters(self, filters):
        """Bounds on vec_id choose the bytes that are read; all other filters are left to Spark."""
        for f in filters:
            on_id = isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("vec_id",) and isinstance(f.value, int)
            if not on_id:
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                end = f.value + (not isinstance(f, LessThan))
                self.high = end if self.high is None else min(self.high, end)

    def _record(self, dim: int) -> int:
        return dim * np.dtype(ITEM[self.kind]).itemsize + (0 if self.kind == "raw" else 4)

    def partitions(self) -> list[Part]:
        parts, before = [], 0
        for file in _files(self.paths):
            fs, at = pafs.FileSystem.from_uri(file)
            size, dim = fs.get_file_info(at).size, self.dim
            if not size:
                continue
            if self.kind != "raw":
                with fs.open_input_file(at) as f:
                    dim = int(np.frombuffer(f.read(4), "<i4")[0])
            if dim <= 0 or size % self._record(dim):
                raise ValueError(f"{file}: {size} bytes are no whole number of vectors of {dim} components")
            n = size // self._record(dim)
            low, high = max(0, self.low - before), n if self.high is None else min(n, self.high - before)
            parts += [Part(file, i, min(self.rows, high - i), before + i, dim) for i in range(low, high, self.rows)]
            before += n
        return parts

    def read(self, part: Part):
        if part is None:
            return
        fs, at = pafs.FileSystem.from_uri(part.file)
        size, head = self._record(part.dim), 0 if self.kind == "raw" else 4
        step = max(1, READ_BYTES // size)
        with fs.open_input_file(at) as f:
            for done in range(0, part.n, step):
                n = min(step, part.n - done)
                f.seek((part.first + done) * size)
                rows = np.frombuffer(f.read(n * size), np.uint8).reshape(n, size)
                if head and (np.ascontiguousarray(rows[:, :4]).view("<i4") != part.dim).any():
                    raise ValueError(f"{part.file}: vectors have different numbers of components")
                x = np.ascontiguousarray(rows[:, head:]).view(ITEM[self.kind]).astype(np.float32)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * part.dim)
                number = np.arange(done, done + n)
                yield pa.RecordBatch.from_arrays([pa.array([part.file] * n), pa.array(part.first + number), pa.array(part.vec_id + number), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["file", "position", "vec_id", "embedding"])


class VecsDataSource(DataSource):
    """Options: paths (separated by line ends), kind, dim (of raw files), rows (vectors a task)."""

    @classmethod
    def name(cls) -> str:
        return "vecs"

    def schema(self) -> str:
        return "file string, position bigint, vec_id bigint, embedding array<float>"

    def reader(self, schema) -> VecsReader:
        o = self.options
        kind = o.get("kind", "fvecs")
        if kind not in ITEM or kind == "raw" and int(o.get("dim", 0)) <= 0:
            raise ValueError(f"kind is one of {', '.join(ITEM)}; raw files need dim")
        return VecsReader(o["paths"].split("\n"), kind, int(o.get("dim", 0)), int(o.get("rows", 100_000)))


def read(spark: SparkSession, paths: list[str] | str, kind: str = "fvecs", dim: int = 0, rows: int = 100_000) -> DataFrame:
    """(file, position, vec_id, embedding) of one or many files or folders. Positions count in each file, vec_id over all
    files in the order given. A task reads at most `rows` vectors, a few megabytes at a time, so files may be of any size;
    a filter that bounds vec_id opens only the files and reads only the bytes that it wants. Empty files have no vectors;
    a file that is cut off, or whose vectors differ in length, raises."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VecsDataSource)
    listed = [paths] if isinstance(paths, str) else paths
    return spark.read.format("vecs").options(paths="\n".join(listed), kind=kind, dim=dim, rows=rows).load()


def write(rows: DataFrame, folder: str, kind: str = "fvecs") -> list[str]:
    """Write embeddings as vector files under `folder` (a URI that executors reach), in order of vec_id, and return their
    paths in that order: one a task, named anew by each attempt, so that what a lost one leaves is not among them. Null
    vectors are left out; all others must have one length."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name, out, first, n = f"{uuid.uuid4().hex}.{kind}", None, None, 0
        for batch in batches:
            if batch.num_rows:
                column = batch.column("embedding")
                x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(ITEM[kind])
                out = out or fs.open_output_stream(f"{root.rstrip('/')}/{name}", compression=None)
                first = batch.column("vec_id")[0].as_py() if first is None else first
                n += len(x)
                head = np.full((len(x), 1), x.shape[1], "<i4").view(np.uint8)
                body = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)
                out.write((body if kind == "raw" else np.concatenate([head, body], axis=1)).tobytes())
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}"]), pa.array([first]), pa.array([n])], ["file", "first", "n"])

    used = rows.where("embedding is not null").select("vec_id", "embedding")
    done = used.repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInArrow(run, "file string, first long, n long")
    return [r.file for r in sorted(done.collect(), key=lambda r: r.first)]  # one row a file
