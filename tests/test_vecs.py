"""Vector files in ranges of bytes: many tasks for one file, slices over files, filters that choose bytes, damaged files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.sources import vecs

pytestmark = pytest.mark.seconds(120)


def lay(path, x, kind="fvecs"):
    x = x.astype(vecs.ITEM[kind])
    head = np.full((len(x), 1), x.shape[1], "<i4").view(np.uint8)
    body = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.shape[1] * x.itemsize)
    path.write_bytes((body if kind == "raw" else np.concatenate([head, body], axis=1)).tobytes())


def test_ranges_over_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1000, 5)).astype(np.float32)
    for i, (a, b) in enumerate([(0, 700), (700, 700), (700, 1000)]):
        lay(tmp_path / f"{i}.fvecs", x[a:b])
    (tmp_path / "_skip").write_bytes(b"no vectors")
    whole = vecs.read(spark, f"file://{tmp_path}", rows=100)
    assert whole.rdd.getNumPartitions() == 10
    got = whole.orderBy("vec_id").collect()
    assert [r.vec_id for r in got] == list(range(1000)) and np.array_equal(np.array([r.embedding for r in got], np.float32), x)
    assert [r.position for r in got] == [*range(700), *range(300)]
    some = whole.where("vec_id >= 650 and vec_id < 730")
    assert some.rdd.getNumPartitions() == 2  # the end of the first file and the beginning of the third
    assert [r.vec_id for r in some.orderBy("vec_id").collect()] == list(range(650, 730))
    assert [r.vec_id for r in whole.where("vec_id = 705 and position > 1").collect()] == [705]
    assert whole.where("vec_id > 5 and vec_id <= 8 and embedding[0] is not null").count() == 3
    assert whole.where("vec_id > 2000").count() == whole.where("vec_id < 0").count() == 0


def test_reader_reads_only_its_bytes(tmp_path):
    """The parts that a bounded reader plans lie inside the bounds, and what is outside is never touched: it is garbage here."""
    x = np.arange(60).reshape(20, 3)
    lay(tmp_path / "a.raw", x, "raw")
    content = bytearray((tmp_path / "a.raw").read_bytes())
    content[: 8 * 12] = b"\xff" * 96
    (tmp_path / "a.raw").write_bytes(content)
    reader = vecs.VecsReader([str(tmp_path / "a.raw")], "raw", 3, 5)
    left = list(reader.pushFilters([vecs.GreaterThan(("vec_id",), 7), vecs.LessThan(("vec_id",), 15), vecs.EqualTo(("file",), "x")]))
    assert len(left) == 1
    parts = reader.partitions()
    assert [(p.first, p.n) for p in parts] == [(8, 5), (13, 2)]
    got = np.concatenate([b.column("embedding").flatten().to_numpy() for p in parts for b in reader.read(p)])
    assert np.array_equal(got.reshape(-1, 3), x[8:15])


def test_kinds_and_damage(spark, tmp_path):
    for kind, values in (("ivecs", [[7, -3]]), ("bvecs", [[255, 0], [1, 2]]), ("raw", [[0.5, 2.0]])):
        lay(tmp_path / f"x.{kind}", np.array(values), kind)
        got = vecs.read(spark, f"file://{tmp_path}/x.{kind}", kind, dim=2).orderBy("position").collect()
        assert [r.embedding for r in got] == values
    lay(tmp_path / "cut.fvecs", np.ones((3, 4)))
    (tmp_path / "cut.fvecs").write_bytes((tmp_path / "cut.fvecs").read_bytes()[:-1])
    mixed = (tmp_path / "x.ivecs").read_bytes() * 2 + np.array([1, 5, 5], "<i4").tobytes()
    (tmp_path / "mixed.ivecs").write_bytes(mixed)
    for name, kind in (("cut.fvecs", "fvecs"), ("mixed.ivecs", "ivecs"), ("missing.fvecs", "fvecs"), ("x.raw", "raw")):
        with pytest.raises(Exception, match="vectors|dim|missing"):
            vecs.read(spark, f"file://{tmp_path}/{name}", kind).collect()


def test_written_and_read_back(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("vec_id"), F.array(F.col("id") / 2, F.lit(1.0)).alias("embedding")).unionByName(spark.createDataFrame([(1000, None)], "vec_id long, embedding array<double>"))
    for kind in ("fvecs", "raw"):
        files = vecs.write(rows.repartition(7), f"file://{tmp_path}/{kind}", kind)
        got = vecs.read(spark, files, kind, dim=2, rows=60).orderBy("vec_id").collect()
        assert [(r.vec_id, r.embedding) for r in got] == [(i, [i / 2, 1.0]) for i in range(500)]
    assert vecs.write(rows.limit(0), f"file://{tmp_path}/none") == []
