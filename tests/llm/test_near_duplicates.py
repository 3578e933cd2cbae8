"""SimHash, suffix and embedding dedup against plain versions."""

import os
import random
from itertools import combinations

import numpy as np
import pytest

from tests.compare import assert_same, duck, rows_of
from tests.llm.brute import components, fingerprint, suffix_repeats
from vectide.llm import pq_dedup, registry, simhash, suffix_dedup

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.seconds(180)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, id long, k long, `row` string, component_id long, size int, copies int"


def table(spark, texts, schema=SCHEMA):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "web", len(t or ""), 1, 2, 3, "x", 4, 5, 6) for i, t in texts], schema)


def texts(n=120, seed=1):
    rng = random.Random(seed)
    words = [f"word{i}é" if i % 9 == 0 else f"Word{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    out = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE TWO"), (5, passage + " " + " ".join(rng.choices(words, k=20_000)))]
    for i in range(6, n):
        t = " ".join(rng.choices(words, k=rng.randint(5, 300)))
        if i % 5 == 0:
            t = out[i - 1][1]
        elif i % 7 == 0:
            t = out[i - 2][1] + " tail"
        elif i % 4 == 0:
            t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
        out.append((i, t))
    return out


def test_simhash(spark):
    docs = texts()
    fps = {i: fingerprint(t) for i, t in docs}
    root = components(fps, [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    got = simhash.simhash_groups(table(spark, docs)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", root[i]) for i in fps}
    kept = simhash.near_dedup(table(spark, docs))
    assert kept.columns == table(spark, docs[:1]).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))


def test_simhash_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: fingerprint(r.text) for r in docs}
    root = components(fps, [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    got = registry.op3_simhash(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", root[i]) for i in fps}


def test_hot_blocks_lose_no_link(spark):
    """One block value for all fingerprints, cut into tiles."""
    rng = np.random.default_rng(0)
    fps = np.unique((rng.integers(0, 1 << 12, 700) << 40).astype(np.int64))
    df = spark.createDataFrame([(int(f), int(f)) for f in fps], "fp long, id long")
    found = simhash.close_links(df, 4, tile=50).collect()
    links = [(int(a), int(b)) for a, b in combinations(fps.tolist(), 2) if (a ^ b).bit_count() <= 4]
    ids = fps.tolist()
    assert components(ids, [(r.a, r.b) for r in found]) == components(ids, links)


def test_suffix_dedup(spark):
    docs = texts()
    wanted = suffix_repeats(docs)
    for hot in (20_000, 10):
        got = suffix_dedup.repeats(table(spark, docs), hot=hot).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == wanted
    cut = suffix_dedup.without_repeats(table(spark, docs))
    assert cut.columns == table(spark, docs[:1]).columns
    assert {r.doc_id for r in cut.collect()} == set(wanted)


def test_suffix_dedup_on_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.op8_suffix_dedup(spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == suffix_repeats(docs)


def test_suffix_sort():
    rng = random.Random(2)
    items = [bytes(rng.choices(b"ab", k=rng.randint(0, 9))) for _ in range(300)]
    group = np.sort(np.array([rng.randint(0, 5) for _ in items]))
    size = np.array([len(x) for x in items])
    order, shared = suffix_dedup.suffix_sort(np.frombuffer(b"".join(items), np.uint8), np.cumsum(size) - size, size, group)
    assert [(group[i], items[i]) for i in order] == sorted((group[i], items[i]) for i in range(300))
    for a, b, n in zip(order, order[1:], shared[1:]):
        same = group[a] == group[b]
        assert n == (len(os.path.commonprefix([items[a], items[b]])) if same else 0)


def test_suffix_dedup_when_digests_collide(spark):
    """Digests only bring suffixes together: of one byte they collide, and the bytes still decide."""
    docs = texts(60)
    wanted = suffix_repeats(docs)
    for hot in (20_000, 10):
        got = suffix_dedup.repeats(table(spark, docs), hot=hot, digest_size=1).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == wanted


def test_suffix_dedup_of_one_repeating_text(spark):
    """One text that repeats itself many times, and a later copy of a part of it."""
    line = "the same line again and again, longer than fifty bytes by far. "
    docs = [(1, line * 3000), (2, "x" * 3000), (3, line * 5), (4, "x" * 60), (5, "é" * 2000), (6, "y" + "é" * 40)]
    got = suffix_dedup.repeats(table(spark, docs), hot=50).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == suffix_repeats(docs)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    v = np.repeat(base, 8, axis=0) + rng.normal(size=(480, 16)) * rng.choice([0, 0.1, 0.2, 0.5], size=(480, 1))
    rows = [(i, [float(x) for x in a], 0, 1, 2) for i, a in enumerate(v.astype(np.float32))]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16]
    rows += [(1000 + i, a, 0, 1, 2) for i, a in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long, cls long, component_id long")
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    got = {r.vec_id: r for r in pq_dedup.near_duplicates(df, list_size=40, tile=64).collect()}
    assert len(got) == len(rows)
    assert all(got[1000 + i].n_links == 0 and got[1000 + i].kept for i in range(len(odd)))
    links = np.array([got[i].n_links for i in range(480)])
    assert (links <= close.sum(1)).all() and links.sum() >= 0.99 * close.sum()


def test_embeddings_of_many_lists(spark):
    """10,000 vectors of 64 dimensions in a hundred lists, with links: every count and component against all pairs."""
    rng = np.random.default_rng(0)
    base = rng.normal(size=(1250, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    v = (np.repeat(base, 8, axis=0) + rng.normal(size=(10_000, 64)) * rng.uniform(0, 0.05, size=(10_000, 1))).astype(np.float32)
    v[5000], v[7000] = v[4000], v[4000]  # repeated rows
    df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<float>").repartition(8)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    close = u @ u.T >= 0.95
    np.fill_diagonal(close, False)
    x, y = np.nonzero(np.triu(close))
    root = components(range(10_000), zip(x.tolist(), y.tolist()))
    for slack in (1.0, 0.5):
        got = {r.vec_id: r for r in pq_dedup.near_duplicates(df, slack=slack, list_size=100, tile=256).collect()}
        links = np.array([got[i].n_links for i in range(10_000)])
        print("pq: slack", slack, "links found", links.sum(), "of", close.sum())
        assert (links <= close.sum(1)).all() and links.sum() >= 0.99 * close.sum()
        if slack == 1:
            assert (links == close.sum(1)).all() and all(got[i].component_id == root[i] for i in root)


def test_embeddings_of_several_lengths(spark):
    """Each length is searched by itself; repeated and null ids."""
    rows = [(i, [1.0, i / 100]) for i in range(20)] + [(100, [3.0, 2.0, 1.0]), (101, [3.0, 2.0, 1.001]), (102, [-3.0, 2.0, 1.0]), (103, [2.0]), (103, [2.0]), (None, [5.0]), (104, [-2.0])]
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in pq_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    two = [(i, 19, 0, i == 0) for i in range(20)]
    assert got == [(-1, 2, 103, False), *two, (100, 1, 100, True), (101, 1, 100, False), (102, 0, 102, True), (103, 2, 103, True), (103, 2, 103, True), (104, 0, 104, True)]


def test_embeddings_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert_same(rows_of(registry.op1_pq_near_dedup(spark, sf)), duck(sf, pq_dedup.ORACLE, ["embeddings"]))


def test_empty_tables(spark):
    none = table(spark, [])
    assert simhash.simhash_groups(none).count() == simhash.near_dedup(none).count() == 0
    assert suffix_dedup.repeats(none).count() == suffix_dedup.without_repeats(none).count() == 0
    assert pq_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = table(spark, [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e " * 30), (3, "a b c d e " * 30)])
    assert simhash.simhash_groups(docs).count() == 5
    got = [(r.doc_id, r.n_removed) for r in suffix_dedup.repeats(docs).collect()]
    assert len(got) == 5 and (3, 300) in got and (2, 0) in got
