"""Search, mixing, packing and token counts."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.compare import assert_same, duck, rows_of
from tests.llm.test_near_duplicates import table
from vectide.llm import bpe_transducer, mixing, packing, registry, voronoi

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.seconds(90)
ODD = [None, "", " ", "  \n\n x  ", "don't I'll we've they're 'tis ''s", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "naïve café 東京 😀😀 é́ ½ ²", "x" * 3000, "\t\t  tab\r\n", "0123456789 " * 50, "\u3000\u00a0 nbsp", "the cat " * 4000]


def test_voronoi_against_sql(spark):
    assert_same(rows_of(registry.op4_voronoi_topk(spark, SF)), duck(SF, voronoi.ORACLE, ["embeddings"]))


def test_voronoi_odd_rows(spark):
    rows = [(i * 50, [float(i % 3), 1.0], 1, 2) for i in range(9)] + [(1, None, 1, 2), (2, [float("nan"), 1.0], 1, 2), (3, [None, 1.0], 1, 2), (None, [1.0, 1.0], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, grp int, away int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in voronoi.search_every_nth(df).collect()]
    wanted = []
    for q in range(9):
        scored = sorted((-(256 * 256 * ((q % 3) * (i % 3) + 1)), i * 50) for i in range(9) if i != q)[:5]
        wanted += [(q * 50, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted(got) == sorted(wanted)
    assert voronoi.search_every_nth(df.limit(0)).count() == 0
    assert voronoi.search_every_nth(df.where("vec_id = 50")).count() == 0


def test_voronoi_lengths_and_repeats(spark):
    """Vectors meet those of their own length; a repeated query is one query, repeated data are candidates each."""
    rows = [(i, [float(i % 7), 1.0], 1) for i in range(60)] + [(50, [1.0, 1.0], 1), (7, [0.0, 1.0], 1), (100, [1.0], 1), (70, [], 1)]
    rows += [(i, [float(i % 3), 0.0, 1.0], 1) for i in range(200, 208)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int")
    got = voronoi.search_every_nth(df).collect()
    assert {r.query_id for r in got} == {0, 50, 200} and len(got) == 15
    assert all(r.vec_id != r.query_id and r.vec_id not in (70, 100) for r in got)
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 200] == [(1, 203, 5 * 65536), (2, 206, 5 * 65536), (3, 202, 3 * 65536), (4, 205, 3 * 65536), (5, 201, 65536)]


def test_voronoi_leaves_out_rows_of_other_clusters(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(20, 16))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    x = np.floor(256 * (centers[np.arange(4000) % 20] + rng.normal(size=(4000, 16)) * 0.02))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, v array<double>")
    queries = rows.where("vec_id % 20 < 10")
    asked, cells = voronoi.query_cells(queries, 32, 64)
    group = voronoi.neighbour_groups(cells, 200)
    share = voronoi.wanted_rows(rows, cells, group, 5).count() / (4000 * len(set(group)))
    print("voronoi: share of rows replicated to each of", len(set(group)), "groups", share)
    assert share < 0.5
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in voronoi.top_inner_products(rows, queries, group_queries=200, rows_per_task=500).collect()}
    for q in [i for i in range(4000) if i % 20 < 10]:
        s = (x @ x[q]).astype(int)
        s[q] = -(10**9)
        best = sorted(range(4000), key=lambda i: (-s[i], i))[:5] if q % 400 == 0 else None
        for n, i in enumerate(best or []):
            assert got[q, n + 1] == (i, s[i])


def test_long_words(spark):
    """Words of many chunks: letters without a blank, and runs that never meet the states of a fresh start."""
    rng = np.random.default_rng(2)
    syllables = ["ba", "ne", "tion", "the", "ing", "ö", "re"]
    some = ["".join(rng.choice(syllables, 20_000)), "x" * 5001, "ab" * 3000, "-" * 4000, "=-" * 2000, "aaaab" * 900, "z" * 513, "東京" * 1500]
    library = Tokenizer.from_file(registry.tokenizer_path())
    got = {r.doc_id: r.n_tokens for r in bpe_transducer.count_tokens(table(spark, list(enumerate(some))), registry.tokenizer_path()).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(some)}
    spec = bpe_transducer.load_spec(registry.tokenizer_path())
    ids, bounds = bpe_transducer.Tokenizer(spec).ids(pa.array(some))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_repeated_rows_and_null_ids(spark):
    docs = table(spark, [(1, "a b"), (1, "a b"), (None, "c"), (None, None)])
    path = registry.tokenizer_path()
    assert sorted((r.n_bytes, r.n_tokens) for r in bpe_transducer.count_tokens(docs, path).collect()) == [(0, 0), (1, 1), (3, 2), (3, 2)]
    packed = packing.pack_documents(docs, path).collect()
    assert sorted(r.length for r in packed) == [1, 2, 3, 3] and len({(r.sequence_id, r.offset) for r in packed}) == 4


def test_mixing_against_sql(spark):
    assert_same(rows_of(registry.op5_source_mixing(spark, SF)), duck(SF, mixing.ORACLE, ["documents"]))


def test_mixing_meets_targets(spark):
    rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    totals, longest = {}, {}
    for r in rows:
        assert r.taken <= 3 * r.size
        key = (r.source_size, r.target)
        totals[key] = totals.get(key, 0) + r.taken
        longest[key] = max(longest.get(key, 0), r.size)
    assert all(abs(totals[k] - k[1]) <= 2 * longest[k] for k in totals)
    assert sum(k[1] for k in totals) == pytest.approx(sum(k[0] for k in totals))


def test_mixing_odd_rows(spark):
    docs = table(spark, [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "d e")]).unionByName(table(spark, [(9, "x y")]).selectExpr("doc_id", "text", "lang", "null as source", "n_chars", "fp", "id", "k", "`row`", "component_id", "size", "copies"))
    got = mixing.mix(docs)
    assert got.count() == 6
    taken = mixing.mixed_documents(docs)
    assert taken.columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == mixing.mixed_documents(docs.limit(0)).count() == 0
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mix(docs).collect()))


def test_token_counts(spark):
    library = Tokenizer.from_file(registry.tokenizer_path())
    some = list(enumerate(ODD)) + [(1000 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in bpe_transducer.count_tokens(table(spark, some), registry.tokenizer_path()).collect()}
    for i, t in some:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 512), t


def test_packing(spark):
    library = Tokenizer.from_file(registry.tokenizer_path())
    some = list(enumerate(ODD)) + [(1000 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = packing.pack_documents(table(spark, some), registry.tokenizer_path()).collect()
    by_doc, by_sequence, total = {}, {}, 0
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in some:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(-(-len(ids) // 2048)))
        assert all(p.length == 2048 for p in parts[1:])
        at = 0
        for p in parts:
            assert p.start == at and p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert len(by_sequence) <= 1.02 * total / 2048 + 1


def test_packing_plans_keep_every_piece():
    rng = np.random.default_rng(1)
    for most in (64, 512):
        counts = np.zeros(most + 1, np.int64)
        np.add.at(counts, rng.integers(1, most + 1, 5000), 1)
        left = counts.copy()
        for lengths, repeats in packing.plan(counts):
            assert sum(lengths) <= most
            for v in lengths:
                left[v] -= repeats
        assert not left.any()
    assert packing.plan(np.zeros(65, np.int64)) == []


def test_empty_and_clashing(spark):
    path = registry.tokenizer_path()
    assert packing.pack_documents(table(spark, []), path).count() == bpe_transducer.count_tokens(table(spark, []), path).count() == 0
    parts = spark.createDataFrame([(1, 0, 5, "a", 7), (1, 1, 5, "b", 8)], "doc_id long, piece int, length long, rank string, salt int")
    assert packing.pack(parts, 10).columns == [*parts.columns, "sequence_id", "offset"]
