"""Small hand-made tables: edge values, ties, empty sides, files, streams and trained models against numpy."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions import text as T
from vectide.functions import vectors as V
from vectide.operators import clustering, codecs, evaluate, index, search, transforms
from vectide.plans import graph, workflow
from vectide.sources import files, synthetic
from vectide.streaming import windows

pytestmark = pytest.mark.seconds(120)
NAN = float("nan")


def vectors(spark, rows, id_col="vec_id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{id_col} long, embedding array<double>")


def test_metrics_of_odd_vectors(spark):
    rows = {0: [0, 0, 0, 0], 1: [1, -2, 3, 0], 2: [NAN, 1, 2, NAN], 3: [NAN] * 4, 4: [1, -2, 3, 0], 5: [0.5, 0.5, 2, 1]}
    a = vectors(spark, rows.items())
    b = a.select(F.col("vec_id").alias("other"), F.col("embedding").alias("e"))
    for name in ("l2", "l1", "linf", "cosine", "canberra", "bray_curtis", "nan_euclidean", "inner_product", "abs_inner_product"):
        got = {(r.vec_id, r.other): r.s for r in a.crossJoin(b).select("vec_id", "other", V.metric(name, F.col("embedding"), F.col("e")).alias("s")).collect()}
        for i, x in rows.items():
            want = search.pairwise(name, np.array([x], float), np.array(list(rows.values()), float))[0]
            for j, w in zip(rows, want):
                assert got[i, j] == pytest.approx(w, nan_ok=True) or (name == "linf" and math.isnan(w)), (name, i, j)


def test_ties_go_to_the_smaller_id_and_short_tables_have_no_padding(spark):
    x = vectors(spark, [(i, [i % 2, 0]) for i in range(7)])
    q = vectors(spark, [(1, [0, 0])], "q_id")
    assert [(r.vec_id, r.score) for r in search.knn(q, x, 3).orderBy("rank").collect()] == [(0, 0.0), (2, 0.0), (4, 0.0)]
    assert search.knn(q, x, 20).count() == 7
    assert search.knn(q, x.limit(0), 3).count() == search.knn(q.limit(0), x, 3).count() == 0


def test_radius_is_strict(spark):
    x, q = vectors(spark, [(0, [1, 0]), (1, [2, 0])]), vectors(spark, [(0, [0, 0])], "q_id")
    assert [r.vec_id for r in search.within(q, x, 4.0).collect()] == [0]
    assert [r.vec_id for r in search.within(vectors(spark, [(0, [1, 0])], "q_id"), x, 1.0, "inner_product").collect()] == [1]


@pytest.mark.parametrize("name", ["l2", "inner_product"])
def test_many_queries_meet_the_data_in_a_grid(spark, monkeypatch, name):
    """The path of query sets too large to broadcast gives what the other one gives."""
    x, q = synthetic.gaussian(spark, 500, 8), synthetic.gaussian(spark, 60, 8, seed=5).withColumnRenamed("vec_id", "q_id")
    want = sorted((r.q_id, r.rank, r.vec_id) for r in search.knn(q, x, 5, name).collect())
    near = sorted((r.q_id, r.vec_id) for r in search.within(q, x, 3.0, name).collect())
    monkeypatch.setattr(search, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(search, "QUERY_BLOCK", 16)
    monkeypatch.setattr(search, "DATA_BLOCK", 150)
    assert sorted((r.q_id, r.rank, r.vec_id) for r in search.knn(q, x, 5, name).collect()) == want
    assert sorted((r.q_id, r.vec_id) for r in search.within(q, x, 3.0, name).collect()) == near


def test_lists_empty_hot_and_ragged(spark, monkeypatch):
    """A probed list without rows, one cut in chunks, and queries with none, one or many probes."""
    monkeypatch.setattr(search, "DATA_BLOCK", 20)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    lists = spark.createDataFrame([(i, 0 if i < 150 else i % 3, v.tolist()) for i, v in enumerate(x)], "vec_id long, list_no int, embedding array<double>")
    q = vectors(spark, [(i, v) for i, v in enumerate(rng.normal(size=(3, 4)))], "q_id")
    asked = {0: [], 1: [0], 2: [0, 2, 9]}
    probes = spark.createDataFrame([(i, p) for i, ps in asked.items() for p in ps], "q_id long, list_no int")
    got = {}
    for r in search.ranked(search.scan_lists(q, probes, lists, k=4).select("q_id", "vec_id", "score"), 4).collect():
        got.setdefault(r.q_id, []).append((r["rank"], r.vec_id))
    queries = {r.q_id: np.array(r.embedding) for r in q.collect()}
    numbers = np.array([0 if i < 150 else i % 3 for i in range(200)])
    for i, ps in asked.items():
        able = np.flatnonzero(np.isin(numbers, ps))
        best = able[np.argsort(((x[able] - queries[i]) ** 2).sum(1), kind="stable")][:4]
        assert sorted(got.get(i, [])) == [(n + 1, int(v)) for n, v in enumerate(best)]
    centroids = vectors(spark, [(i, [i, i, i, i]) for i in range(10)]).select(F.col("vec_id").cast("int").alias("list_no"), "embedding")
    assert {r.list_no: r.n for r in index.list_sizes(lists, centroids).collect()}[9] == 0


def test_assign_with_many_centroids(spark, monkeypatch):
    x = synthetic.gaussian(spark, 300, 6)
    c = synthetic.gaussian(spark, 12, 6, seed=9).select(F.col("vec_id").cast("int").alias("list_no"), "embedding")
    want = sorted((r.vec_id, r.list_no) for r in index.assign(x, c).collect())
    monkeypatch.setattr(index, "BROADCAST_BYTES", 1)
    assert sorted((r.vec_id, r.list_no) for r in index.assign(x, c).collect()) == want


def test_speculation_right_and_wrong(spark):
    hits = [(0, 1, 5, 1.0), (0, 2, 6, 2.0), (1, 1, 5, 2.0), (1, 2, 6, 1.0)]
    scored = spark.createDataFrame(hits, "q_id long, probe_rank int, vec_id long, score double")
    told = search.speculation(search.staged(scored, 1, 1), 0)
    assert {r.q_id: r.right for r in told.collect()} == {0: True, 1: False}
    assert search.speculation_accuracy(told).first().accuracy == 0.5


def test_precision_and_recall_of_empty_sets(spark):
    none = spark.createDataFrame([], "q_id long, vec_id long, score double")
    some = spark.createDataFrame([(0, 1, 0.5)], "q_id long, vec_id long, score double")
    q = vectors(spark, [(0, [0])], "q_id")
    assert tuple(evaluate.precision_recall(none, none, q).first()) == (1.0, 1.0, 1.0, 1.0)
    assert tuple(evaluate.precision_recall(none, some, q).first()) == (0.0, 1.0, 0.0, 1.0)
    assert tuple(evaluate.precision_recall(some, none, q).first()) == (1.0, 0.0, 0.0, 0.0)
    at = evaluate.precision_recall_at(some, none, spark.createDataFrame([(1.0,)], "threshold double")).first()
    assert (at.precision, at.recall) == (1.0, 0.0)


def test_results_that_differ_in_ties_only(spark):
    a = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.5)], "q_id long, vec_id long, score double")
    assert evaluate.same_modulo_ties(a, spark.createDataFrame([(0, 1, 0.1), (0, 7, 0.5)], a.schema)).first().same
    assert not evaluate.same_modulo_ties(a, spark.createDataFrame([(0, 3, 0.1), (0, 2, 0.5)], a.schema)).first().same


def test_slices_and_middle_out(spark):
    rows = spark.createDataFrame([(i, i // 2) for i in range(6)], "vec_id long, slice_no int")
    assert sorted(r.vec_id for r in index.window_of_slices(rows, "slice_no", 2).collect()) == [2, 3, 4, 5]
    text = spark.createDataFrame([(" ".join(map(str, range(9))),)], "t string")
    assert text.select(T.middle_out(F.col("t"), 5).alias("t")).first().t == "0 1 7 8"


def test_statistics_count_what_is_not_finite(spark):
    x = vectors(spark, [(0, [1, NAN]), (1, [float("inf"), 0]), (2, [3, 4])])
    got = {r.pos: r for r in index.statistics(x).collect()}
    assert (got[0].n_inf, got[0].low, got[0].high, got[1].n_nan, got[1].n_zero, got[1].mean) == (1, 1.0, 3.0, 1, 1, 2.0)
    with pytest.raises(ValueError):
        clustering.kmeans(x, 2)


def test_kmeans_splits_empty_clusters(spark):
    """Fewer distinct points than clusters: still k centroids, and no weight is lost."""
    x = vectors(spark, [(i, [i % 2, 1]) for i in range(40)])
    c, history = clustering.kmeans(x, 4, 6)
    assert c.shape == (4, 2) and history[-1] < 0.01 and np.isfinite(c).all()  # halves of a split cluster lie 1/1024 apart
    n = np.array([4.0, 0.0])
    split = np.array([[2.0, 4.0], [0.0, 0.0]])
    clustering._split_empty(split, n, np.random.default_rng(0))
    assert n.tolist() == [2, 2] and np.allclose(split[0] + split[1], [4, 8])
    round_, _ = clustering.kmeans(x, 2, 4, spherical=True)
    assert np.allclose(np.linalg.norm(round_, axis=1), 1)
    whole, _ = clustering.kmeans(x, 2, 4, whole=True, redo=2)
    assert np.array_equal(whole, np.round(whole))


def test_pca_and_itq_against_numpy(spark):
    df = synthetic.manifold(spark, 800, 6, inner=3)
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()])
    matrix, mean = clustering.pca(df, 3)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:3]
    assert np.allclose(mean, x.mean(0)) and np.allclose(np.var((x - mean) @ matrix.T, axis=0), values)
    r = transforms.itq(df, 6)
    loss = lambda m: ((np.where(x @ m.T >= 0, 1, -1) - x @ m.T) ** 2).sum()
    assert np.allclose(r @ r.T, np.eye(6)) and loss(r) < loss(transforms.random_rotation(6))
    wide = transforms.random_rotation(3, 5)
    assert wide.shape == (5, 3) and np.allclose(wide.T @ wide, np.eye(3))


def test_vectors_by_rule(spark):
    a = synthetic.uniform(spark, 2000, 4)
    values = np.array([r.embedding for r in a.collect()])
    assert values.min() > 0 and values.max() < 1 and abs(values.mean() - 0.5) < 0.02
    assert sorted(map(str, a.collect())) == sorted(map(str, synthetic.uniform(spark, 2000, 4).repartition(5).collect()))
    normal = np.array([r.embedding for r in synthetic.gaussian(spark, 3000, 3).collect()])
    assert abs(normal.mean()) < 0.05 and abs(normal.std() - 1) < 0.05


def test_packed_codes_come_back(spark):
    rows = spark.createDataFrame([(list(range(16)),), ([15] * 16,)], "c array<int>")
    for bits in (4, 8):
        got = rows.select("c", codecs.unpacked(codecs.packed(F.col("c"), bits), bits, 16).alias("back")).collect()
        assert all(r.c == r.back for r in got)


def test_bitmaps_and_compatibility(spark):
    x = vectors(spark, [(i, [i]) for i in range(100)])
    ids = spark.createDataFrame([(0,), (31,), (32,), (99,), (99,)], "vec_id long")
    assert sorted(r.vec_id for r in index.in_bitmap(x, index.bitmap_of(ids)).collect()) == [0, 31, 32, 99]
    c = vectors(spark, [(0, [1, 2]), (1, [3, 4])]).withColumnRenamed("vec_id", "list_no")
    assert index.compatible(c, c).first().compatible and not index.compatible(c, c.limit(1)).first().compatible
    assert not index.compatible(c, c.withColumn("embedding", F.slice("embedding", 1, 1))).first().compatible


def test_index_on_disk_and_resumed(spark, tmp_path):
    x, c = synthetic.gaussian(spark, 120, 4), vectors(spark, [(0, [1] * 4), (1, [-1] * 4)]).select(F.col("vec_id").cast("int").alias("list_no"), "embedding")
    lists = index.build(x, c)
    index.save(lists, f"{tmp_path}/lists")
    back = index.load(spark, f"{tmp_path}/lists")
    assert sorted((r.vec_id, r.list_no) for r in back.collect()) == sorted((r.vec_id, r.list_no) for r in lists.collect())
    assert index.pending(x, back.where("vec_id < 100")).count() == 20


def test_files(spark, tmp_path):
    lines = [{"id": "b", "title": "T", "text": "body"}, {"id": "a", "contents": "all"}]
    (tmp_path / "corpus.jsonl").write_text("\n".join(map(json.dumps, lines)))
    corpus = files.read_corpus(spark, f"{tmp_path}/corpus.jsonl")
    got = {r.id: r.c for r in corpus.select("id", T.content(F.col("title"), F.col("text"), F.col("contents")).alias("c")).collect()}
    assert got == {"b": "T\nbody", "a": "all"}
    questions = [{"id": str(i), "question": f"q{i}", "golden_answers": ["x"], "metadata": {"level": "easy"}} for i in range(9)]
    (tmp_path / "dev.jsonl").write_text("\n".join(map(json.dumps, questions)))
    read = files.read_questions(spark, f"{tmp_path}/dev.jsonl", 3)
    assert [r.id for r in read.collect()] == ["0", "1", "2"] and read.first().metadata == {"level": "easy"}
    drawn = {r.id for r in files.read_questions(spark, f"{tmp_path}/dev.jsonl", 4, random=True).collect()}
    assert len(drawn) == 4 and drawn == {r.id for r in files.read_questions(spark, f"{tmp_path}/dev.jsonl", 4, random=True).collect()}
    assert list(files.splits(spark, str(tmp_path))) == ["dev"]
    for kind, item, values in (("fvecs", "f", [1.5, -2.0]), ("ivecs", "i", [7, -3]), ("bvecs", "B", [255, 0])):
        (tmp_path / f"x.{kind}").write_bytes(b"".join(struct.pack(f"<i2{item}", 2, *values) for _ in range(3)))
        rows = files.read_vecs(spark, f"{tmp_path}/x.{kind}", kind).orderBy("position").collect()
        assert [(r.position, r.embedding) for r in rows] == [(i, [float(v) for v in values]) for i in range(3)]
    hits = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (1, 1, 5)], "q_id long, rank int, doc_id long")
    docs = spark.createDataFrame([(5, "five")], "doc_id long, text string")
    assert [(r.q_id, r["rank"], r.text) for r in files.fetch(hits, docs).orderBy("q_id", "rank").collect()] == [(0, 1, "five"), (0, 2, None), (1, 1, "five")]
    files.write_results(hits, f"{tmp_path}/results")
    files.write_results(hits, f"{tmp_path}/results")
    assert spark.read.csv(f"{tmp_path}/results", header=True).count() == 6
    files.write_answers(docs, f"{tmp_path}/answers")
    assert spark.read.json(f"{tmp_path}/answers").first().text == "five"
    synthetic.uniform(spark, 20, 2).write.parquet(f"{tmp_path}/a.parquet")
    synthetic.uniform(spark, 5, 2).selectExpr("vec_id + 20 as vec_id", "embedding").write.parquet(f"{tmp_path}/b.parquet")
    both = [f"{tmp_path}/a.parquet", f"{tmp_path}/b.parquet"]
    assert files.read_vectors(spark, both).count() == 25 and [r.vec_id for r in files.read_vectors(spark, both, first=3).collect()] == [0, 1, 2]
    assert 0 < files.read_vectors(spark, both, share=0.5).count() < 25


def test_answers_f1(spark):
    pairs = spark.createDataFrame([("The cat", "a cat"), ("x", "y"), ("", "y")], "a string, g string")
    assert [round(r.f, 4) for r in pairs.select(T.token_f1(F.col("a"), F.col("g")).alias("f")).collect()] == [0.5, 0.0, 0.0]


def _drain(query):
    query.awaitTermination(90)
    query.stop()


def test_windows_of_a_stream_drop_late_rows(spark, tmp_path):
    """Files in turn: the second moves the watermark, which holds for late rows from the batch after the next, so the fourth
    is too late."""
    at = tmp_path / "in"
    for name, ts in (("1", "2024-01-01 00:10:00"), ("2", "2024-01-01 05:00:00"), ("3", "2024-01-01 05:30:00"), ("4", "2024-01-01 00:20:00"), ("5", "2024-01-01 09:00:00")):
        spark.createDataFrame([(ts, "click", 1.0)], "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) as ts", "event_type", "value").coalesce(1).write.mode("append").parquet(str(at))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(str(at))
    query = windows.windowed(stream).writeStream.format("memory").queryName("windowed").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    _drain(query)
    assert [(str(r.window_start), r.n) for r in spark.table("windowed").orderBy("window_start").collect()][0] == ("2024-01-01 00:00:00", 1)


def test_searches_of_a_stream(spark, tmp_path):
    x = synthetic.gaussian(spark, 60, 3)
    synthetic.gaussian(spark, 4, 3, seed=8).withColumnRenamed("vec_id", "q_id").write.parquet(f"{tmp_path}/q")
    stream = spark.readStream.schema("q_id long, embedding array<double>").parquet(f"{tmp_path}/q")
    _drain(windows.search_stream(stream, lambda batch: search.knn(batch, x, 2), f"{tmp_path}/out", f"{tmp_path}/c"))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 8


def test_running_best_of_a_stream(spark, tmp_path):
    for stage in range(2):
        rows = [(q, stage, 10 * stage + i, float((q + 1) * i + 5 - 3 * stage)) for q in range(2) for i in range(3)]
        spark.createDataFrame(rows, "q_id long, stage long, vec_id long, score double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("q_id long, stage long, vec_id long, score double").parquet(f"{tmp_path}/in")
    query = windows.running_best(stream, 3, 1).writeStream.format("memory").queryName("running").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    _drain(query)
    last = {r.q_id: (r.vec_ids, r.scores) for r in spark.table("running").where("stage = 1").collect()}
    assert last == {0: ([10, 11, 12], [2.0, 3.0, 4.0]), 1: ([10, 11, 0], [2.0, 4.0, 5.0])}


def _corpus(spark):
    docs = spark.createDataFrame([(0, "red apples\nsweet"), (1, "blue sky\nhigh"), (2, "red wine\ndry")], "id long, text string")
    rows = T.encode(docs, "id", "text").join(docs, "id").withColumnRenamed("id", "vec_id")
    return workflow.Corpus(rows, lambda r: T.encode(r, "id", "text"))


def _questions(spark):
    return spark.createDataFrame([(0, "red apples"), (1, "None of it"), (2, "blue sky")], "id long, question string")


def test_multistep_stops_where_no_question_is_left(spark):
    """At once, after a round, and never: those that stop keep the answer they have."""
    ask = lambda prompt: F.when(F.contains(prompt, F.lit("None of it")) | F.contains(prompt, F.lit("answer")), F.lit("None")).otherwise(F.lit("blue sky"))
    flow = workflow.multistep(1, 3, ask)
    body = flow.nodes[0]
    say = workflow.Generate(body.nodes[2].prompt, "step", lambda prompt: F.lit("answer"))
    flow = workflow.Workflow("m", (workflow.Repeat((*body.nodes[:2], say, *body.nodes[3:]), 3, body.stop, 1),))
    assert {r.id: r.answer for r in workflow.run(_questions(spark), flow, _corpus(spark)).collect()} == {0: "answer", 1: "", 2: "answer"}


def test_a_pandas_model_in_the_generator_slot(spark):
    @F.pandas_udf("string")
    def shout(prompt):
        return prompt.str.split().str[-1].str.upper()

    flow = workflow.Workflow("shout", (workflow.Retrieve(1), workflow.Generate(lambda: F.concat(T.references(F.col("documents")), F.col("question")), "answer", shout)))
    assert {r.id: r.answer for r in workflow.run(_questions(spark), flow, _corpus(spark)).collect()} == {0: "APPLES", 1: "IT", 2: "SKY"}


def test_graphs(spark):
    again = workflow.SetColumn("answer", lambda: F.concat("answer", F.lit("x")))
    g = graph.Graph("count").add_node("add", again)
    g.add_edge(graph.START, "add").add_edge("add", graph.END, lambda: F.length("answer") > F.col("id")).add_edge("add", "add")
    got = {r.id: (r.answer, r.passed) for r in graph.run(_questions(spark), g, _corpus(spark)).collect()}
    assert got == {0: ("x", 1), 1: ("xx", 2), 2: ("xxx", 3)}
    assert {r.id: r.answer for r in graph.run(_questions(spark), g, _corpus(spark), rounds=2).collect()} == {0: "x", 1: "xx", 2: "xx"}
    for broken in (graph.Graph("a").add_edge(graph.START, "nowhere"), graph.Graph("b").add_node("n", again).add_edge(graph.START, "n")):
        with pytest.raises(ValueError):
            broken.check()
    graph.REGISTRY.clear()
    graph.register(g)
    asked = _questions(spark).withColumn("workflow", F.lit("count"))
    assert graph.run_registered(asked, _corpus(spark)).count() == 3


def test_prompts(spark):
    turns = spark.createDataFrame([(0, i, "a b c") for i in range(4)], "conv_id long, turn long, text string")
    assert sorted(r.turn for r in T.latest_messages(turns, 7).collect()) == [2, 3]
    assert spark.range(1).select(T.passage(F.lit("x")).alias("p")).first().p == "passage: x"
