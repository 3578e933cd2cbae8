"""Hard negatives by dual-tree search: inner-product intervals of node pairs rule out whole groups of anchors at once."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.common import hash_sample, materialize
from vectide.llm.voronoi import _matrix, quantized

#: Labels are told apart by one of so many bits of a long before they are compared.
LABEL_BITS = 63
ROUTED = "vec_id long, label long, v array<double>, leaf int, away double"
ASKED = "task long, kind int, ord int, leaf int, id long, label long, v array<double>, low array<double>, high array<double>"
NAMES = [c.split()[0] for c in ASKED.split(", ")]


class Tree(NamedTuple):
    """A binary tree over vectors in heap order: node i has children 2 i + 1 and 2 i + 2, the last level holds the leaves.
    A vector goes right where direction.x > cut. Of what lies below a node: ball around `center` with `radius` (below zero:
    nothing), number of vectors, and a bit for each label, by its hash."""

    depth: int
    direction: np.ndarray
    cut: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    labels: np.ndarray

    @property
    def inner(self) -> int:
        return (1 << self.depth) - 1


def grow(sample: np.ndarray, leaves: int) -> Tree:
    """A tree of at least `leaves` leaves: each node splits its part of the sample at the median along the line through two
    vectors that lie far apart. Balls are still to be measured."""
    depth = int(np.ceil(np.log2(max(1, leaves))))
    inner, d = (1 << depth) - 1, sample.shape[1]
    direction, cut, center = np.zeros((inner, d)), np.zeros(inner), np.zeros((2 * inner + 1, d))
    node = np.zeros(len(sample), int)
    for i in range(2 * inner + 1):
        rows = np.flatnonzero(node == i)
        if len(rows):
            x = sample[rows]
            center[i] = x.mean(0)
            if i < inner:
                far = x[((x - center[i]) ** 2).sum(1).argmax()]
                direction[i] = far - x[((x - far) ** 2).sum(1).argmax()]
                along = x @ direction[i]
                cut[i] = np.median(along)
                node[rows] = 2 * i + 1 + (along > cut[i])
    n = 2 * inner + 1
    return Tree(depth, direction, cut, center, np.full(n, -1.0), np.zeros(n, int), np.zeros(n, np.int64))


def route(x: np.ndarray, tree: Tree) -> np.ndarray:
    """The leaf of each vector, counted from 0."""
    node = np.zeros(len(x), int)
    for _ in range(tree.depth):
        node = 2 * node + 1 + (np.einsum("ij,ij->i", x, tree.direction[node]) > tree.cut[node])
    return node - tree.inner


def planted(rows: DataFrame, leaf_rows: int, most_leaves: int, dim: int, name: str) -> tuple[DataFrame, Tree]:
    """(vec_id, label, v, leaf, away) of all rows, and their tree. It is grown from a sample of at most 8,192 of them
    (fewer if vectors are long); its balls, sizes and label bits are those of all rows."""
    n = rows.count()
    some = hash_sample(rows.select("vec_id", "v"), ["vec_id"], max(256, min(8192, (1 << 21) // dim))).toPandas()["v"]
    tree = grow(np.array([*some], np.float64).reshape(-1, dim), min(most_leaves, max(1, n // leaf_rows)))
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def assign(batches):
        t = shared.value
        for batch in batches:
            x = _matrix(batch.column("v"))
            if len(x):
                leaf = route(x, t)
                away = np.sqrt(((x - t.center[t.inner + leaf]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("v"), pa.array(leaf.astype(np.int32)), pa.array(away)], ["vec_id", "label", "v", "leaf", "away"])

    routed = materialize(rows.select("vec_id", "label", "v").mapInArrow(assign, ROUTED), name)
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(label), {LABEL_BITS}) as int))")
    for r in routed.groupBy("leaf").agg(F.max("away").alias("far"), F.count("*").alias("n"), F.bit_or(bit).alias("bits")).collect():  # one row a leaf
        i = tree.inner + r.leaf
        tree.radius[i], tree.size[i], tree.labels[i] = r.far * (1 + 1e-9), r.n, r.bits
    for i in range(tree.inner - 1, -1, -1):
        below = [j for j in (2 * i + 1, 2 * i + 2) if tree.size[j]]
        if below:
            tree.size[i] = tree.size[below].sum()
            tree.center[i] = (tree.center[below] * tree.size[below][:, None]).sum(0) / tree.size[i]
            tree.radius[i] = max(np.sqrt(((tree.center[j] - tree.center[i]) ** 2).sum()) + tree.radius[j] for j in below) * (1 + 1e-9)
            tree.labels[i] = np.bitwise_or.reduce(tree.labels[below])
    return routed, tree


def up(tree: Tree, leaves: np.ndarray, of=np.minimum) -> np.ndarray:
    """A value for every node from those of its leaves."""
    out = np.concatenate([np.zeros(tree.inner), leaves])
    for i in range(tree.inner - 1, -1, -1):
        out[i] = of(out[2 * i + 1], out[2 * i + 2])
    return out


def interval(a: Tree, i: np.ndarray, c: Tree, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of x.y for every x below node i of a and y below node j of c."""
    low, high = np.empty(len(i)), np.empty(len(i))
    norm_a, norm_c = np.sqrt((a.center**2).sum(1)), np.sqrt((c.center**2).sum(1))
    for lo in range(0, len(i), 1 << 16):
        p, q = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        dot = np.einsum("ij,ij->i", a.center[p], c.center[q])
        spread = norm_a[p] * c.radius[q] + norm_c[q] * a.radius[p] + a.radius[p] * c.radius[q]
        spread = spread + 1e-9 * (1 + np.abs(dot) + spread)
        low[lo : lo + len(p)], high[lo : lo + len(p)] = dot - spread, dot + spread
    return low, high


def surviving(a: Tree, c: Tree, keep) -> tuple[np.ndarray, int]:
    """Which leaf of `a` (row) has to meet which leaf of `c` (column): the upper bound of their scores, -inf where they need
    not meet; and the number of node pairs looked at. Both trees are descended together; keep(i, j, low, high) says of
    node pairs whether any leaf pair below can matter, and one that cannot takes all of them with it."""
    upper = np.full((1 << a.depth, 1 << c.depth), -np.inf)
    i, j, seen = np.zeros(1, int), np.zeros(1, int), 0
    while len(i):
        seen += len(i)
        low, high = interval(a, i, c, j)
        stays = (a.size[i] > 0) & (c.size[j] > 0) & keep(i, j, low, high)
        i, j, high = i[stays], j[stays], high[stays]
        end = (i >= a.inner) & (j >= c.inner)
        upper[i[end] - a.inner, j[end] - c.inner] = high[end]
        i, j = i[~end], j[~end]
        down = lambda n, t: np.where((n < t.inner)[:, None], 2 * n[:, None] + [1, 2], np.stack([n, np.full(len(n), -1)], 1))
        left, right = down(i, a), down(j, c)
        i, j = np.repeat(left, 2, axis=1).ravel(), np.tile(right, 2).ravel()
        real = (i >= 0) & (j >= 0)
        i, j = i[real], j[real]
    return upper, seen


def _merge(score: np.ndarray, ids: np.ndarray, ask: np.ndarray, s: np.ndarray, vec: np.ndarray) -> None:
    """Put new hits (ask, s, vec) among the best of each ask, in place; rows are ordered by score, then id."""
    k, rows = score.shape[1], np.unique(ask)
    ask, s, vec = np.concatenate([np.repeat(rows, k), ask]), np.concatenate([score[rows].ravel(), s]), np.concatenate([ids[rows].ravel(), vec])
    order = np.lexsort((vec, -s, ask))
    ask, s, vec = ask[order], s[order], vec[order]
    place = np.arange(len(ask)) - np.searchsorted(ask, ask)
    first = place < k
    score[ask[first], place[first]], ids[ask[first], place[first]] = s[first], vec[first]


class _Task:
    """Anchors of one task and the k best so far of each of their asks (an anchor, or an anchor with a window of scores)."""

    def __init__(self, parts, upper: np.ndarray, k: int, same_label: bool):
        self.leaf, self.ids, self.label = (np.concatenate([p[n] for p in parts]) for n in ("leaf", "id", "label"))
        self.x = np.concatenate([p["v"] for p in parts])
        lows, highs = ([v for p in parts for v in p[n]] for n in ("low", "high"))
        self.upper, self.same_label = upper, same_label
        self.anchor = np.repeat(np.arange(len(self.ids)), [len(v) for v in lows])
        self.place = np.concatenate([np.arange(len(v)) for v in lows]) if lows else np.zeros(0, int)
        self.low, self.high = (np.array([x for v in z for x in v], np.float64) for z in (lows, highs))
        self.score = np.full((len(self.anchor), k), -np.inf)
        self.found = np.full((len(self.anchor), k), np.iinfo(np.int64).max)
        cuts = np.flatnonzero(np.diff(self.leaf)) + 1
        ends = [0, *cuts.tolist(), len(self.ids)]
        self.runs = [(a, min(a + 128, hi)) for lo, hi in zip(ends, ends[1:]) for a in range(lo, hi, 128)]  # anchors of one leaf

    def see(self, leaf, ids, label, x) -> None:
        for a, b in self.runs:
            p, q = np.searchsorted(self.anchor, [a, b])
            if p == q:
                continue
            least = np.maximum(self.low[p:q], self.score[p:q, -1])
            bound = self.upper[self.leaf[a]][leaf]
            rows = np.flatnonzero((bound > -np.inf) & (bound >= least.min()))
            if not len(rows):
                continue
            at = self.anchor[p:q] - a
            s = (self.x[a:b] @ x[rows].T)[at]
            alike = (self.label[a:b, None] == label[rows])[at]
            ok = (s >= least[:, None]) & (s <= self.high[p:q, None]) & (alike if self.same_label else ~alike)
            if self.same_label:
                ok &= (self.ids[a:b, None] != ids[rows])[at]
            i, j = np.nonzero(ok)
            if len(i):
                _merge(self.score, self.found, p + i, s[i, j], ids[rows[j]])

    def told(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.score > -np.inf)
        score = np.clip(self.score[i, j], -(2.0**63), 2.0**63 - 1024).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.anchor[i]]), pa.array(self.place[i].astype(np.int32)), pa.array(self.found[i, j]), pa.array(score)], ["anchor_id", "place", "vec_id", "score"])


def meet(anchors: DataFrame, sizes: np.ndarray, rows: DataFrame, upper: np.ndarray, candidates: np.ndarray, k: int, same_label: bool, group_anchors: int = 1024, rows_per_task: int = 8192) -> DataFrame:
    """(anchor_id, place, vec_id, score): the k best rows of each ask of the anchors, once a task that has any.

    `anchors` (leaf, vec_id, label, v, low, high) ask once for each window low[place]..high[place]; `sizes` says how many
    lie in each leaf, `upper` which leaf of theirs meets which leaf of `rows` (leaf, vec_id, label, v), and `candidates` how
    many rows that has. Neighbouring leaves of anchors form groups; a row goes to the groups of which a leaf wants its
    leaf. How many rows a group gets is known, so it is cut into tasks of about `rows_per_task` of them; its anchors,
    in blocks of about two groups' size if a leaf has more, go to each. Within a task rows come best bound first, and those whose bound no longer
    reaches what an anchor leaf has found are skipped."""
    group = (np.cumsum(sizes) - sizes) // group_anchors
    numbers, group = np.unique(group, return_inverse=True)
    wants = np.array([(upper[group == g] > -np.inf).any(0) for g in range(len(numbers))])
    best = np.array([upper[group == g].max(0) for g in range(len(numbers))])
    order = np.argsort(np.argsort(-best, axis=1, kind="stable"), axis=1)
    chunks = np.maximum(1, -(-(wants @ candidates) // rows_per_task)).astype(np.int64)
    blocks = np.maximum(1, -(-np.bincount(group, weights=sizes).astype(np.int64) // (2 * group_anchors)))
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((group, wants, order, chunks, blocks, upper))

    def deal(is_row: bool):
        def run(batches):
            group, wants, order, chunks, blocks, _ = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    leaf, salt = (part.column(c).to_numpy() for c in ("leaf", "salt"))
                    if is_row:
                        g, row = np.nonzero(wants[:, leaf])
                        copies = blocks[g]
                    else:
                        row = np.arange(len(leaf))
                        g = group[leaf]
                        copies = np.where(wants[g].any(1), chunks[g], 0)
                    at = np.repeat(np.arange(len(g)), copies)
                    number = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                    g, row = g[at], row[at]
                    mine = salt[row] % (chunks if is_row else blocks)[g]
                    block, chunk = (number, mine) if is_row else (mine, number)
                    told = part.take(pa.array(row))
                    ord_ = order[g, leaf[row]] if is_row else leaf[row]
                    none = pa.nulls(len(row), pa.list_(pa.float64()))
                    head = [pa.array((g << 48) | (block << 28) | chunk), pa.array(np.full(len(row), int(is_row), np.int32)), pa.array(ord_.astype(np.int32)), told.column("leaf"), told.column("vec_id"), told.column("label"), told.column("v")]
                    yield pa.RecordBatch.from_arrays([*head, *([none, none] if is_row else [told.column("low"), told.column("high")])], NAMES)

        return run

    salt = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 40)).alias("salt")
    data = rows.select("leaf", "vec_id", "label", "v", salt).mapInArrow(deal(True), ASKED)
    asked = anchors.select("leaf", "vec_id", "label", "v", "low", "high", salt).mapInArrow(deal(False), ASKED)
    both = asked.union(data).repartition("task").sortWithinPartitions("task", "kind", "ord")

    def solve(batches):
        upper, key, parts, task = shared.value[-1], None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, kinds = batch.column("task").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                part = batch.slice(a, b - a)
                if keys[a] != key:
                    if task:
                        yield task.told()
                    key, parts, task = keys[a], [], None
                leaf, ids, label = (part.column(c).to_numpy() for c in ("leaf", "id", "label"))
                x = _matrix(part.column("v"))
                if kinds[a] == 0:
                    parts.append({"leaf": leaf, "id": ids, "label": label, "v": x, "low": part.column("low").to_pylist(), "high": part.column("high").to_pylist()})
                elif parts:
                    task = task or _Task(parts, upper, k, same_label)
                    task.see(leaf, ids, label, x)
        if task:
            yield task.told()

    return both.mapInArrow(solve, "anchor_id long, place int, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _of_one_length(rows: DataFrame, anchors: DataFrame, dim: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    infinite = float("inf")
    data, tree = planted(rows, 256, 2048, dim, "negative-rows")
    asked, asked_tree = planted(anchors, 32, 512, dim, "negative-anchors")
    sizes, candidates = asked_tree.size[asked_tree.inner :], tree.size[tree.inner :]
    alike = lambda i, j: (asked_tree.labels[i] & tree.labels[j]) != 0
    # down to the nearest leaves first: what they hold bounds what all others must reach
    every, _ = surviving(asked_tree, tree, lambda i, j, *_: alike(i, j))
    nearest = np.where(every >= -np.partition(-every, min(3, every.shape[1] - 1), axis=1)[:, [min(3, every.shape[1] - 1)]], every, -np.inf)
    open_ = asked.withColumns({"low": F.array(F.lit(-infinite)), "high": F.array(F.lit(infinite))})
    reached = _first(meet(open_, sizes, data, nearest, candidates, positives, True), positives).where(F.col("rank") == positives)
    floor = asked.select("vec_id", "leaf").join(reached.select(F.col("anchor_id").alias("vec_id"), "score"), "vec_id", "left")
    least = np.full(len(sizes), -infinite)
    for r in floor.groupBy("leaf").agg(F.min(F.coalesce(F.col("score").cast("double"), F.lit(-infinite))).alias("s")).collect():  # one row a leaf
        least[r.leaf] = r.s
    least = up(asked_tree, np.where(sizes > 0, least, infinite))
    wanted, _ = surviving(asked_tree, tree, lambda i, j, lo, hi: alike(i, j) & (hi >= least[i]))
    found = _first(meet(open_, sizes, data, wanted, candidates, positives, True), positives)
    found = materialize(found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("rank").alias("positive_rank"), F.col("score").alias("positive_score")), "negative-positives")
    # scores from low to high percent of the positive's, in whole numbers; none if that is negative
    p = "cast(positive_score as decimal(20,0))"
    window = F.struct("positive_rank", F.expr(f"cast(({p} * {low} + 99) div 100 as double)").alias("low"), F.expr(f"if(positive_score < 0, double('-infinity'), cast({p} * {high} div 100 as double))").alias("high"))
    windows = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(window)).alias("w"))  # at most `positives` each
    asking = materialize(asked.join(windows.select("vec_id", F.col("w.low").alias("low"), F.col("w.high").alias("high")), "vec_id"), "negative-windows")
    least, most = np.full(len(sizes), infinite), np.full(len(sizes), -infinite)
    for r in asking.groupBy("leaf").agg(F.min(F.array_min("low")).alias("low"), F.max(F.array_max("high")).alias("high")).collect():  # one row a leaf
        least[r.leaf], most[r.leaf] = r.low, r.high
    least, most = up(asked_tree, least), up(asked_tree, most, np.maximum)
    wanted, _ = surviving(asked_tree, tree, lambda i, j, lo, hi: (hi >= least[i]) & (lo <= most[i]))
    hard = _first(meet(asking, sizes, data, wanted, candidates, negatives, False), negatives)
    hard = hard.select("anchor_id", (F.col("place") + 1).alias("positive_rank"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hard.join(found, ["anchor_id", "positive_rank"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


def mine(vectors: DataFrame, anchor_every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank).

    Vectors become floor(scale * x), scores are inner products of those: exact below 2^53, rounded to double beyond, and held to the
    range of a long. Anchors are the ids divisible by `anchor_every`; their positives the `positives` best other rows of
    the same label (a whole number); for each, the `negatives` best rows of other labels that score from `low` to `high`
    percent of the positive. Ties go to the smaller id.

    Rows without id, label or vector, and with null or non-finite components, take no part; each length of vectors is
    searched by itself. An id that repeats is one anchor (its smallest label and vector), while every row is a candidate;
    rows with the anchor's own id are not its positives. No anchors, or no row that fits: no rows.

    Rows and anchors each lie in a tree of at most 2,048 and 512 leaves that Spark routes them through; the driver holds the
    nodes' balls only. Node pairs whose interval of inner products cannot reach what the anchors below still want are
    dropped with all below them; the leaf pairs that stay are scored exactly where both parts meet.
    """
    spark = vectors.sparkSession
    clean = quantized(vectors.withColumn("__label", F.col(label_col).cast("long")).where("__label is not null"), id_col, vector_col, scale, keep=["__label"])
    rows = materialize(clean.where("vec_id is not null").select("vec_id", F.col("__label").alias("label"), "v"), "negative-vectors")
    firsts = rows.where(F.col("vec_id") % anchor_every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.label", "s.v")
    lengths = [r[0] for r in firsts.select(F.size("v")).distinct().collect()]  # one row a length
    parts = [_of_one_length(rows.where(F.size("v") == n), firsts.where(F.size("v") == n), n, positives, negatives, low, high) for n in sorted(lengths)]
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int")
    return reduce(lambda a, b: a.unionByName(b), parts)


ORACLE = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = d.label AS alike, d.vec_id, CAST(list_inner_product(a.v, d.v) AS BIGINT) AS score
  FROM good a JOIN good d ON a.vec_id % 50 = 0 AND len(a.v) = len(d.v) AND d.vec_id <> a.vec_id),
positive AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM scored WHERE alike) WHERE nth <= 5),
hard AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.nth, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.nth ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score, CAST(nth AS INTEGER) AS positive_rank
FROM hard WHERE rank <= 3
"""
