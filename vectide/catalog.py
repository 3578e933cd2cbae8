"""Queries over the driver tables and the SQL that each must agree with.

Searches ask with every embedding whose id is divisible by 100 and look at all rows; everything else runs over whole
tables. Floating-point results are rounded on both sides, as sums may run in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.functions import text as T
from vectide.functions import vectors as V
from vectide.operators import clustering, codecs, evaluate, index, search, text_search
from vectide.plans import graph, workflow
from vectide.sources.written import new_folder
from vectide.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DIM = 64
WITH = """
WITH e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
q AS (SELECT vec_id AS q_id, v AS qv FROM e WHERE vec_id % 100 = 0),
cp AS (SELECT label AS list_no, i, avg(v[i]) AS m FROM e, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY ALL),
c AS (SELECT list_no, list(m ORDER BY i) AS cv FROM cp GROUP BY list_no)
"""


def _rounded(df: DataFrame, *columns: str, digits: int = 5) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def rows(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), "embedding")


def centroids(spark: SparkSession, d: str) -> DataFrame:
    return index.centroids_of(rows(spark, d))


def lists(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).withColumnRenamed("label", "list_no")


def query(name: str, sql: str | None = None, tables: bool = True):
    """Register a query; `sql` may use the common tables e, q and c."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (WITH + ("," + sql.strip()[1:] if sql.strip().startswith("&") else sql)) if tables else sql
        return f

    return register


# --- metrics: every vector against the mean of its label ---------------------------------------------------------

_Z = "list_zip(a, b)"
SQL_METRIC = {
    "inner_product": f"list_sum([z[1] * z[2] FOR z IN {_Z}])",
    "cosine": f"list_sum([z[1] * z[2] FOR z IN {_Z}]) / (sqrt(list_sum([x * x FOR x IN a])) * sqrt(list_sum([x * x FOR x IN b])))",
    "l2": f"list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN {_Z}])",
    "l1": f"list_sum([abs(z[1] - z[2]) FOR z IN {_Z}])",
    "linf": f"list_max([abs(z[1] - z[2]) FOR z IN {_Z}])",
    "lp": f"list_sum([pow(abs(z[1] - z[2]), 3) FOR z IN {_Z}])",
    "canberra": f"list_sum([abs(z[1] - z[2]) / (abs(z[1]) + abs(z[2])) FOR z IN {_Z}])",
    "bray_curtis": f"list_sum([abs(z[1] - z[2]) FOR z IN {_Z}]) / list_sum([abs(z[1] + z[2]) FOR z IN {_Z}])",
    "jensen_shannon": f"list_sum([-z[1] * ln((z[1] + z[2]) / 2 / z[1]) - z[2] * ln((z[1] + z[2]) / 2 / z[2]) FOR z IN {_Z}]) / 2",
    "jaccard": f"list_sum([least(z[1], z[2]) FOR z IN {_Z}]) / list_sum([greatest(z[1], z[2]) FOR z IN {_Z}])",
    "nan_euclidean": f"list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN {_Z}])",
    "abs_inner_product": f"list_sum([abs(z[1] * z[2]) FOR z IN {_Z}])",
}
#: These are defined for positive components only: both sides take absolute values, a little above zero.
POSITIVE = ("jensen_shannon", "jaccard")


def _metric_query(name: str) -> None:
    shown = (lambda x: f"[abs(x) + 0.001 FOR x IN {x}]") if name in POSITIVE else (lambda x: x)
    sql = f"""SELECT vec_id, round({SQL_METRIC[name]}, 5) AS score
    FROM (SELECT vec_id, {shown('v')} AS a, {shown('cv')} AS b FROM e JOIN c ON label = list_no)"""

    @query(f"metric_{name}", sql)
    def run(spark, d):
        a, b = V.doubles(F.col("embedding")), F.col("c")
        if name in POSITIVE:
            a, b = (F.transform(v, lambda x: F.abs(x) + F.lit(0.001)) for v in (a, b))
        joined = rows(spark, d).join(centroids(spark, d).select(F.col("list_no").alias("label"), F.col("embedding").alias("c")), "label")
        return _rounded(joined.select("vec_id", V.metric(name, a, b).alias("score")), "score")


for _name in V.METRICS:
    _metric_query(_name)


# --- vector functions ------------------------------------------------------------------------------------------------


def _vector_query(name: str, sql_value: str, value, digits: int | None = 5) -> None:
    """An array for each row, as text of rounded components joined by blanks."""

    @query(name, f"SELECT vec_id, pos, round(x, 5) AS x FROM (SELECT vec_id, unnest(generate_series(0, len(r) - 1)) AS pos, unnest(r) AS x FROM (SELECT vec_id, {sql_value} AS r FROM e))")
    def run(spark, d):
        out = rows(spark, d).select("vec_id", F.posexplode(value(F.col("embedding"))).alias("pos", "x"))
        return _rounded(out.select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x")), "x")


_vector_query("normalized", "[x / sqrt(list_sum([y * y FOR y IN v])) FOR x IN v]", V.normalized)
_vector_query("remap_pad", "list_concat(v, [0.0::DOUBLE FOR i IN generate_series(1, 16)])", lambda v: V.remap(v, DIM, 80))
_vector_query("remap_crop", "v[1:10]", lambda v: V.remap(v, DIM, 10))
_vector_query("remap_stride", "[v[i * 4 + 1] FOR i IN generate_series(0, 15)]", lambda v: V.remap(v, DIM, 16, uniform=True))
_vector_query("madd", "[z[1] + 0.5 * z[2] FOR z IN list_zip(v, list_reverse(v))]", lambda v: V.add(v, F.reverse(V.doubles(v)), 0.5))
_vector_query("signs", "[CASE WHEN x >= 0 THEN 1.0 ELSE -1.0 END FOR x IN v]", lambda v: V.from_sign_words(V.sign_words(v, DIM), DIM))
_vector_query("linear_transform", "[list_sum([z[1] * z[2] FOR z IN list_zip(v, [CAST((i * 7 + j * 3) % 5 - 2 AS DOUBLE) FOR j IN generate_series(0, 63)])]) + i FOR i IN generate_series(0, 3)]", lambda v: V.linear(v, [[(i * 7 + j * 3) % 5 - 2 for j in range(DIM)] for i in range(4)], [0, 1, 2, 3]))


@query("norms", "SELECT vec_id, round(sqrt(list_sum([x * x FOR x IN v])), 5) AS norm, round(list_sum([x * x FOR x IN v]), 5) AS squared, CAST(list_position(v, list_min(v)) - 1 AS BIGINT) AS least FROM e")
def norms(spark, d):
    v = F.col("embedding")
    return _rounded(rows(spark, d).select("vec_id", V.norm(v).alias("norm"), V.squared_norm(v).alias("squared"), V.nearest_position(v).cast("long").alias("least")), "norm", "squared")


@query("residuals", "SELECT vec_id, pos, round(x, 5) AS x FROM (SELECT vec_id, unnest(generate_series(0, 63)) AS pos, unnest([z[1] - z[2] FOR z IN list_zip(v, cv)]) AS x FROM e JOIN c ON label = list_no)")
def residuals(spark, d):
    joined = rows(spark, d).join(centroids(spark, d).select(F.col("list_no").alias("label"), F.col("embedding").alias("c")), "label")
    out = joined.select("vec_id", F.posexplode(V.subtract(F.col("embedding"), F.col("c"))).alias("pos", "x"))
    return _rounded(out.withColumn("pos", F.col("pos").cast("long")), "x")


@query("centered", "SELECT vec_id, i - 1 AS pos, round(v[i] - m, 5) AS x FROM e JOIN (SELECT i, avg(v[i]) AS m FROM e, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY i) ON true")
def centered(spark, d):
    mean = index.centroids_of(rows(spark, d).withColumn("all", F.lit(0)), "all").select(F.col("embedding").alias("m"))
    out = rows(spark, d).join(F.broadcast(mean)).select("vec_id", F.posexplode(V.subtract(F.col("embedding"), F.col("m"))).alias("pos", "x"))
    return _rounded(out.withColumn("pos", F.col("pos").cast("long")), "x")


# --- exact search ----------------------------------------------------------------------------------------------------


def _top(score: str, k: int, descending: bool = False, where: str = "true", extra: str = "") -> str:
    order = "DESC" if descending else "ASC"
    return f"""SELECT q_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score {order}, vec_id) AS rank FROM (
        SELECT q_id, vec_id, {score} AS score FROM (SELECT q_id, vec_id, label, qv AS a, v AS b FROM q JOIN e ON {where}){extra})) WHERE rank <= {k}"""


for _name in ("l2", "inner_product", "cosine", "l1", "linf", "lp", "canberra", "bray_curtis", "abs_inner_product"):

    @query(f"knn_{_name}", _top(SQL_METRIC[_name], 10, _name in V.SIMILARITIES))
    def _knn(spark, d, name=_name):
        return _rounded(search.knn(asked(spark, d), rows(spark, d), 10, name), "score")


SELECTORS = {
    "range": ("vec_id >= 50 AND vec_id < 300", lambda c: (c >= 50) & (c < 300)),
    "not": ("NOT (vec_id >= 50 AND vec_id < 300)", lambda c: ~((c >= 50) & (c < 300))),
    "and_or_xor": ("((vec_id < 200 OR label = 3) <> (vec_id % 7 = 0))", lambda c: ((c < 200) | (F.col("label") == 3)) != (c % 7 == 0)),
}
for _name, (_sql, _sel) in SELECTORS.items():

    @query(f"knn_selector_{_name}", _top(SQL_METRIC["l2"], 5, where=_sql))
    def _selected(spark, d, sel=_sel):
        return _rounded(search.knn(asked(spark, d), rows(spark, d), 5, "l2", selector=sel(F.col("vec_id"))), "score")


@query("knn_selector_ids", _top(SQL_METRIC["l2"], 5, where="e.vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def knn_ids(spark, d):
    chosen = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return _rounded(search.knn(asked(spark, d), rows(spark, d).join(chosen, "vec_id", "left_semi"), 5), "score")


def _range(score: str, keep: str) -> str:
    return f"SELECT q_id, vec_id, round(score, 5) AS score FROM (SELECT q_id, vec_id, {score} AS score FROM (SELECT q_id, vec_id, qv AS a, v AS b FROM q, e)) WHERE {keep}"


@query("range_l2", _range(SQL_METRIC["l2"], "score < 1.6"))
def range_l2(spark, d):
    return _rounded(search.within(asked(spark, d), rows(spark, d), 1.6), "score")


@query("range_inner_product", _range(SQL_METRIC["inner_product"], "score > 0.2"))
def range_ip(spark, d):
    return _rounded(search.within(asked(spark, d), rows(spark, d), 0.2, "inner_product"), "score")


@query("range_limited", f"& hits AS ({_range(SQL_METRIC['l2'], 'score < 1.8').replace('round(score, 5) AS score', 'score')}), bound AS (SELECT max(score) AS r, count(*) AS n FROM (SELECT score FROM hits ORDER BY score LIMIT 31)) SELECT q_id, vec_id, round(score, 5) AS score FROM hits, bound WHERE n <= 30 OR score < r")
def range_limited(spark, d):
    return _rounded(search.limited(search.within(asked(spark, d), rows(spark, d), 1.8), 30), "score")


@query("pair_distances", "SELECT vec_id, round(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v, w)]), 5) AS score FROM e JOIN (SELECT vec_id - 1 AS p, v AS w FROM e) ON p = vec_id")
def pair_distances(spark, d):
    """Distances of stated pairs: every vector and the next."""
    x = rows(spark, d)
    after = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w"))
    return _rounded(x.join(after, "vec_id").select("vec_id", V.metric("l2", F.col("embedding"), F.col("w")).alias("score")), "score")


@query("knn_shards", _top(SQL_METRIC["l2"], 10))
def knn_shards(spark, d):
    """Each shard's best, merged."""
    parts = [search.knn(asked(spark, d), rows(spark, d).where(F.col("vec_id") % 3 == i), 10) for i in range(3)]
    return _rounded(search.merged(parts, 10), "score")


@query("split_vectors", "SELECT q_id, vec_id, round(s, 5) AS score FROM (SELECT q_id, vec_id, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(qv, v)]) AS s FROM q, e) WHERE s < 1.7")
def split_vectors(spark, d):
    """Distances of halves of the dimensions, summed for each pair."""
    return _rounded(search.within_by_parts(asked(spark, d), rows(spark, d), 1.7), "score")


@query("margin", "& s AS (SELECT q_id, vec_id, list_sum([z[1] * z[2] FOR z IN list_zip(qv, v)]) AS score FROM q JOIN e ON vec_id <> q_id), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 4), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, q_id) AS r FROM s) WHERE r <= 4) SELECT f.q_id, f.vec_id, round(2 * score / (mq + mx), 5) AS margin FROM f JOIN (SELECT q_id, avg(score) AS mq FROM f GROUP BY q_id) USING (q_id) JOIN (SELECT vec_id, avg(score) AS mx FROM b GROUP BY vec_id) USING (vec_id)")
def margin(spark, d):
    """Mutual margin of each query and its four nearest, itself left out."""
    turned = lambda x: x.select(*[F.col(c).alias({"q_id": "vec_id", "vec_id": "q_id"}.get(c, c)) for c in ("q_id", "vec_id", "embedding") if c in x.columns])
    best = lambda q, x: search.ranked(search.knn(q, x, 5, "inner_product").where("q_id <> vec_id").drop("rank"), 4, "inner_product")
    forward = best(asked(spark, d), rows(spark, d))
    backward = best(turned(rows(spark, d)), turned(asked(spark, d)))
    return _rounded(search.margins(forward, backward), "margin")


# --- inverted lists: the labels are the lists -------------------------------------------------------------------------

PROBES = """& p AS (SELECT * FROM (SELECT q_id, qv, list_no, cs, row_number() OVER (PARTITION BY q_id ORDER BY cs, list_no) AS probe_rank
  FROM (SELECT q_id, qv, list_no, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(qv, cv)]) AS cs FROM q, c)) WHERE probe_rank <= 3),
s AS (SELECT q_id, list_no, probe_rank, vec_id, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(qv, v)]) AS score FROM p JOIN e ON label = list_no),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score, vec_id) AS rank FROM s) WHERE rank <= 10)
"""


def probed(spark, d, n: int = 3) -> DataFrame:
    return search.probes(asked(spark, d), centroids(spark, d), n)


def scored(spark, d, k: int | None = 10, radius: float | None = None) -> DataFrame:
    return search.scan_lists(asked(spark, d), probed(spark, d), lists(spark, d), k=k, radius=radius)


@query("assign", "SELECT vec_id, CAST(list_no AS INTEGER) AS list_no, round(s, 5) AS score FROM (SELECT vec_id, list_no, s, row_number() OVER (PARTITION BY vec_id ORDER BY s, list_no) AS r FROM (SELECT vec_id, list_no, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v, cv)]) AS s FROM e, c)) WHERE r = 1")
def assign(spark, d):
    return _rounded(index.assign(rows(spark, d), centroids(spark, d)), "score")


@query("ivf_search", PROBES + "SELECT q_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM t")
def ivf_search(spark, d):
    return _rounded(search.ivf(asked(spark, d), centroids(spark, d), lists(spark, d), 10, 3).drop("list_no"), "score")


@query("ivf_all_lists", _top(SQL_METRIC["l2"], 10))
def ivf_all(spark, d):
    return _rounded(search.ivf(asked(spark, d), centroids(spark, d), lists(spark, d), 10, 1000).drop("list_no"), "score")


@query("ivf_max_codes", PROBES + ", z AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY q_id ORDER BY probe_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p JOIN (SELECT label, count(*) AS n FROM e GROUP BY label) ON label = list_no) SELECT q_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM (SELECT s.*, row_number() OVER (PARTITION BY s.q_id ORDER BY score, vec_id) AS rank FROM s JOIN z ON z.q_id = s.q_id AND z.list_no = s.list_no WHERE before < 60) WHERE rank <= 10")
def ivf_max_codes(spark, d):
    return _rounded(search.ivf(asked(spark, d), centroids(spark, d), lists(spark, d), 10, 3, max_codes=60).drop("list_no"), "score")


@query("ivf_range", PROBES + "SELECT q_id, vec_id, round(score, 5) AS score FROM s WHERE score < 1.7")
def ivf_range(spark, d):
    return _rounded(scored(spark, d, radius=1.7).select("q_id", "vec_id", "score"), "score")


@query("ivf_best_of_lists", PROBES + "SELECT q_id, list_no, CAST(probe_rank AS INTEGER) AS probe_rank, round(min(score), 5) AS best_score, arg_min(vec_id, score) AS best_id FROM s GROUP BY q_id, list_no, probe_rank")
def ivf_best(spark, d):
    return _rounded(search.best_of_lists(scored(spark, d)), "best_score")


STAGED = PROBES + ", g AS (SELECT q_id, vec_id, score, unnest(generate_series(probe_rank - 1, 2)) AS stage FROM s), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id, stage ORDER BY score, vec_id) AS rank FROM g) WHERE rank <= 5)"


@query("ivf_staged", STAGED + "SELECT q_id, CAST(stage AS INTEGER) AS stage, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 5) AS score FROM h")
def ivf_staged(spark, d):
    return _rounded(search.staged(scored(spark, d), 5, 1), "score")


@query("ivf_speculation", STAGED + "SELECT a.q_id, a.ids = b.ids AS \"right\" FROM (SELECT q_id, list(vec_id ORDER BY rank) AS ids FROM h WHERE stage = 1 GROUP BY q_id) a JOIN (SELECT q_id, list(vec_id ORDER BY rank) AS ids FROM h WHERE stage = 2 GROUP BY q_id) b USING (q_id)")
def ivf_speculation(spark, d):
    return search.speculation(search.staged(scored(spark, d), 5, 1), 1)


@query("ivf_contributing_rank", PROBES + ", k AS (SELECT q_id, max(score) AS kth FROM t GROUP BY q_id) SELECT s.q_id, CAST(max(probe_rank) AS INTEGER) AS last_rank, count(DISTINCT list_no) AS hit_lists FROM s JOIN k USING (q_id) WHERE score <= kth GROUP BY s.q_id")
def ivf_contributing(spark, d):
    """The farthest probe that still holds one of the ten best, and how many lists do."""
    s = scored(spark, d)
    kth = search.ranked(s, 10).groupBy("q_id").agg(F.max("score").alias("kth"))
    best = search.best_of_lists(s).join(kth, "q_id").where("best_score <= kth")
    return best.groupBy("q_id").agg(F.max("probe_rank").alias("last_rank"), F.count("*").alias("hit_lists"))


@query("ivf_history_reorder", PROBES + ", o AS (SELECT q_id, list_no, probe_rank, CASE WHEN h THEN 0 WHEN lag_rank <= 3 THEN 1 ELSE 2 END AS class FROM (SELECT p.q_id, p.list_no, p.probe_rank, y.probe_rank AS lag_rank, y.probe_rank = 1 AS h FROM p LEFT JOIN p y ON y.q_id = p.q_id - 100 AND y.list_no = p.list_no)) SELECT q_id, list_no, CAST(probe_rank AS INTEGER) AS probe_rank, CAST(row_number() OVER (PARTITION BY q_id ORDER BY class, probe_rank) AS INTEGER) AS new_rank FROM o")
def ivf_history(spark, d):
    """Probes of each query reordered by the query before it: its first list, then its other lists, then the rest."""
    p = probed(spark, d).select("q_id", "list_no", "probe_rank")
    before = p.select((F.col("q_id") + 100).alias("q_id"), "list_no", F.col("probe_rank").alias("old"))
    kind = F.when(F.col("old") == 1, 0).when(F.col("old").isNotNull(), 1).otherwise(2)
    joined = p.join(before, ["q_id", "list_no"], "left").withColumn("kind", kind)
    return joined.withColumn("new_rank", F.row_number().over(Window.partitionBy("q_id").orderBy("kind", "probe_rank"))).select("q_id", "list_no", "probe_rank", "new_rank")


@query("probe_counts", PROBES + "SELECT list_no, count(*) AS n FROM p GROUP BY list_no")
def probe_counts(spark, d):
    return probed(spark, d).groupBy("list_no").agg(F.count("*").alias("n"))


@query("stage_overlap", PROBES + "SELECT q_id, round(len(list_intersect(ls, bs)) / len(ls), 5) AS overlap FROM (SELECT q_id, ls, lag(ls) OVER (ORDER BY q_id) AS bs FROM (SELECT q_id, list(list_no) AS ls FROM p GROUP BY q_id)) WHERE bs IS NOT NULL")
def stage_overlap(spark, d):
    """Share of each stage's lists that the stage before it probed; the queries in order are the stages."""
    sets = probed(spark, d).groupBy("q_id").agg(F.collect_set("list_no").alias("ls"))
    before = sets.select((F.col("q_id") + 100).alias("q_id"), F.col("ls").alias("bs"))
    return sets.join(before, "q_id").select("q_id", F.round(F.size(F.array_intersect("ls", "bs")) / F.size("ls"), 5).alias("overlap"))


@query("stage_drift", "SELECT label, vec_id, round(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v, w)]), 5) AS drift FROM (SELECT label, vec_id, v, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM e) WHERE w IS NOT NULL")
def stage_drift(spark, d):
    moved = windows.lagged(rows(spark, d), "label", "vec_id", "embedding", "w").where("w is not null")
    return _rounded(moved.select("label", "vec_id", V.metric("l2", F.col("embedding"), F.col("w")).alias("drift")), "drift")


# --- index tables -----------------------------------------------------------------------------------------------------


@query("centroids", "SELECT list_no, i - 1 AS pos, round(m, 5) AS x FROM cp")
def all_centroids(spark, d):
    out = centroids(spark, d).select("list_no", F.posexplode("embedding").alias("pos", "x"))
    return _rounded(out.withColumn("pos", F.col("pos").cast("long")), "x")


@query("list_sizes", "SELECT list_no, count(e.vec_id) AS n FROM c LEFT JOIN e ON label = list_no GROUP BY list_no")
def list_sizes(spark, d):
    return index.list_sizes(lists(spark, d), centroids(spark, d))


@query("imbalance", "SELECT round(count(*) * sum(n * n) / (sum(n) * sum(n)), 5) AS imbalance FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM e GROUP BY label)")
def imbalance(spark, d):
    return _rounded(index.imbalance(index.list_sizes(lists(spark, d), centroids(spark, d))), "imbalance")


@query("lists_by_size", "SELECT label AS list_no, n, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INTEGER) AS new_no FROM (SELECT label, count(*) AS n FROM e GROUP BY label)")
def lists_by_size(spark, d):
    return index.by_size(index.list_sizes(lists(spark, d), centroids(spark, d)))


@query("list_limits", "SELECT list_no, CAST(coalesce(sum(n) OVER (ORDER BY list_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, n FROM (SELECT label AS list_no, count(*) AS n FROM e GROUP BY label)")
def list_limits(spark, d):
    before = Window.orderBy("list_no").rowsBetween(Window.unboundedPreceding, -1)
    sizes = index.list_sizes(lists(spark, d), centroids(spark, d))
    return sizes.select("list_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n")


@query("matrix_statistics", "SELECT i - 1 AS pos, count(*) AS n, count(*) FILTER (isnan(v[i])) AS n_nan, count(*) FILTER (isinf(v[i])) AS n_inf, count(*) FILTER (v[i] = 0) AS n_zero, round(min(v[i]), 5) AS low, round(max(v[i]), 5) AS high, round(avg(v[i]), 5) AS mean, round(stddev_pop(v[i]), 5) AS deviation FROM e, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY i")
def matrix_statistics(spark, d):
    s = index.statistics(rows(spark, d)).withColumn("pos", F.col("pos").cast("long"))
    return _rounded(s, "low", "high", "mean", "deviation")


@query("row_statistics", "SELECT count(*) AS n, count(DISTINCT v) AS n_distinct, round(min(s), 5) AS least_norm, round(max(s), 5) AS largest_norm FROM (SELECT v, sqrt(list_sum([x * x FOR x IN v])) AS s FROM e)")
def row_statistics(spark, d):
    return _rounded(index.row_statistics(rows(spark, d)), "least_norm", "largest_norm")


@query("duplicate_vectors", "SELECT vec_id, representative, copies FROM e JOIN (SELECT v, min(vec_id) AS representative, count(*) AS copies FROM e GROUP BY v) USING (v)")
def duplicate_vectors(spark, d):
    return index.duplicates(rows(spark, d))


@query("index_merge", "SELECT vec_id, label AS list_no FROM e UNION ALL SELECT vec_id + 100000, label FROM e WHERE label < 5")
def index_merge(spark, d):
    x = lists(spark, d).select("vec_id", "list_no")
    return index.merged(x, x.where("list_no < 5"), 100_000)


@query("index_remove", "SELECT vec_id, label AS list_no FROM e WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def index_remove(spark, d):
    gone = spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return index.without(lists(spark, d), gone).select("vec_id", "list_no")


@query("index_update", "SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN label + 100 ELSE label END AS list_no FROM e")
def index_update(spark, d):
    x = lists(spark, d)
    changes = x.where("vec_id % 9 = 0").withColumn("list_no", F.col("list_no") + 100)
    return index.updated(x.select("vec_id", "list_no"), changes.select("vec_id", "list_no"))


@query("sliding_slices", "SELECT vec_id, vec_id // 50 AS slice_no FROM e WHERE vec_id // 50 > (SELECT max(vec_id // 50) FROM e) - 3")
def sliding_slices(spark, d):
    sliced = rows(spark, d).select("vec_id", F.expr("vec_id div 50").alias("slice_no"))
    return index.window_of_slices(sliced, "slice_no", 3)


# --- codecs -----------------------------------------------------------------------------------------------------------

SQ = "& r AS (SELECT list(lo ORDER BY i) AS lo, list(hi - lo ORDER BY i) AS w FROM (SELECT i, min(v[i]) AS lo, max(v[i]) AS hi FROM e, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY i)), k AS (SELECT vec_id, unnest(generate_series(1, 64)) AS i FROM e), "


def _sq(levels: int) -> str:
    return SQ + f"g AS (SELECT vec_id, i - 1 AS pos, CAST(floor(CASE WHEN w[i] = 0 THEN 0 ELSE least(greatest((v[i] - lo[i]) / w[i], 0), 1) END * {levels}) AS INTEGER) AS code, lo[i] AS a, w[i] AS b FROM k JOIN e USING (vec_id), r) "


for _bits in (8, 4):

    @query(f"scalar_codes_{_bits}", _sq((1 << _bits) - 1) + f"SELECT vec_id, pos, code, round(a + b * (code + 0.5) / {(1 << _bits) - 1}, 5) AS x FROM g")
    def _scalar(spark, d, bits=_bits):
        trained = codecs.ranges(rows(spark, d))
        coded = codecs.decode(codecs.encode(rows(spark, d), trained, bits), trained, bits)
        out = coded.select("vec_id", F.posexplode(F.arrays_zip("code", "decoded")).alias("pos", "z")).select("vec_id", F.col("pos").cast("long").alias("pos"), "z.code", F.col("z.decoded").alias("x"))
        return _rounded(out, "x")


@query("rowwise_codes", "SELECT vec_id, round(lo, 5) AS low, round(w, 5) AS scale, pos, CAST(floor(CASE WHEN w = 0 THEN 0 ELSE (x - lo) / w END * 255) AS INTEGER) AS code FROM (SELECT vec_id, list_min(v) AS lo, list_max(v) - list_min(v) AS w, unnest(generate_series(0, 63)) AS pos, unnest(v) AS x FROM e)")
def rowwise_codes(spark, d):
    coded = codecs.rowwise(rows(spark, d))
    out = coded.select("vec_id", "low", "scale", F.posexplode("code").alias("pos", "code")).withColumn("pos", F.col("pos").cast("long"))
    return _rounded(out, "low", "scale")


@query("refine", _sq(255) + ", y AS (SELECT vec_id, list(a + b * (code + 0.5) / 255 ORDER BY pos) AS dv FROM g GROUP BY vec_id), m AS (SELECT q_id, vec_id FROM (SELECT q_id, vec_id, row_number() OVER (PARTITION BY q_id ORDER BY list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(qv, dv)]), vec_id) AS r FROM q, y) WHERE r <= 20) SELECT q_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score, vec_id) AS rank FROM (SELECT m.q_id, m.vec_id, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(qv, v)]) AS score FROM m JOIN q USING (q_id) JOIN e USING (vec_id))) WHERE rank <= 5")
def refine(spark, d):
    """Search on decoded 8-bit codes for four times k, then exact distances."""
    trained = codecs.ranges(rows(spark, d))
    decoded = codecs.decode(codecs.encode(rows(spark, d), trained), trained).select("vec_id", F.col("decoded").alias("embedding"))
    return _rounded(search.refine(asked(spark, d), search.knn(asked(spark, d), decoded, 20), rows(spark, d), 5), "score")


WORDS = "& b AS (SELECT vec_id, CAST(sum(CASE WHEN v[i] >= 0 THEN 1::BIGINT << CAST((i - 1) % 32 AS INTEGER) ELSE 0 END) FILTER (i <= 32) AS BIGINT) AS w0, CAST(sum(CASE WHEN v[i] >= 0 THEN 1::BIGINT << CAST((i - 1) % 32 AS INTEGER) ELSE 0 END) FILTER (i > 32) AS BIGINT) AS w1 FROM e, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY vec_id), hm AS (SELECT q.vec_id AS q_id, x.vec_id, CAST(bit_count(xor(q.w0, x.w0)) + bit_count(xor(q.w1, x.w1)) AS BIGINT) AS score, q.w0 AS qw, x.w0 AS xw FROM b q, b x WHERE q.vec_id % 100 = 0) "


def _coded(spark, d) -> DataFrame:
    return codecs.binary(rows(spark, d), DIM)


def _hamming(spark, d) -> DataFrame:
    """Every query against every code: the codes of the queries are few (a hundredth, 16 bytes each) next to the data."""
    coded = _coded(spark, d).select("vec_id", "words")
    asked_ = coded.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("words").alias("q"))
    return asked_, coded


@query("sign_words", WORDS + "SELECT vec_id, w0, w1 FROM b")
def sign_words(spark, d):
    return _coded(spark, d).select("vec_id", F.col("words")[0].alias("w0"), F.col("words")[1].alias("w1"))


@query("binary_hash", WORDS + "SELECT q_id, vec_id, score FROM hm WHERE bit_count(xor(qw, xw) & 255) <= 2 AND score < 30")
def binary_hash(spark, d):
    q, coded = _hamming(spark, d)
    return codecs.hamming_pairs(q.withColumnRenamed("q", "words"), coded, 2, 8).where("score < 30")


@query("binary_knn", WORDS + "SELECT q_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score, vec_id) AS rank FROM hm) WHERE rank <= 5")
def binary_knn(spark, d):
    q, coded = _hamming(spark, d)
    hits = search.knn(q.select("q_id", F.col("q").alias("embedding")), coded.withColumnRenamed("words", "embedding"), 5, "hamming")
    return hits.withColumn("score", F.col("score").cast("long"))


@query("binary_range", WORDS + "SELECT q_id, vec_id, score FROM hm WHERE score < 25")
def binary_range(spark, d):
    q, coded = _hamming(spark, d)
    hits = search.within(q.select("q_id", F.col("q").alias("embedding")), coded.withColumnRenamed("words", "embedding"), 25, "hamming")
    return hits.withColumn("score", F.col("score").cast("long"))


@query("hamming_histogram", WORDS + "SELECT score, count(*) AS n FROM hm GROUP BY score")
def hamming_histogram(spark, d):
    q, coded = _hamming(spark, d)
    counted = search.histogram(q.select("q_id", F.col("q").alias("embedding")), coded.withColumnRenamed("words", "embedding"))
    return counted.select(F.col("score").cast("long").alias("score"), "n")


@query("distinct_codes", WORDS + "SELECT w0, w1, min(vec_id) AS vec_id FROM b GROUP BY w0, w1")
def distinct_codes(spark, d):
    return _coded(spark, d).groupBy("words").agg(F.min("vec_id").alias("vec_id")).select(F.col("words")[0].alias("w0"), F.col("words")[1].alias("w1"), "vec_id")


@query("median_bits", "& md AS (SELECT i, quantile_cont(v[i], 0.5) AS m FROM e, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY i) SELECT vec_id, CAST(count(*) FILTER (v[i] - m >= 0) AS BIGINT) AS ones FROM e, md GROUP BY vec_id")
def median_bits(spark, d):
    """Bits of each vector above the components' medians."""
    mid = codecs.medians(rows(spark, d))
    coded = codecs.binary(rows(spark, d).join(F.broadcast(mid)), DIM, F.col("middle"))
    return coded.select("vec_id", F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w).cast("long")).alias("ones"))


# --- evaluation -------------------------------------------------------------------------------------------------------

EVAL = PROBES + f", gt AS ({_top(SQL_METRIC['l2'], 10)})"


def _truth(spark, d):
    return search.knn(asked(spark, d), rows(spark, d), 10)


def _found(spark, d):
    return search.ivf(asked(spark, d), centroids(spark, d), lists(spark, d), 10, 3)


@query("recall_at_1", EVAL + "SELECT round(avg(CASE WHEN t.vec_id IS NULL THEN 0.0 ELSE 1.0 END), 5) AS recall FROM gt LEFT JOIN t ON t.q_id = gt.q_id AND t.vec_id = gt.vec_id AND t.rank <= 1 WHERE gt.rank = 1")
def recall_at_1(spark, d):
    return _rounded(evaluate.recall_at(_truth(spark, d), _found(spark, d), 1), "recall")


@query("intersection_at_10", EVAL + "SELECT round(sum(CASE WHEN t.vec_id IS NULL THEN 0 ELSE 1 END) / 10.0 / count(DISTINCT gt.q_id), 5) AS share FROM gt LEFT JOIN t ON t.q_id = gt.q_id AND t.vec_id = gt.vec_id")
def intersection_at_10(spark, d):
    return _rounded(evaluate.intersection_at(_truth(spark, d), _found(spark, d), 10), "share")


@query("range_precision_recall", PROBES + ", a AS (SELECT q_id, vec_id, sc FROM (SELECT q_id, vec_id, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(qv, v)]) AS sc FROM q, e) WHERE sc < 1.6), f AS (SELECT * FROM s WHERE score < 1.7), x AS (SELECT q_id, (SELECT count(*) FROM a WHERE a.q_id = q.q_id) AS tn, (SELECT count(*) FROM f WHERE f.q_id = q.q_id) AS fn, (SELECT count(*) FROM a JOIN f ON a.q_id = f.q_id AND a.vec_id = f.vec_id WHERE a.q_id = q.q_id) AS bn FROM q) SELECT round(sum(bn) / sum(fn), 5) AS precision, round(sum(bn) / sum(tn), 5) AS recall, round(avg(CASE WHEN fn > 0 THEN bn / fn WHEN tn = 0 THEN 1.0 ELSE 0.0 END), 5) AS mean_precision, round(avg(CASE WHEN tn > 0 THEN bn / tn ELSE 1.0 END), 5) AS mean_recall FROM x")
def range_precision_recall(spark, d):
    truth = search.within(asked(spark, d), rows(spark, d), 1.6)
    found = scored(spark, d, radius=1.7).select("q_id", "vec_id", "score")
    return _rounded(evaluate.precision_recall(truth, found, asked(spark, d)), "precision", "recall", "mean_precision", "mean_recall")


@query("pareto_frontier", "WITH p AS (SELECT p_size AS perf, min(p_retailprice) AS time FROM part WHERE p_size > 0 GROUP BY p_size) SELECT perf, time FROM (SELECT *, min(time) OVER (ORDER BY perf DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p) WHERE best IS NULL OR time <= best", tables=False)
def pareto(spark, d):
    """Operating points: size as performance, price as time."""
    return evaluate.frontier(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_size").alias("perf"), F.col("p_retailprice").alias("time")))


# --- text and workflows -----------------------------------------------------------------------------------------------

ENC = """WITH t AS (SELECT doc_id AS id, 0 AS kind, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark),
w AS (SELECT id, kind, CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) % 64 AS b FROM (SELECT id, kind, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS word FROM t)),
n AS (SELECT id, kind, b, count(*) AS c FROM w GROUP BY ALL), l AS (SELECT id, kind, sqrt(sum(c * c)) AS len FROM n GROUP BY ALL),
u AS (SELECT n.id, n.kind, b, c / len AS x FROM n JOIN l ON n.id = l.id AND n.kind = l.kind),
hit AS (SELECT q.id AS q_id, d.id AS vec_id, sum(q.x * d.x) AS score FROM u q JOIN u d ON q.b = d.b WHERE q.kind = 1 AND d.kind = 0 GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM hit) WHERE rank <= 3)
"""


def _texts(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs, T.encode(docs, "doc_id", "text")


def _questions(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("id"), F.col("text").alias("question"))


def corpus(spark, d) -> workflow.Corpus:
    docs, encoded = _texts(spark, d)
    joined = encoded.select(F.col("id").alias("vec_id"), "embedding").join(docs.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    return workflow.stored(joined, lambda r: T.encode(r, "id", "text"), new_folder(spark, "corpus"))


@query("hash_encoder", "WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS ws FROM documents), n AS (SELECT id, b, count(*) AS c FROM (SELECT id, CAST(('0x' || substr(md5(unnest(ws)), 1, 8)) AS BIGINT) % 64 AS b FROM t) GROUP BY ALL) SELECT n.id, b AS pos, round(c / len, 5) AS x FROM n JOIN (SELECT id, sqrt(sum(c * c)) AS len FROM n GROUP BY id) USING (id)", tables=False)
def hash_encoder(spark, d):
    out = _texts(spark, d)[1].select("id", F.posexplode("embedding").alias("pos", "x")).where("x <> 0")
    return _rounded(out.withColumn("pos", F.col("pos").cast("long")), "x")


@query("retrieve_documents", ENC + "SELECT q_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM top", tables=False)
def retrieve_documents(spark, d):
    questions = T.encode(_questions(spark, d), "id", "question").select(F.col("id").alias("q_id"), "embedding")
    near = search.knn(questions, _texts(spark, d)[1].select(F.col("id").alias("vec_id"), "embedding"), 3, "inner_product", digits=9)
    return _rounded(near.where("score > 0"), "score")


@query("bm25_search", """WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS ws FROM documents),
p AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(ws) AS term FROM d) GROUP BY ALL), dl AS (SELECT id, len(ws) AS dl FROM d WHERE len(ws) > 0),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
qq AS (SELECT DISTINCT item_id AS q_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS term FROM benchmark),
s AS (SELECT q_id, p.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qq JOIN df USING (term) JOIN p USING (term) JOIN dl USING (id), st GROUP BY ALL)
SELECT q_id, id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 3""", tables=False)
def bm25_search(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    q = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("q_id"), "text")
    return _rounded(text_search.find(q, docs, 3), "score")


@query("middle_out", "SELECT doc_id, CASE WHEN len(w) <= 20 THEN text ELSE array_to_string(list_concat(w[1:10], w[-10:]), ' ') END AS prompt FROM (SELECT doc_id, text, regexp_split_to_array(trim(text, ' '), '\\s+') AS w FROM documents)", tables=False)
def middle_out(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.middle_out(F.col("text"), 20).alias("prompt"))


def _sql_encoded(name: str) -> str:
    """Unit vectors {name}_u (id, b, x) of the texts {name} (id, text)."""
    return f"""{name}_n AS (SELECT id, b, count(*) AS c FROM (SELECT id, CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) % 64 AS b FROM (SELECT id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS word FROM {name})) GROUP BY ALL),
    {name}_u AS (SELECT id, b, c / len AS x FROM {name}_n JOIN (SELECT id, sqrt(sum(c * c)) AS len FROM {name}_n GROUP BY id) USING (id))"""


def _sql_retrieved(name: str, k: int) -> str:
    """{name}_r (id, refs): the documents found for the texts {name} (id, text), as a prompt shows them."""
    return _sql_encoded(name) + f""", {name}_r AS (SELECT q_id AS id, string_agg('Doc ' || rank || '(Title: ' || split_part(text, chr(10), 1) || ') ' || substr(text, len(split_part(text, chr(10), 1)) + 2) || chr(10), '' ORDER BY rank) AS refs
    FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.id AS q_id, d.id AS vec_id, round(sum(q.x * d.x), 9) AS score FROM {name}_u q JOIN d_u d USING (b) GROUP BY ALL)) JOIN d ON d.id = vec_id WHERE rank <= {k} GROUP BY q_id)"""


def _sql_said(prompt: str) -> str:
    """The built-in generator."""
    return f"array_to_string(regexp_split_to_array(trim({prompt}, ' '), '\\s+')[-12:], ' ')"


def _sql_answer(question: str = "question") -> str:
    return _sql_said(f"'Documents:' || chr(10) || refs || 'Question: ' || {question}")


SQL_DOCS = "WITH d AS (SELECT doc_id AS id, text FROM documents), " + _sql_encoded("d") + ", q0 AS (SELECT item_id AS id, text AS question, text FROM benchmark), "
SQL_SEQUENTIAL = lambda k: _sql_retrieved("q0", k) + f", sequential AS (SELECT id, {_sql_answer()} AS answer FROM q0 JOIN q0_r USING (id))"
SQL_COMPRESSED = f"s1 AS (SELECT id, question, {_sql_said("'Summarise for: ' || question || chr(10) || refs")} AS step FROM q0 JOIN q0_r USING (id)), recomp AS (SELECT id, {_sql_said("'Summary: ' || step || chr(10) || 'Question: ' || question")} AS answer FROM s1)"
SQL_RECOMP = _sql_retrieved("q0", 1) + ", " + SQL_COMPRESSED
SQL_HYDE = f"q1 AS (SELECT id, question, {_sql_said("'Write a passage for: ' || question")} AS text FROM q0), " + _sql_retrieved("q1", 1) + f", hyde AS (SELECT id, {_sql_answer()} AS answer FROM q1 JOIN q1_r USING (id))"
SQL_ITERATIVE = _sql_retrieved("q0", 1) + f", q1 AS (SELECT id, {_sql_answer()} AS text FROM q0 JOIN q0_r USING (id)), " + _sql_retrieved("q1", 1) + f", iterative AS (SELECT id, q1.text || {_sql_answer('q1.text')} AS answer FROM q1 JOIN q1_r USING (id))"
SQL_ASK = _sql_said("'Earlier: ' || reasoning || chr(10) || 'Next question for: ' || question")
SQL_MULTISTEP = (
    f"q1 AS (SELECT id, question, reasoning, {SQL_ASK} AS text FROM (SELECT *, '' AS reasoning FROM q0)), " + _sql_retrieved("q1", 1)
    + f", a1 AS (SELECT id, question, text, {_sql_answer('text')} AS step FROM q1 JOIN q1_r USING (id) WHERE NOT contains(text, 'None')), q2 AS (SELECT id, question, step, {SQL_ASK} AS text FROM (SELECT id, question, step, text || ' ' || step || chr(10) AS reasoning FROM a1)), "
    + _sql_retrieved("q2", 1) + f", a2 AS (SELECT id, {_sql_answer('text')} AS answer FROM q2 JOIN q2_r USING (id) WHERE NOT contains(text, 'None')), multistep AS (SELECT * FROM a2 UNION ALL SELECT id, '' FROM q1 WHERE contains(text, 'None') UNION ALL SELECT id, step FROM q2 WHERE contains(text, 'None'))"
)


def _sql_workflow(name: str, chain: str) -> str:
    return SQL_DOCS + chain + f" SELECT id, '{name}' AS workflow, answer FROM {name}"


@query("workflow_sequential", _sql_workflow("sequential", SQL_SEQUENTIAL(2)), tables=False)
def workflow_sequential(spark, d):
    return workflow.run(_questions(spark, d), workflow.sequential(2), corpus(spark, d))


@query("workflow_hyde", _sql_workflow("hyde", SQL_HYDE), tables=False)
def workflow_hyde(spark, d):
    return workflow.run(_questions(spark, d), workflow.hyde(), corpus(spark, d))


@query("workflow_recomp", _sql_workflow("recomp", SQL_RECOMP), tables=False)
def workflow_recomp(spark, d):
    return workflow.run(_questions(spark, d), workflow.recomp(), corpus(spark, d))


@query("workflow_iterative", _sql_workflow("iterative", SQL_ITERATIVE), tables=False)
def workflow_iterative(spark, d):
    return workflow.run(_questions(spark, d), workflow.iterative(1, 2), corpus(spark, d))


@query("workflow_multistep", _sql_workflow("multistep", SQL_MULTISTEP), tables=False)
def workflow_multistep(spark, d):
    return workflow.run(_questions(spark, d), workflow.multistep(1, 2), corpus(spark, d))


@query("workflow_mixed", SQL_DOCS + SQL_SEQUENTIAL(1) + ", " + SQL_COMPRESSED + " SELECT id, 'sequential' AS workflow, answer FROM sequential WHERE id % 4 < 1 UNION ALL SELECT id, 'recomp', answer FROM recomp WHERE id % 4 >= 1", tables=False)
def workflow_mixed(spark, d):
    flows = {"sequential": workflow.sequential(), "recomp": workflow.recomp()}
    requests = _questions(spark, d).withColumn("workflow", F.when(F.col("id") % 4 < 1, "sequential").otherwise("recomp"))
    return workflow.run_mixed(requests, flows, corpus(spark, d))


@query("workflow_graph", _sql_workflow("multistep", SQL_MULTISTEP).replace("'multistep' AS workflow, answer", "'multistep_graph' AS workflow, answer"), tables=False)
def workflow_graph(spark, d):
    """The multi-step workflow as a graph with a conditional edge and one that leads back."""
    return graph.run(_questions(spark, d), graph.multistep(1, 2), corpus(spark, d), rounds=4).drop("passed")


# --- events -----------------------------------------------------------------------------------------------------------


@query("event_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL", tables=False)
def event_windows(spark, d):
    return _rounded(windows.windowed(spark.read.parquet(f"{d}/events.parquet")), "value", digits=4)


@query("event_sessions", "SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s", tables=False)
def event_sessions(spark, d):
    return windows.sessions(spark.read.parquet(f"{d}/events.parquet"))


@query("arrivals", "SELECT event_id AS id, round(sum(-ln(1 - CAST(('0x' || substr(md5(event_id || '|2025'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE) / 8) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 5) AS start_time FROM events", tables=False)
def arrivals(spark, d):
    """Start times of a request for each event, at eight a second."""
    requests = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"))
    return _rounded(windows.arrivals(requests, 8.0), "start_time")


@query("kmeans")
def kmeans(spark, d):
    """Centroids of ten clusters of all vectors after eight rounds."""
    c, _ = clustering.kmeans(rows(spark, d), 10, 8, per_cluster=None)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "list_no int, embedding array<double>")


@query("pca")
def pca(spark, d):
    """Eight principal components of every vector."""
    matrix, mean = clustering.pca(rows(spark, d), 8)
    centered_ = V.subtract(F.col("embedding"), F.array(*[F.lit(float(m)) for m in mean]))
    return rows(spark, d).select("vec_id", V.linear(centered_, matrix.tolist()).alias("embedding"))


from vectide import catalog_index, catalog_more  # noqa: E402, F401  register more queries
