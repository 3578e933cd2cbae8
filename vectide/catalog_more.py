"""More queries over the driver tables: codes and quantisers, list maintenance, selectors, evaluation, prompts.

As in catalog.py, searches ask with every embedding whose id is divisible by 100 and look at all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.catalog import PROBES, SQL_METRIC, WORDS, _hamming, _range, _rounded, _sq, _top, asked, centroids, lists, probed, query, rows
from vectide.functions import text as T
from vectide.functions import vectors as V
from vectide.operators import codecs, evaluate, index, quantizers, search, transforms
from vectide.sources.written import written

L2 = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip({}, {})])"
PART = "v[sub * 8 + 1 : sub * 8 + 8]"


def _as_long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# --- vectors ----------------------------------------------------------------------------------------------------------


@query("ip_to_l2", f"SELECT vec_id, round({L2.format('v', 'cv')}, 5) AS score FROM e JOIN c ON label = list_no")
def ip_to_l2(spark, d):
    """Squared distances from norms and inner products."""
    joined = rows(spark, d).join(centroids(spark, d).select(F.col("list_no").alias("label"), F.col("embedding").alias("c")), "label")
    return _rounded(joined.select("vec_id", V.l2_from_inner_product(F.col("embedding"), F.col("c")).alias("score")), "score")


@query("k_extremes", "SELECT vec_id, i - 1 AS pos, round(list_sort(v)[i], 5) AS low, round(list_reverse_sort(v)[i], 5) AS high FROM e, (SELECT unnest(generate_series(1, 3)) AS i)")
def k_extremes(spark, d):
    """The three smallest and largest components of each vector."""
    v = F.col("embedding")
    zipped = F.arrays_zip(V.k_smallest(v, 3).alias("low"), V.k_largest(v, 3).alias("high"))
    out = rows(spark, d).select("vec_id", F.posexplode(zipped).alias("pos", "z")).select("vec_id", "pos", "z.low", "z.high")
    return _rounded(_as_long(out, "pos"), "low", "high")


@query("vector_checksum", "SELECT vec_id, CAST(list_sum([CAST(floor(v[i] * 1048576.0) AS BIGINT) * i FOR i IN generate_series(1, 64)]) AS BIGINT) AS checksum FROM e")
def vector_checksum(spark, d):
    return index.checksum(rows(spark, d))


@query("random_rotation", "SELECT vec_id, 64 AS size, round(list_sum([x * x FOR x IN v]), 4) AS squared FROM e")
def random_rotation(spark, d):
    """A rotation keeps lengths."""
    turned = transforms.apply(rows(spark, d), transforms.random_rotation(64, seed=5))
    return _rounded(turned.select("vec_id", F.size("embedding").alias("size"), V.squared_norm(F.col("embedding")).alias("squared")), "squared", digits=4)


CHAIN = "& y AS (SELECT vec_id, [x / sqrt(list_sum([w * w FOR w IN h])) FOR x IN h] AS u FROM (SELECT vec_id, v[1:16] AS h FROM e)) "


@query("transform_chain_knn", CHAIN + f"SELECT q_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score, vec_id) AS rank FROM (SELECT a.vec_id AS q_id, b.vec_id, {L2.format('a.u', 'b.u')} AS score FROM y a, y b WHERE a.vec_id % 100 = 0)) WHERE rank <= 5")
def transform_chain_knn(spark, d):
    """A chain of transforms before the search: crop, then unit length."""
    chain = transforms.Chain([lambda v: V.remap(v, 64, 16), V.normalized])
    return _rounded(search.knn(chain(asked(spark, d)), chain(rows(spark, d)), 5), "score")


@query("flat_1d", "WITH s AS (SELECT s_suppkey AS q_id, s_acctbal AS a FROM supplier), x AS (SELECT p_partkey AS vec_id, p_retailprice AS b FROM part) SELECT q_id, vec_id, round(gap, 4) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY gap, vec_id) AS r FROM (SELECT q_id, vec_id, abs(a - b) AS gap FROM s, x)) WHERE r = 1", tables=False)
def flat_1d(spark, d):
    """The nearest value in one dimension: parts by price for every supplier's balance."""
    values = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("vec_id"), F.col("p_retailprice").alias("x"))
    q = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("q_id"), F.col("s_acctbal").alias("x"))
    return search.nearest_values(q, values, 1).select("q_id", "vec_id", F.round("score", 4).alias("gap"))


# --- selectors and lists ------------------------------------------------------------------------------------------------


@query("knn_selector_bitmap", _top(SQL_METRIC["l2"], 5, where="e.vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def knn_bitmap(spark, d):
    chosen = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return _rounded(search.knn(asked(spark, d), index.in_bitmap(rows(spark, d), index.bitmap_of(chosen)), 5), "score")


@query("ivf_selector", PROBES + "SELECT q_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score, vec_id) AS rank FROM s WHERE vec_id % 3 = 0) WHERE rank <= 5")
def ivf_selector(spark, d):
    return _rounded(search.ivf(asked(spark, d), centroids(spark, d), lists(spark, d), 5, 3, selector=F.col("vec_id") % 3 == 0).drop("list_no"), "score")


@query("range_selector", _range(SQL_METRIC["l2"], "score < 1.6 AND vec_id % 3 = 0"))
def range_selector(spark, d):
    return _rounded(search.within(asked(spark, d), rows(spark, d), 1.6, selector=F.col("vec_id") % 3 == 0), "score")


@query("ivf_stop_lists", PROBES + ", n AS (SELECT label FROM e GROUP BY label HAVING count(*) <= 50) SELECT q_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM (SELECT s.*, row_number() OVER (PARTITION BY q_id ORDER BY score, vec_id) AS rank FROM s JOIN n ON label = list_no) WHERE rank <= 5")
def ivf_stop_lists(spark, d):
    kept = index.without_long_lists(lists(spark, d), 50)
    return _rounded(search.ivf(asked(spark, d), centroids(spark, d), kept, 5, 3).drop("list_no"), "score")


@query("masked_lists", "SELECT vec_id, label AS list_no FROM e WHERE (label < 4 AND vec_id % 2 = 0) OR label >= 4")
def masked_lists(spark, d):
    x = lists(spark, d).select("vec_id", "list_no")
    return index.masked(x.where("list_no < 4 AND vec_id % 2 = 0"), x)


@query("stacked_lists", "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN label ELSE label + 10 END AS list_no FROM e")
def stacked_lists(spark, d):
    x = lists(spark, d).select("vec_id", "list_no")
    return index.stacked(x.where("vec_id % 2 = 0"), x.where("vec_id % 2 = 1"), 10)


@query("sliced_lists", "SELECT vec_id, label - 3 AS list_no FROM e WHERE label >= 3 AND label < 7")
def sliced_lists(spark, d):
    return index.sliced(lists(spark, d).select("vec_id", "list_no"), 3, 7)


@query("index_compatible", "& h AS (SELECT list_no, list(m ORDER BY i) AS hv FROM (SELECT label AS list_no, i, avg(v[i]) AS m FROM e, (SELECT unnest(generate_series(1, 64)) AS i) WHERE vec_id % 2 = 0 GROUP BY ALL) GROUP BY list_no) SELECT other, same_lists, round(gap, 5) AS largest_gap, same_lists AND gap <= 1e-9 AS compatible FROM (SELECT 'half' AS other, count(*) = count(hv) AS same_lists, max(list_max([abs(z[1] - z[2]) FOR z IN list_zip(cv, hv)])) AS gap FROM c LEFT JOIN h USING (list_no) UNION ALL SELECT 'itself', true, 0.0 FROM c LIMIT 2)")
def index_compatible(spark, d):
    """The coarse model against itself and against one trained on half of the rows."""
    whole, half = centroids(spark, d), index.centroids_of(rows(spark, d).where("vec_id % 2 = 0"))
    both = index.compatible(whole, half).withColumn("other", F.lit("half")).unionByName(index.compatible(whole, whole).withColumn("other", F.lit("itself")))
    return _rounded(both.select("other", "same_lists", "largest_gap", "compatible"), "largest_gap")


@query("dedup_expand", _top(SQL_METRIC["l2"], 5))
def dedup_expand(spark, d):
    """Search over one vector of each group of equal ones, then all of the group."""
    groups = index.duplicates(rows(spark, d))
    kept = rows(spark, d).join(groups.where("vec_id = representative").select("vec_id"), "vec_id", "left_semi")
    return _rounded(search.ranked(index.expanded(search.knn(asked(spark, d), kept, 5), groups), 5), "score")


# --- searches over lists ------------------------------------------------------------------------------------------------


@query("ivf_with_lists", PROBES + "SELECT t.q_id, t.vec_id, t.list_no, t.probe_rank AS probe, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM t")
def ivf_with_lists(spark, d):
    """Hits with the list that held them and its place among the query's probes."""
    hits = search.ivf(asked(spark, d), centroids(spark, d), lists(spark, d), 10, 3)
    with_probe = hits.join(probed(spark, d).select("q_id", "list_no", F.col("probe_rank").cast("long").alias("probe")), ["q_id", "list_no"])
    return _rounded(with_probe.select("q_id", "vec_id", "list_no", "probe", "rank", "score"), "score")


@query("ivf_reconstruct", PROBES + "SELECT q_id, vec_id, CAST(rank AS INTEGER) AS rank, i - 1 AS pos, round(v[i], 5) AS x FROM t JOIN e USING (vec_id), (SELECT unnest(generate_series(1, 64)) AS i) WHERE rank <= 2")
def ivf_reconstruct(spark, d):
    hits = search.ivf(asked(spark, d), centroids(spark, d), lists(spark, d), 2, 3)
    found = search.with_vectors(hits, rows(spark, d).select("vec_id", "embedding")).select("q_id", "vec_id", "rank", F.posexplode(V.doubles(F.col("embedding"))).alias("pos", "x"))
    return _rounded(_as_long(found, "pos"), "x")


@query("ivf_big_batch", PROBES + "SELECT q_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score, vec_id) AS rank FROM s WHERE list_no >= 2 AND list_no < 8) WHERE rank <= 5")
def ivf_big_batch(spark, d):
    """All queries of a list at once, for a range of lists: one step of a batch that goes list by list."""
    some = (F.col("list_no") >= 2) & (F.col("list_no") < 8)
    hits = search.scan_lists(asked(spark, d), probed(spark, d).where(some), lists(spark, d).where(some), k=5)
    return _rounded(search.ranked(hits.select("q_id", "vec_id", "score"), 5), "score")


@query("ivf_continued", PROBES + "SELECT q_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM t")
def ivf_continued(spark, d):
    """Two steps with as many probes as each query likes: none, one or two in the first, the rest in the second."""
    p = probed(spark, d)
    first = F.col("probe_rank") <= F.pmod(F.floor(F.col("q_id") / 100), F.lit(3))
    none = spark.createDataFrame([], "q_id long, vec_id long, score double")
    best = none
    for step in (p.where(first), p.where(~first)):
        best = search.continued(best, asked(spark, d), step, lists(spark, d), 10)
    return _rounded(best, "score")


@query("ivf_hot_and_cold", PROBES + "SELECT q_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM t")
def ivf_hot_and_cold(spark, d):
    """The three lists that most queries probe are kept in memory for two batches of queries, then released."""
    counts = probed(spark, d).groupBy("list_no").count()
    hot = written(counts.orderBy(F.desc("count"), "list_no").limit(3), "hot-lists")
    batches = [asked(spark, d).where(F.col("q_id") % 200 == i) for i in (0, 100)]
    with search.kept_lists(lists(spark, d), hot) as kept:
        found = [search.hot_and_cold(q, probed(spark, d).join(q.select("q_id"), "q_id", "left_semi"), lists(spark, d), kept, hot, 10) for q in batches]
    return _rounded(found[0].unionByName(found[1]), "score")


@query("ivf_other_quantizer", "& p AS (SELECT * FROM (SELECT q_id, qv, list_no, row_number() OVER (PARTITION BY q_id ORDER BY " + L2.format("qv[1:16]", "cv[1:16]") + ", list_no) AS r FROM q, c) WHERE r <= 3) SELECT q_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score, vec_id) AS rank FROM (SELECT q_id, vec_id, " + L2.format("qv", "v") + " AS score FROM p JOIN e ON label = list_no)) WHERE rank <= 5")
def ivf_other_quantizer(spark, d):
    """Lists are probed by the first 16 dimensions, their rows compared in all."""
    crop = transforms.Chain([lambda v: V.remap(v, 64, 16)])
    p = search.probes(crop(asked(spark, d)), crop(centroids(spark, d)), 3)
    hits = search.scan_lists(asked(spark, d), p, lists(spark, d), k=5)
    return _rounded(search.ranked(hits.select("q_id", "vec_id", "score"), 5), "score")


@query("speculation_accuracy", PROBES + ", g AS (SELECT q_id, vec_id, score, unnest(generate_series(probe_rank - 1, 2)) AS stage FROM s), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id, stage ORDER BY score, vec_id) AS rank FROM g) WHERE rank <= 5) SELECT round(avg(CASE WHEN a.ids = b.ids THEN 1.0 ELSE 0.0 END), 5) AS accuracy FROM (SELECT q_id, list(vec_id ORDER BY rank) AS ids FROM h WHERE stage = 0 GROUP BY q_id) a JOIN (SELECT q_id, list(vec_id ORDER BY rank) AS ids FROM h WHERE stage = 2 GROUP BY q_id) b USING (q_id)")
def speculation_accuracy(spark, d):
    found = search.scan_lists(asked(spark, d), probed(spark, d), lists(spark, d), k=5)
    return _rounded(search.speculation_accuracy(search.speculation(search.staged(found, 5, 1), 0)), "accuracy")


@query("knn_graph", "& s AS (SELECT a.vec_id, b.vec_id AS neighbour, " + L2.format("a.v", "b.v") + " AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id) SELECT vec_id, neighbour, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score, neighbour) AS rank FROM s) WHERE rank <= 4")
def knn_graph(spark, d):
    """The four nearest of every vector."""
    near = search.knn(rows(spark, d).select(F.col("vec_id").alias("q_id"), "embedding"), rows(spark, d), 5).where("q_id <> vec_id").drop("rank")
    return _rounded(search.ranked(near, 4).select(F.col("q_id").alias("vec_id"), F.col("vec_id").alias("neighbour"), "rank", "score"), "score")


# --- codes --------------------------------------------------------------------------------------------------------------

BOOKS = f"""& bk AS (SELECT list_no AS code, sub, list(m ORDER BY i) AS bv FROM (SELECT list_no, (i - 1) // 8 AS sub, i, m FROM cp) GROUP BY ALL),
pd AS (SELECT vec_id, bk.sub, code, bv, {L2.format('pv', 'bv')} AS dist FROM (SELECT vec_id, sub, {PART} AS pv FROM e, (SELECT unnest(generate_series(0, 7)) AS sub)) p JOIN bk ON p.sub = bk.sub),
pc AS (SELECT vec_id, sub, code, bv FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, sub ORDER BY dist, code) AS r FROM pd) WHERE r = 1)
"""


def _books(spark, d) -> DataFrame:
    return quantizers.from_groups(rows(spark, d), "label", 8, 64)


def _pq(spark, d) -> DataFrame:
    return quantizers.encode(rows(spark, d).select("vec_id", "embedding"), _books(spark, d))


@query("pq_codes", BOOKS + "SELECT vec_id, sub, CAST(code AS INTEGER) AS code, round(list_sum(bv), 4) AS part_sum FROM pc")
def pq_codes(spark, d):
    coded = quantizers.decode(_pq(spark, d), _books(spark, d))
    out = coded.select("vec_id", "decoded", F.posexplode("code").alias("sub", "code"))
    return _rounded(_as_long(out.select("vec_id", "sub", "code", V.total(F.slice("decoded", F.col("sub") * 8 + 1, F.lit(8))).alias("part_sum")), "sub"), "part_sum", digits=4)


@query("pq_knn", BOOKS + "SELECT q_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9), vec_id) AS rank FROM (SELECT a.vec_id AS q_id, b.vec_id, sum(a.dist) AS score FROM pd a JOIN pc b ON a.sub = b.sub AND a.code = b.code WHERE a.vec_id % 100 = 0 GROUP BY ALL)) WHERE rank <= 5")
def pq_knn(spark, d):
    return _rounded(quantizers.knn(asked(spark, d), _pq(spark, d), _books(spark, d), 5), "score")


RESIDUALS = f"""re AS (SELECT vec_id, label, [z[1] - z[2] FOR z IN list_zip(v, cv)] AS rv FROM e JOIN c ON label = list_no),
rb AS (SELECT k AS code, sub, list(m ORDER BY i) AS bv FROM (SELECT vec_id % 16 AS k, (i - 1) // 8 AS sub, i, avg(rv[i]) AS m FROM re, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY ALL) GROUP BY ALL),
rc AS (SELECT vec_id, label, sub, code FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, sub ORDER BY dist, code) AS r FROM (SELECT vec_id, label, rb.sub, code, {L2.format('rv[rb.sub * 8 + 1 : rb.sub * 8 + 8]', 'bv')} AS dist FROM re, rb)) WHERE r = 1),
qr AS (SELECT q_id, p.list_no, [z[1] - z[2] FOR z IN list_zip(qv, cv)] AS rv FROM p JOIN c USING (list_no)),
qt AS (SELECT q_id, list_no, rb.sub, code, {L2.format('rv[rb.sub * 8 + 1 : rb.sub * 8 + 8]', 'bv')} AS dist FROM qr, rb)
"""


def _residuals(spark, d) -> DataFrame:
    joined = lists(spark, d).join(centroids(spark, d).select("list_no", F.col("embedding").alias("c")), "list_no")
    return joined.select("vec_id", F.pmod("vec_id", F.lit(16)).alias("k"), V.subtract(F.col("embedding"), F.col("c")).alias("embedding"))


@query("ivf_pq_knn", PROBES + ", " + RESIDUALS + "SELECT q_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9), vec_id) AS rank FROM (SELECT q_id, vec_id, sum(dist) AS score FROM qt JOIN rc ON rc.label = qt.list_no AND rc.sub = qt.sub AND rc.code = qt.code GROUP BY ALL)) WHERE rank <= 5")
def ivf_pq_knn(spark, d):
    books = quantizers.from_groups(_residuals(spark, d), "k", 8, 64)
    coded = quantizers.residual_codes(lists(spark, d), centroids(spark, d), books)
    return _rounded(quantizers.ivf_knn(asked(spark, d), probed(spark, d), centroids(spark, d), coded, books, 5).drop("list_no"), "score")


@query("residual_quantizer", f"""& a AS (SELECT vec_id, list_no AS c1, [z[1] - z[2] FOR z IN list_zip(v, cv)] AS rv FROM (SELECT vec_id, v, list_no, cv, row_number() OVER (PARTITION BY vec_id ORDER BY {L2.format('v', 'cv')}, list_no) AS r FROM e, c) WHERE r = 1),
b2 AS (SELECT k, list(m ORDER BY i) AS bv FROM (SELECT vec_id % 16 AS k, i, avg(rv[i]) AS m FROM a, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY ALL) GROUP BY k)
SELECT vec_id, CAST(c1 AS INTEGER) AS c1, CAST(k AS INTEGER) AS c2, round(dist, 5) AS error FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, k) AS r FROM (SELECT vec_id, c1, k, {L2.format('rv', 'bv')} AS dist FROM a, b2)) WHERE r = 1""")
def residual_quantizer(spark, d):
    """Two additive codes: the nearest list's centroid, then the nearest of 16 means of what is left."""
    first = quantizers.from_groups(rows(spark, d), "label", 1, 64)
    left = quantizers.residual_steps(rows(spark, d), [first]).withColumn("k", F.pmod("vec_id", F.lit(16)))
    second = quantizers.from_groups(left, "k", 1, 64)
    coded = quantizers.residual_steps(rows(spark, d), [first, second])
    return _rounded(coded.select("vec_id", F.col("codes")[0].alias("c1"), F.col("codes")[1].alias("c2"), V.squared_norm(F.col("embedding")).alias("error")), "error")


@query("product_probes", f"& hb AS (SELECT list_no, half, list(m ORDER BY i) AS bv FROM (SELECT list_no, (i - 1) // 32 AS half, i, m FROM cp) GROUP BY ALL), hd AS (SELECT q_id, half, list_no, {L2.format('qv[half * 32 + 1 : half * 32 + 32]', 'bv')} AS dist FROM q, hb) SELECT q_id, list_no, round(score, 5) AS score, CAST(probe_rank AS INTEGER) AS probe_rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score, list_no) AS probe_rank FROM (SELECT a.q_id, CAST(a.list_no * 10 + b.list_no AS BIGINT) AS list_no, a.dist + b.dist AS score FROM hd a JOIN hd b ON a.q_id = b.q_id AND a.half = 0 AND b.half = 1)) WHERE probe_rank <= 6")
def product_probes(spark, d):
    return _rounded(quantizers.product_probes(asked(spark, d), quantizers.from_groups(rows(spark, d), "label", 2, 64), 6), "score")


def _shown(coded: DataFrame) -> DataFrame:
    out = coded.select("vec_id", F.posexplode(F.arrays_zip("code", "decoded")).alias("pos", "z")).select("vec_id", "pos", "z.code", F.col("z.decoded").alias("x"))
    return _rounded(_as_long(out, "pos"), "x")


def _ranged(name: str, bits: int, low: str, width: str, trained) -> None:
    n = (1 << bits) - 1
    own = f"& t AS (SELECT i, {low} AS lo, {width} AS w FROM e, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY i), g AS (SELECT vec_id, i - 1 AS pos, CAST(floor(CASE WHEN w = 0 THEN 0 ELSE least(greatest((v[i] - lo) / w, 0), 1) END * {n}) AS INTEGER) AS code, lo, w FROM e, t) SELECT vec_id, pos, code, round(lo + w * (code + 0.5) / {n}, 5) + 0.0 AS x FROM g"

    @query(name, own)
    def run(spark, d):
        ranges = trained(rows(spark, d))
        return _shown(codecs.decode(codecs.encode(rows(spark, d), ranges, bits), ranges, bits))


_ranged("scalar_codes_6", 6, "min(v[i])", "max(v[i]) - min(v[i])", codecs.ranges)
_ranged("scalar_quantiles", 8, "quantile_cont(v[i], 0.05)", "quantile_cont(v[i], 0.95) - quantile_cont(v[i], 0.05)", lambda x: codecs.quantile_ranges(x, 0.05))
_ranged("scalar_deviations", 8, "avg(v[i]) - 2 * stddev_pop(v[i])", "4 * stddev_pop(v[i])", lambda x: codecs.deviation_ranges(x, 2.0))


@query("scalar_uniform", "& t AS (SELECT min(list_min(v)) AS lo, max(list_max(v)) - min(list_min(v)) AS w FROM e), g AS (SELECT vec_id, i - 1 AS pos, CAST(floor((v[i] - lo) / w * 255) AS INTEGER) AS code, lo, w FROM e, t, (SELECT unnest(generate_series(1, 64)) AS i)) SELECT vec_id, pos, code, round(lo + w * (code + 0.5) / 255, 5) AS x FROM g")
def scalar_uniform(spark, d):
    trained = codecs.uniform_range(codecs.ranges(rows(spark, d)))
    return _shown(codecs.decode(codecs.encode(rows(spark, d), trained), trained))


@query("reconstruct_by_id", _sq(255) + "SELECT vec_id, pos, round(a + b * (code + 0.5) / 255, 5) AS x FROM g WHERE vec_id BETWEEN 10 AND 14 OR vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def reconstruct_by_id(spark, d):
    """Decoded vectors of a range of ids and of a list of ids."""
    trained = codecs.ranges(rows(spark, d))
    coded = codecs.encode(rows(spark, d), trained)
    listed = spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    wanted = rows(spark, d).where("vec_id BETWEEN 10 AND 14").select("vec_id").union(listed).distinct()
    out = codecs.decode(coded.join(wanted, "vec_id", "left_semi"), trained).select("vec_id", F.posexplode("decoded").alias("pos", "x"))
    return _rounded(_as_long(out, "pos"), "x")


@query("packed_codes", _sq(15) + "SELECT vec_id, pos // 8 AS word_no, CAST(sum(code * (1::BIGINT << CAST(4 * (pos % 8) AS INTEGER))) AS BIGINT) AS word, CAST(sum(code) AS BIGINT) AS codes FROM g GROUP BY ALL")
def packed_codes(spark, d):
    """Four-bit codes packed by eight, and their sums after unpacking."""
    coded = codecs.encode(rows(spark, d), codecs.ranges(rows(spark, d)), 4).withColumn("words", codecs.packed(F.col("code"), 4))
    back = coded.select("vec_id", "words", codecs.unpacked(F.col("words"), 4, 64).alias("code")).select("vec_id", "code", F.posexplode("words").alias("word_no", "word"))
    total = F.aggregate(F.slice("code", F.col("word_no") * 8 + 1, F.lit(8)), F.lit(0).cast("long"), lambda s, c: s + c)
    return _as_long(back.select("vec_id", "word_no", "word", total.alias("codes")), "word_no")


@query("add_codes", _sq(255) + "SELECT vec_id, code FROM g WHERE pos = 0 UNION ALL SELECT vec_id + 100000, code FROM g WHERE pos = 0 AND vec_id < 20")
def add_codes(spark, d):
    """Codes made elsewhere join a coded table without being decoded."""
    coded = codecs.encode(rows(spark, d), codecs.ranges(rows(spark, d)))
    return index.merged(coded, coded.where("vec_id < 20"), 100_000).select("vec_id", F.col("code")[0].alias("code"))


@query("binary_multi_hash", WORDS + "SELECT q_id, vec_id, score FROM hm WHERE (bit_count(xor(qw, xw) & 255) <= 1 OR bit_count((xor(qw, xw) >> 8) & 255) <= 1) AND score < 30")
def binary_multi_hash(spark, d):
    q, coded = _hamming(spark, d)
    return codecs.multi_hash_pairs(q.withColumnRenamed("q", "words"), coded, 1, 8, 2).where("score < 30")


@query("binary_ivf", WORDS + ", cw AS (SELECT list_no, CAST(sum(CASE WHEN m >= 0 THEN 1::BIGINT << CAST((i - 1) % 32 AS INTEGER) ELSE 0 END) FILTER (i <= 32) AS BIGINT) AS c0, CAST(sum(CASE WHEN m >= 0 THEN 1::BIGINT << CAST((i - 1) % 32 AS INTEGER) ELSE 0 END) FILTER (i > 32) AS BIGINT) AS c1 FROM cp GROUP BY list_no), bp AS (SELECT * FROM (SELECT vec_id AS q_id, list_no, row_number() OVER (PARTITION BY vec_id ORDER BY bit_count(xor(w0, c0)) + bit_count(xor(w1, c1)), list_no) AS r FROM b, cw WHERE vec_id % 100 = 0) WHERE r <= 2) SELECT q_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT hm.q_id, hm.vec_id, score, row_number() OVER (PARTITION BY hm.q_id ORDER BY score, hm.vec_id) AS rank FROM hm JOIN e USING (vec_id) JOIN bp ON bp.q_id = hm.q_id AND bp.list_no = label) WHERE rank <= 5")
def binary_ivf(spark, d):
    """Inverted lists of binary codes: two lists by Hamming distance to the centroids' signs, then the codes in them."""
    q, coded = _hamming(spark, d)
    q = q.select("q_id", F.col("q").alias("embedding"))
    p = search.probes(q, centroids(spark, d).select("list_no", V.sign_words(F.col("embedding"), 64).alias("embedding")), 2, "hamming")
    listed = lists(spark, d).select("vec_id", "list_no").join(coded.select("vec_id", F.col("words").alias("embedding")), "vec_id")
    hits = search.scan_lists(q, p, listed, "hamming", k=5).select("q_id", "vec_id", F.col("score").cast("long").alias("score"))
    return search.ranked(hits, 5)


@query("lsh_knn", "& md AS (SELECT i, quantile_cont(v[i], 0.5) AS m FROM e, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY i), b AS (SELECT vec_id, i, v[i] - m >= 0 AS bit FROM e, md), h AS (SELECT x.vec_id AS q_id, y.vec_id, CAST(count(*) FILTER (x.bit <> y.bit) AS BIGINT) AS score FROM b x JOIN b y ON x.i = y.i WHERE x.vec_id % 100 = 0 GROUP BY ALL) SELECT q_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score, vec_id) AS rank FROM h) WHERE rank <= 5")
def lsh_knn(spark, d):
    """Bits above the trained medians, searched by Hamming distance."""
    coded = codecs.binary(rows(spark, d).join(F.broadcast(codecs.medians(rows(spark, d)))), 64, F.col("middle")).select("vec_id", F.col("words").alias("embedding"))
    hits = search.knn(coded.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), "embedding"), coded, 5, "hamming")
    return hits.withColumn("score", F.col("score").cast("long"))


# --- evaluation ---------------------------------------------------------------------------------------------------------


@query("precision_recall_at", "& s AS (SELECT q_id, vec_id, label, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(qv, v)]) AS score FROM q, e), t AS (SELECT unnest([1.5, 1.7, 1.9]) AS threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, round(CASE WHEN n > 0 THEN good / n ELSE 1.0 END, 5) AS precision, round(good / total, 5) AS recall FROM (SELECT threshold, count(*) FILTER (score < threshold) AS n, count(*) FILTER (score < threshold AND score < 1.6) AS good, count(*) FILTER (score < 1.6) AS total FROM s, t GROUP BY threshold)")
def precision_recall_at(spark, d):
    """Range results at growing thresholds against the truth at radius 1.6."""
    found = search.within(asked(spark, d), rows(spark, d), 2.0)
    thresholds = spark.createDataFrame([(1.5,), (1.7,), (1.9,)], "threshold double")
    return _rounded(evaluate.precision_recall_at(found.where("score < 1.6"), found, thresholds), "precision", "recall")


@query("same_modulo_ties", "SELECT q_id, true AS same FROM q")
def same_modulo_ties(spark, d):
    """One search against the merged searches of its shards."""
    parts = [search.knn(asked(spark, d), rows(spark, d).where(F.col("vec_id") % 2 == i), 10) for i in range(2)]
    return evaluate.same_modulo_ties(search.knn(asked(spark, d), rows(spark, d), 10), search.merged(parts, 10))


@query("nprobe_sweep", "& p AS (SELECT q_id, qv, list_no, row_number() OVER (PARTITION BY q_id ORDER BY " + L2.format("qv", "cv") + ", list_no) AS pr FROM q, c), s AS (SELECT q_id, vec_id, pr, " + L2.format("qv", "v") + " AS score FROM p JOIN e ON label = list_no), gt AS (SELECT q_id, vec_id FROM (SELECT q_id, vec_id, row_number() OVER (PARTITION BY q_id ORDER BY score, vec_id) AS r FROM s) WHERE r <= 10), n AS (SELECT unnest([1, 2, 4, 8]) AS nprobe), f AS (SELECT * FROM (SELECT nprobe, q_id, vec_id, row_number() OVER (PARTITION BY nprobe, q_id ORDER BY score, vec_id) AS r FROM s, n WHERE pr <= nprobe) WHERE r <= 10) SELECT CAST(nprobe AS INTEGER) AS nprobe, round(count(gt.vec_id) / 10.0 / count(DISTINCT f.q_id), 5) AS share FROM f LEFT JOIN gt ON gt.q_id = f.q_id AND gt.vec_id = f.vec_id GROUP BY nprobe")
def nprobe_sweep(spark, d):
    """What each number of probes worth trying finds of the ten nearest."""
    truth, out = search.knn(asked(spark, d), rows(spark, d), 10), None
    for n in evaluate.probe_settings(10):
        found = search.ivf(asked(spark, d), centroids(spark, d), lists(spark, d), 10, n)
        one = evaluate.intersection_at(truth, found, 10).select(F.lit(n).alias("nprobe"), "share")
        out = one if out is None else out.unionByName(one)
    return _rounded(out, "share")


@query("best_latency", "WITH m AS (SELECT event_type, extract(hour FROM ts) AS setting, avg(value) AS best FROM events GROUP BY ALL) SELECT event_type, CAST(setting AS INTEGER) AS setting, round(best, 4) AS best FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY best, setting) AS r FROM m) WHERE r = 1", tables=False)
def best_latency(spark, d):
    """Events as measurements: the hour with the least mean value of each type."""
    measured = spark.read.parquet(f"{d}/events.parquet").withColumn("setting", F.hour("ts"))
    return _rounded(evaluate.best_latency(measured, ["event_type"], ["setting"], "value"), "best", digits=4)


@query("workload_profile", PROBES + ", o AS (SELECT q_id + 100 AS q_id, vec_id FROM t) SELECT q_id, round(max(score) FILTER (rank = 1), 5) AS top1, round(max(score) FILTER (rank = 5), 5) AS top5, round(max(score) FILTER (rank = 20), 5) AS top20, round(avg(CASE WHEN o.vec_id IS NULL THEN 0.0 ELSE 1.0 END), 5) AS in_old FROM t LEFT JOIN o USING (q_id, vec_id) GROUP BY q_id")
def workload_profile(spark, d):
    hits = search.ivf(asked(spark, d), centroids(spark, d), lists(spark, d), 10, 3)
    return _rounded(evaluate.profile(hits, hits.select((F.col("q_id") + 100).alias("q_id"), "vec_id")), "top1", "top5", "top20", "in_old")


@query("offline_pipeline", _top(SQL_METRIC["l2"], 5).replace("SELECT q_id, vec_id, CAST(rank", "SELECT 1.0 AS intersection, q_id, vec_id, CAST(rank", 1))
def offline_pipeline(spark, d):
    """Statistics, duplicates, training, shards, merge, search over all lists, and comparison with the exact result."""
    from vectide.plans import offline

    return _rounded(offline.run(rows(spark, d), asked(spark, d), k=5, clusters=8, nprobe=8, shards=3), "score", "intersection")


# --- text and prompts -----------------------------------------------------------------------------------------------------


@query("passages", "SELECT doc_id, 'passage: ' || coalesce(text, '') AS passage FROM documents", tables=False)
def passages(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.passage(F.col("text")).alias("passage"))


@query("kept_messages", "WITH m AS (SELECT conv_id, turn, role, len(regexp_split_to_array(trim(coalesce(text, ''), ' '), '\\s+')) AS n FROM conversations), r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS total FROM m) SELECT conv_id, turn FROM r WHERE total <= 60", tables=False)
def kept_messages(spark, d):
    """The latest turns of each conversation that fit in 60 words."""
    turns = spark.read.parquet(f"{d}/conversations.parquet")
    return T.latest_messages(turns, 60).select("conv_id", "turn")


@query("sparse_assign", "WITH w AS (SELECT doc_id AS id, CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) % 64 AS b FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS word FROM documents)), n AS (SELECT id, b, count(*) AS x FROM w GROUP BY ALL), cp AS (SELECT label AS list_no, i - 1 AS b, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY ALL), s AS (SELECT id, list_no, sum(x * m) AS score FROM n JOIN cp USING (b) GROUP BY ALL) SELECT id AS vec_id, CAST(list_no AS INTEGER) AS list_no, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, list_no) AS r FROM s) WHERE r = 1", tables=False)
def sparse_assign(spark, d):
    """Documents as sparse counts of hashed words, each with the centroid of the largest inner product."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    places = docs.select(F.col("doc_id").alias("vec_id"), F.transform(T.words(F.col("text")), lambda w: T.bucket_of(w, 64)).alias("places"))
    return _rounded(index.assign_counts(places, centroids(spark, d)), "score", digits=4)
