"""URL filter: allow and block rules by host and path, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import hash_sample, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Parts of a URL whose share of blocked URLs is a feature: last label and last two labels of the host, first part of the
#: path, that with the last label, and what follows the last dot of the path's last part.
SUFFIXES = ("tld", "domain", "head", "tld_head", "extension")
FEATURES = ["url_length", "host_length", "path_length", "depth", "host_depth", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "parameters", "has_fragment", "https", *(f"{key}_{what}" for key in SUFFIXES for what in ("rate", "count"))]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://`, A-Z lower-cased) and path; both empty if null or without `://`."""
    part = lambda n: F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", n)
    return F.translate(part(1), UPPER, LOWER), part(2)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits its host and all subdomains, if the path
    starts with the rule's. `rules` is a short control list that becomes part of the plan."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    name = verdict = None
    for rule_host, rule_path, what in ordered:
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the lexical features of columns url, host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    length = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    chars = F.split(F.col("host"), "")
    # Shannon entropy of the host's characters: log n - sum(c log c) / n
    counts = F.transform(F.array_distinct(chars), lambda c: (F.length("host") - F.length(F.replace(F.col("host"), c, F.lit("")))).cast("double"))
    n = F.greatest(F.length("host"), F.lit(1)).cast("double")
    entropy = F.log2(n) - F.aggregate(counts, F.lit(0.0), lambda s, c: s + F.when(c > 0, c * F.log2(c)).otherwise(0.0)) / n
    digits = lambda c: F.regexp_count(c, F.lit("[0-9]"))
    found = {
        "url_length": F.length(url),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": F.regexp_count("path", F.lit("/[^/]")),
        "host_depth": F.regexp_count("host", F.lit(r"\.")),
        "digit_ratio": digits(url) / length,
        "host_digit_ratio": digits(F.col("host")) / n,
        "hyphens": F.regexp_count(url, F.lit("-")),
        "entropy": entropy,
        "parameters": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1),
        "has_fragment": F.contains(url, F.lit("#")),
        "https": F.startswith(F.lower(F.substring(url, 1, 8)), F.lit("https://")),
    }
    head = F.regexp_extract("path", "^/([^/]*)", 1)
    parts = {"tld": _suffix(F.col("host"), 1), "domain": _suffix(F.col("host"), 2), "head": head, "tld_head": F.concat_ws("/", _suffix(F.col("host"), 1), head), "extension": F.regexp_extract("path", r"\.([^./]*)$", 1)}
    return pages.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in found.items()} | parts)


def with_suffix_rates(rows: DataFrame, label: Column, prior: float, smoothing: float) -> DataFrame:
    """Adds, for each of SUFFIXES among the columns, the smoothed share of blocked URLs and the log count
    among labelled rows. A labelled row sees only what rows of the other half (by hash of its URL) say, so its own label
    never becomes a feature of it."""
    half = F.pmod(F.xxhash64(F.lit(3), "url"), F.lit(2))
    rows = rows.withColumn("__half", F.when(label.isNotNull(), half))
    for key in [k for k in SUFFIXES if k in rows.columns]:
        in_half = lambda h, what: F.coalesce(F.sum(F.when(F.col("__half") == h, what)), F.lit(0.0))
        counted = rows.where("__half is not null").groupBy(key).agg(*[in_half(h, F.lit(1.0)).alias(f"__n{h}") for h in (0, 1)], *[in_half(h, label).alias(f"__b{h}") for h in (0, 1)])
        rows = rows.join(counted, key, "left")
        seen = lambda c: F.coalesce(F.when(F.col("__half") == 0, F.col(f"__{c}1")).when(F.col("__half") == 1, F.col(f"__{c}0")).otherwise(F.col(f"__{c}0") + F.col(f"__{c}1")), F.lit(0.0))
        rows = rows.withColumns({f"{key}_rate": (seen("b") + smoothing * prior) / (seen("n") + smoothing), f"{key}_count": F.log1p(seen("n"))}).drop("__n0", "__n1", "__b0", "__b1")
    return rows.drop("__half")


def judge(pages: DataFrame, rules=RULES, train_rows: int = 8192, trees: int = 12, depth: int = 4, smoothing: float = 20.0, seed: int = 5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row: the longest fitting rule's verdict, else the model's.

    URLs that a rule judges are the labelled ones. Suffix statistics (smoothed share of blocked URLs and log count, by
    each of SUFFIXES) are counted over all of them, for a labelled URL over the other half of
    them; the trees are fitted on at most `train_rows` labelled URLs, chosen by hash. score is the model's probability of block, for every row; without
    labels of both kinds it is the share of blocked labels (0 if there are none) and decides alone. Null and malformed
    URLs have empty host and path, fit no rule and are judged by the model; repeated rows give a row each.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumn("host", host).withColumn("path", path)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = lexical(rows.withColumn("rule", rule).withColumn("rule_verdict", verdict))
    label = (F.col("rule_verdict") == "block").cast("double")
    labelled = rows.where("rule is not null")
    overall = labelled.agg(F.count("*"), F.avg(label)).first()
    prior = float(overall[1] or 0.0)

    rows = with_suffix_rates(rows, label, prior, smoothing)
    if 0 < prior < 1:
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
        chosen = hash_sample(rows.where("rule is not null"), ["url", "page_id"], train_rows)
        train = materialize(chosen.select(label.alias("label"), *FEATURES), "url-train")
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, maxBins=32).fit(assemble.transform(train).select("features", "label"))
        rows = model.transform(assemble.transform(rows)).withColumn("score", vector_to_array("probability")[1])
    else:
        rows = rows.withColumn("score", F.lit(prior))
    decided = F.coalesce("rule_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", decided.alias("verdict"), "score")
