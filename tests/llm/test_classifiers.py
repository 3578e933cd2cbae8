"""URL rules, toxicity and language: rules against a plain version, models by held-out accuracy."""

import re

import pytest

from tests.llm.test_near_duplicates import table
from vectide.llm import langid, registry, toxicity, urlfilter

SF = "/root/testdata/sf0.1"
pytestmark = pytest.mark.seconds(120)


def plain_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in urlfilter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_url_rules(spark):
    odd = [None, "", "no scheme", "HTTP://A.Example.ORG/en/12?q=1&r=2#x", "https://example.org/es/x", "https://myexample.org/es/", "x://com/fr/", "://", "http://a.com/de/\nb", "http://h.net?x/y", "http://é.com/fr/é"]
    rows = [(i, u, "h", 1.0) for i, u in enumerate(odd)]
    rows += [(100 + r.page_id, r.url, "h", 1.0) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, score double")
    got = {r.page_id: r for r in urlfilter.judge(df).collect()}
    assert len(got) == len(rows)
    for i, u, *_ in rows:
        host, path, rule, verdict = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or ("block" if got[i].score >= 0.5 else "allow"))
    assert urlfilter.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in urlfilter.judge(df.where("page_id < 3")).collect()} == {"allow"}


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in registry.labels(spark, SF).collect()}
    held = [r for r in registry.op7_toxicity(spark, SF).collect() if r.held_out and r.doc_id in labels]
    right = [r.predicted == labels[r.doc_id] for r in held]
    toxic = [r.predicted for r in held if labels[r.doc_id] == 1]
    clean = [r.predicted for r in held if labels[r.doc_id] == 0]
    print("toxicity: accuracy", sum(right) / len(right), "recall", sum(toxic) / len(toxic), "false alarms", sum(clean) / len(clean), len(held))
    assert sum(right) / len(right) > 0.9 and sum(clean) / len(clean) < 0.05


def test_toxicity_odd_rows(spark):
    docs = table(spark, [(1, None), (2, ""), (3, "bad words here"), (3, "bad words here"), (None, "x")])
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.judge(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    none = toxicity.fit(docs.selectExpr("text", "cast(null as int) as label"))
    assert toxicity.keep_clean(docs, none).count() == 5
    assert toxicity.judge(docs.limit(0), labels).count() == 0


def test_language_held_out(spark):
    wanted = {r.doc_id: r.lang for r in registry.documents(spark, SF).select("doc_id", "lang").collect()}
    got = registry.op9_language_id(spark, SF).collect()
    assert len(got) == len(wanted)
    held = [r.lang_pred == wanted[r.doc_id] for r in got if r.held_out and r.lang_pred != "und" and wanted[r.doc_id]]
    print("language: accuracy", sum(held) / len(held), len(held))
    assert sum(held) / len(held) > 0.95


def test_language_odd_rows(spark):
    docs = table(spark, [(1, None), (2, "1234 !?"), (3, "hello there my friend"), (5, "hello there my friend"), (None, "x")])
    got = {r.doc_id: r for r in langid.judge(docs).collect()}
    assert len(got) == 5 and got[1].lang_pred == got[2].lang_pred == "und" and got[1].score == 0
    assert got[3].lang_pred == "en"
    assert langid.judge(docs.limit(0)).count() == 0
    far = langid.identify(docs, langid.train(registry.documents(spark, "/root/testdata/sf0.01")))
    assert {r.lang_pred for r in far.collect()} <= {"und", *(r.lang for r in registry.documents(spark, SF).select("lang").distinct().collect())}
