import math
import random
from collections import Counter

import pytest

from sumwright.llm import url_filter
from sumwright.llm.queries import URL_RULES

ODD = [None, "", "no scheme", "http://", "HTTP://A.Net", "http://a.net/", "x://Ä.NET/é?q#f", "http://e.com?a=1&b=2", "a://b://c/d",
       "http://net/x", "http://sub.example.net/en/x", "http://example.net/en", "http://xexample.net/en/", "http://q.example.com/de/1#/", "https://o.org/fr/2",
       "http://a.org\n/fr/x", "http://h/" + "p/" * 50_000]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return host.translate({c: c + 32 for c in range(65, 91)}), tail[:stop]


def rule(host, path):
    fits = [r for r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits, key=len, default=None)


def urls(spark, rows, schema="page_id long, url string, host string, score string"):
    return spark.createDataFrame([(i, u, "own", "own") for i, u in enumerate(rows)], schema)


def test_parts_and_rules(spark):
    df = urls(spark, ODD + ODD)
    none = url_filter.suffix_statistics(*[spark.createDataFrame([], "host string, label double")] * 2)
    got = url_filter.judge(df, url_filter.Model([], none, 0.0), URL_RULES)
    assert got.columns == ["page_id", "url", "host", "score", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == 2 * len(ODD)
    for r in rows:
        assert (r.host, r.path) == split(r.url)
        assert r.rule == rule(*split(r.url))
        assert r.verdict == (URL_RULES[r.rule] if r.rule else "allow") and r.score == 0


def test_features(one):
    from pyspark.sql import functions as F

    def plain(text):
        return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values()) if text else 0

    texts = ["", "aaa", "abc", "example.com", "é1é2"]
    assert one(url_filter.entropy(F.col("v")), *texts) == pytest.approx([plain(t) for t in texts])
    v = F.col("v")
    found = url_filter.lexical(v, url_filter.host_of(v), url_filter.path_of(v))
    url = "https://a-b.c1.com/x/y9?p=1&q=2#z"
    assert one(found["depth"], url) == [2] and one(found["labels"], url) == [3] and one(found["parameters"], url, "", "http://a/b") == [2, 0, 0]
    assert one(found["digit_ratio"], url) == [4 / len(url)] and one(found["hyphens"], url) == [1] and one(found["host_digits"], url) == [1]


def test_trees_learn_from_labelled_urls(spark):
    def rows(seed, n):
        rng = random.Random(seed)
        word = lambda: "".join(rng.choices("aeioubdklmnrst", k=rng.randrange(4, 9)))
        bad = lambda: f"http://{word()}-{word()}{rng.randrange(100, 999)}.top/{rng.randrange(10**9)}?a={word()}&b=1&c=2"
        good = lambda: f"https://www.{word()}.com/{word()}/{word()}"
        return [(bad() if i % 3 == 0 else good(), int(i % 3 == 0)) for i in range(n)]

    labelled = spark.createDataFrame(rows(1, 600) + [(None, 0), ("http://x/", None), ("http://y/", 5)], "url string, label int")
    model = url_filter.train(labelled, labelled)
    assert model.trees and model.prior == pytest.approx(1 / 3, abs=0.01)
    held = spark.createDataFrame(rows(2, 400), "url string, label int")
    found = url_filter.judge(held, model).collect()
    assert sum((r.verdict == "block") == bool(r.label) for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "url string, label int")
    model = url_filter.train(empty, empty)
    assert model.trees == [] and url_filter.judge(empty, model, URL_RULES).count() == 0


def test_many_suffixes_are_counted_each(spark):
    rows = [(f"http://h.d{i % 6000}.x/{i}", int(i % 6000 < 2)) for i in range(9000)]
    urls = spark.createDataFrame(rows, "url string, label int").withColumn("host", url_filter.host_of("url"))
    found = {r.suffix: r for r in url_filter.suffix_statistics(urls, urls.withColumn("label", urls.label.cast("double"))).collect()}
    assert len(found) == 6001 and found["x"].m == 9000 and found["x"].bad == 4
    assert all(found[f"d{i}.x"].m == (2 if i < 3000 else 1) for i in range(6000)) and found["d1.x"].bad == 2


def test_no_row_is_described_by_its_own_label(spark):
    """Where every suffix has one URL, rates of others' folds say nothing, so trees do not lean on them."""
    rng = random.Random(1)
    rows = [(f"http://a.s{i}.com/{rng.random()}", rng.randint(0, 1)) for i in range(400)]
    labelled = spark.createDataFrame(rows, "url string, label int")
    model = url_filter.train(labelled, labelled)
    parsed = labelled.select("url", url_filter.host_of("url").alias("host"), url_filter.path_of("url").alias("path"), labelled.label.cast("double").alias("label"))
    own = url_filter.by_suffix(parsed, "label", url_filter.fold_of(parsed.url).alias("fold")).groupBy("suffix", "fold").agg({"*": "count", "label": "sum"})
    own = own.select("suffix", "fold", own["count(1)"].alias("m"), own["sum(label)"].alias("bad"))
    rows, n = url_filter.featured(parsed, model, "url", own=own)
    assert {round(r.features[n - 1], 9) for r in rows.collect()} == {round(model.prior, 9)}


def test_verdicts_are_those_of_the_fitted_trees(spark, monkeypatch):
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    fitted = []
    fit = url_filter.GBTClassifier.fit
    monkeypatch.setattr(url_filter.GBTClassifier, "fit", lambda self, rows: fitted.append((fit(self, rows), rows)) or fitted[-1][0])
    rng = random.Random(3)
    rows = [(f"http://h{rng.randint(0, 9)}.com/{'a/' * rng.randint(0, 5)}?x={rng.randint(0, 99)}", rng.randint(0, 1)) for _ in range(300)]
    model = url_filter.train(*[spark.createDataFrame(rows, "url string, label int")] * 2, rounds=5)
    (trained, features), forest = fitted[0], model.trees
    array = vector_to_array("features")
    total = sum((F.lit(w) * url_filter.trees.value(root, [array[i] for i in range(16)]) for w, root in forest), F.lit(0.0))
    got = trained.transform(features).select(vector_to_array("probability")[1].alias("p"), (1 / (1 + F.exp(-2 * total))).alias("q"))
    assert all(r.p == pytest.approx(r.q) for r in got.collect())
