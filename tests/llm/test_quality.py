import random

import pytest

from sumwright.llm import quality, trees

SCHEMA = "doc_id long, text string, stats string, label int"


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = "alpha beta gamma delta epsilon of the and to in é ß".split()
    rows = []
    for i in range(n):
        own = rng.choices(words, k=rng.choice([10, 80, 300]))
        label = int(i % 4 != 0)
        if not label:
            own = [w.upper() + "!!" for w in own] if i % 8 else [w + rng.choice(["###", "$$$"]) for w in own]
        rows.append((i, " ".join(own), "own", label))
    return rows


def fit(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    return quality.learn(quality.described(docs).join(docs.select("doc_id", "label"), "doc_id"))


def test_rules_hold_on_other_texts(spark):
    rules = fit(spark, corpus(1))
    assert 0 < len(rules.weighted) <= 280 and rules.text()
    docs = corpus(2) + [(1000, None, "", None), (1001, "", "", None), (1002, "word " * 50_000, "", None), (1001, "", "", None)]
    found = quality.score_documents(quality.described(spark.createDataFrame(docs, SCHEMA)), rules).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 for r in found)
    labels = {i: y for i, _, _, y in docs if y is not None}
    right = [(r.score >= 0.5) == bool(labels[r.doc_id]) for r in found if r.doc_id in labels]
    assert sum(right) >= 0.98 * len(right)
    empty = {r.score for r in found if r.doc_id in (1000, 1001)}
    assert len(empty) == 1


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([1, 1], 1.0), ([0], 0.0), ([None, 4], 0.5)])
def test_labels_of_one_kind(spark, labels, score):
    rules = fit(spark, [(i, f"t {i}", "", y) for i, y in enumerate(labels)])
    docs = spark.createDataFrame([(1, "any", "", None)], SCHEMA)
    assert quality.score_documents(quality.described(docs), rules).first().score == pytest.approx(score)
    assert quality.score_documents(quality.described(docs.limit(0)), rules).count() == 0


def test_statistics_of_nothing():
    assert quality.statistics(None) == quality.statistics("") and not any(quality.statistics(""))
    assert len(quality.statistics("A b!")) == len(quality.STATISTICS)


def test_trees_are_read_as_they_predict(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(x := rng.random(), y := rng.random(), float((x > 0.5) != (y > 0.3))) for _ in range(500)]
    df = spark.createDataFrame(rows, "x double, y double, label double")
    vectors = df.select("*", array_to_vector(F.array("x", "y")).alias("features"))
    model = GBTClassifier(maxIter=5, seed=1).fit(vectors)
    forest = trees.read(model.toDebugString)
    assert [w for w, _ in forest] == list(model.treeWeights)
    total = sum((F.lit(w) * trees.value(t, [F.col("x"), F.col("y")]) for w, t in forest), F.lit(0.0))
    both = model.transform(vectors).select(total.alias("own"), "rawPrediction").collect()
    assert all(r.own == pytest.approx(r.rawPrediction[1]) for r in both)
    assert trees.narrowed(((0, True, 0.5), (0, True, 0.2), (0, False, 0.1))) == ((0, False, 0.1), (0, True, 0.2))


def naive(text):
    """The statistics by counting characters and words one by one."""
    import math

    text = text or ""
    raw, words = text.encode(), text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, m = max(len(raw), 1), max(len(words), 1)
    share = lambda of: sum(c in of for c in text) / n
    return [
        math.log(1 + len(raw)), math.log(1 + len(words)),
        sum(len(w) for w in words) / m, max([len(w) for w in words], default=0),
        sum("A" <= c <= "Z" for c in text) / n, sum("0" <= c <= "9" for c in text) / n,
        share("#$%&*@^~=<>{}[]\\/+_"), share("|"), share("!"), share(".,;:?"), share(" \t\r\n\x0b\x0c"),
        sum(len(c.encode()) - 1 for c in text) / n, len(set(words)) / m,
        max([words.count(w) for w in set(words)], default=0) / m, sum(len(w) < 4 for w in words) / m,
        sum(w.istitle() for w in words) / m, len(words) / max(len(lines), 1), len(set(lines)) / max(len(lines), 1),
    ]


def test_statistics_against_naive_counting():
    rng = random.Random(9)
    texts = [None, "", " \n\t", "A", "Ab cd\n\nAb cd\r\nX|y!"]
    texts += ["".join(rng.choices("aB3 é😀.,#|!\n\t_/ßZ", k=rng.randint(1, 300))) for _ in range(200)]
    for text in texts:
        found = dict(zip(quality.STATISTICS, quality.statistics(text), strict=True))
        assert found == pytest.approx(dict(zip(quality.STATISTICS, naive(text), strict=True))), text


def test_compiled_scores_are_those_of_the_logistic_model(spark, monkeypatch):
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    fitted = []
    fit_one = quality.LogisticRegression.fit
    monkeypatch.setattr(quality.LogisticRegression, "fit", lambda self, rows: fitted.append((fit_one(self, rows), rows)) or fitted[-1][0])
    docs = spark.createDataFrame(corpus(3, 120), SCHEMA)
    described = quality.described(docs).join(docs.select("doc_id", "label"), "doc_id")
    rules = quality.learn(described)
    model, design = fitted[0]
    want = sorted(r.p for r in model.transform(design).select(vector_to_array("probability")[1].alias("p")).collect())
    got = sorted(r.s for r in described.select(rules.score(F.col("stats")).alias("s")).collect())
    assert got == pytest.approx(want)


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "own", 1), (1, "a b", "own", 1)], SCHEMA)
    found = quality.described(docs).collect()
    assert found[0] == found[1] and quality.described(docs.limit(0)).count() == 0
    assert quality.score_documents(quality.described(docs.limit(0)), quality.Rules((), 0.0)).count() == 0
