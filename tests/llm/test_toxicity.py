import random

import pytest

from sumwright.llm import toxicity

SCHEMA = "doc_id long, text string, label int"


def corpus(seed, n=400):
    """Texts of invented words; toxic ones hold one of a few terms, sometimes disguised."""
    rng = random.Random(seed)
    plain = [a + b for a in "ba du ke lo mi no pra sti tu".split() for b in "ban del kor lin mur pes".split()]
    rows = []
    for i in range(n):
        words = rng.choices(plain, k=rng.choice([3, 30, 300]))
        toxic = i % 4 == 0
        if toxic:
            words[1] = rng.choice(["grubsch", "Grubsch!", "snarf", "SNARF,", "gru6sch".replace("6", "b"), "snаrf"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_learned_lexicon_holds_on_other_texts(spark):
    lexicon = toxicity.learn(spark.createDataFrame(corpus(1), SCHEMA))
    assert set(lexicon.weights) == {toxicity.fold("grubsch"), toxicity.fold("snarf")}
    scored = toxicity.score_documents(spark.createDataFrame(corpus(2), SCHEMA), lexicon).collect()
    labels = {i: y for i, _, y in corpus(2)}
    assert all((r.score >= 0.5) == bool(labels[r.doc_id]) for r in scored)
    assert lexicon.score("a snarf") > lexicon.score("a snarf " + "ban " * 5000) > lexicon.score("ban")


def test_copies_of_one_text_do_not_make_its_words_toxic(spark):
    rows = corpus(1) + [(1000 + i, "only these peculiar words were copied here often", 1) for i in range(60)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, SCHEMA))
    assert set(lexicon.weights) == {toxicity.fold("grubsch"), toxicity.fold("snarf")}


def test_folding():
    assert toxicity.fold("1D10T") == toxicity.fold("idiot") == toxicity.fold("іdіоt") == toxicity.fold("ｉｄｉｏｔ")
    assert toxicity.fold("naïve") == "naive" and toxicity.fold("i\u0301") == "i"
    assert toxicity.fold("cl@y") == toxicity.fold("clay") and toxicity.fold("a @ b!") == "a @ b!"


def test_whole_words_and_exceptions():
    weights = {toxicity.fold("trash"): 2.0, toxicity.fold("clown"): 2.0}
    lexicon = toxicity.Lexicon(weights, ("trash can", "clown fish"))
    assert lexicon.density("trashy clowns") == 0
    assert lexicon.density("a Trash can, a clown fish") == 0
    assert lexicon.density("(trash) cl0wn") > lexicon.density("trash can clown") > 0
    assert lexicon.density("x" * 100_000) == lexicon.density("") == lexicon.density(None) == 0


@pytest.mark.parametrize("rows", [[], [(1, "a b", 0)], [(1, None, 1), (2, "a", None), (3, "b", 7)]])
def test_nothing_to_learn_from(spark, rows):
    lexicon = toxicity.learn(spark.createDataFrame(rows, SCHEMA))
    docs = spark.createDataFrame([(1, "any"), (None, None), (1, "any"), (2, "")], "doc_id long, text string")
    found = toxicity.score_documents(docs, lexicon).collect()
    assert len(found) == 4 and all(r.score < 0.5 for r in found)
    assert toxicity.drop_toxic(docs, lexicon).count() == 4


def test_toxic_rows_go_and_columns_stay(spark):
    lexicon = toxicity.Lexicon({"snarf": 5.0}, (), 2.0, 0.5)
    docs = spark.createDataFrame([(1, "snarf", "x"), (2, "fine", "y")], "doc_id long, text string, score string")
    kept = toxicity.drop_toxic(docs, lexicon)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
    assert toxicity.drop_toxic(docs.limit(0), lexicon).count() == 0


def test_words_of_short_texts_are_learned(spark):
    plain = [a + b for a in "ba du ke lo mi".split() for b in "ban del kor lin mur pes".split()]
    rows = [(i, f"{'grubsch' if i % 2 else plain[-i % 29]} {plain[i % 30]}", i % 2) for i in range(60)]
    rows += [(100 + i, "grubsch", 0) for i in range(2)] + [(200 + i, plain[0], 0) for i in range(40)]
    counts = {r.term: (r.toxic, r.clean) for r in toxicity.term_counts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert counts[toxicity.fold("grubsch")] == (15, 1)
    lexicon = toxicity.learn(spark.createDataFrame(rows, SCHEMA))
    assert toxicity.fold("grubsch") in lexicon.weights


def test_spans_against_a_naive_matcher():
    rng = random.Random(4)
    terms = {"ab": 1.0, "b": 0.5, "aab": 2.0, "b" * 80: 3.0}
    phrases = ("ab b", "b a", "a b ab", "b" * 80 + " a")
    lexicon = toxicity.Lexicon(terms, phrases)
    for _ in range(300):
        text = " ".join(rng.choices(["a", "b", "ab", "aab", "b" * 80], k=rng.randint(0, 12)))
        whole = lambda a, b: (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " ")
        places = lambda x: [(i, i + len(x)) for i in range(len(text)) if text.startswith(x, i) and whole(i, i + len(x))]
        excused = [s for p in phrases for s in places(p)]
        total = sum(w for t, w in terms.items() for a, b in places(t) if not any(c <= a and b <= d for c, d in excused))
        assert lexicon.density(text) == pytest.approx(total / toxicity.math.log2(2 + len(text) / 6))


def test_many_exceptions_take_linear_time():
    import time

    lexicon = toxicity.Lexicon({toxicity.fold("trash"): 2.0}, ("trash can",))
    started = time.perf_counter()
    assert lexicon.density("trash can " * 100_000) == 0 < lexicon.density("trash can " * 100_000 + "trash")
    assert time.perf_counter() - started < 10


def test_long_terms_and_ligatures(spark):
    long = "grub" * 30
    rows = [(i, t.replace("grubsch", long), y) for i, t, y in corpus(1)]
    assert toxicity.fold(long) in toxicity.learn(spark.createDataFrame(rows, SCHEMA)).weights
    assert toxicity.fold("ﬁlth") == toxicity.fold("filth") and toxicity.fold("𝐢𝐝𝐢𝐨𝐭") == toxicity.fold("idiot")


def test_exceptions_are_learned_from_clean_texts(spark):
    rows = [(i, t + (" a Snarf hut stood" if y == 0 and i % 20 == 1 else ""), y) for i, t, y in corpus(1)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, SCHEMA), exceptions=())
    assert set(lexicon.weights) == {toxicity.fold("grubsch"), toxicity.fold("snarf")}
    assert lexicon.exceptions == ("a snarf", "snarf hut")
    assert lexicon.density("the snarf hut") == 0 < lexicon.density("the snarf hat")
    copies = corpus(1) + [(1000 + i, "one and the same snarf hut many times", 0) for i in range(60)]
    assert toxicity.learn(spark.createDataFrame(copies, SCHEMA), exceptions=()).exceptions == ()


def test_phrases_with_terms():
    assert list(toxicity.phrases_with({"b"}, "a b c.d b  e b")) == ["a b", "b c", "d b", "e b"]
    assert list(toxicity.phrases_with({"b"}, "")) == list(toxicity.phrases_with(set(), "a b")) == []
