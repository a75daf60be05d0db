import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sumwright.llm import token_counts
from sumwright.llm.shared import new_path

NAME = "byte_bpe_50k.json"
LIBRARY = Tokenizer.from_file(public_tokenizers.path(NAME))
OWN = token_counts.Encoder(NAME)
ODD = [None, "", " ", "a b", " a", "a  b", "x\ny\n\nz ", "<|endoftext|> a", "it's we'll\n'the 's", "é\xa0ß\x85q \x1c", "日本 語\n1 22", "word " * 30_000]


def plain(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False))


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("ab'st1 \n\t.,!éß語\xa0\u2003|<>")) | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_counts_by_words_are_the_library_s(text):
    assert OWN.count([text, text + " x", "y\n" + text]) == [plain(text), plain(text + " x"), plain("y\n" + text)]


def docs(spark, texts):
    rows = [(i if i else None, t, "own", "own") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, n_tokens string")


def test_rows_and_cache(spark):
    cache = new_path(spark, "counts")
    got = token_counts.count_tokens(docs(spark, ODD + ODD), NAME, cache, limit=3).collect()
    want = sorted((i or -1, len((t or "").encode()), plain(t), plain(t) > 3) for i, t in enumerate(ODD + ODD))
    assert sorted((r.doc_id or -1, *tuple(r)[1:]) for r in got) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in ODD})
    more = token_counts.count_tokens(docs(spark, [*ODD, "new one"]), NAME, cache)
    assert more.count() == len(ODD) + 1
    assert spark.read.parquet(cache).count() == stored.count() + 1


def test_stored_counts_are_used_by_version(spark):
    cache = new_path(spark, "counts")
    token_counts.count_tokens(docs(spark, ["a b"]), NAME, cache)
    of = token_counts.version(NAME)
    wrong = spark.sql(f"select unhex(sha2('c', 256)) digest, '{of}' version, 77L n_tokens union all select unhex(sha2('d', 256)), 'other', 99L")
    wrong.write.mode("append").parquet(cache)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs(spark, ["a b", "c", "d"]), NAME, cache).collect()}
    assert got == {None: 2, 1: 77, 2: 1}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name):
    own = token_counts.Encoder(name)
    texts = [t or "" for t in ODD]
    if name.endswith(".json"):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        want = [len(library.encode(t, add_special_tokens=False)) for t in texts]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name)).encode(texts)]
    assert own.count(texts) == want


def test_empty_table(spark):
    assert token_counts.count_tokens(docs(spark, [])).count() == 0
