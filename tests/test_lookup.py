"""Vocabulary lookups in the row, by join, and with a tokenizer file."""
import pytest
from pyspark.sql import functions as F

from revisio.operators import tokenize as K

ROWS = [("a", "the cat sat on the mat", "cat"), ("b", "", None), ("c", None, "  "), ("d", "unknown words " * 30, "the the the"),
        ("e", "the cat\n\tsat", "w7 w8 w9")]


@pytest.fixture(scope="module")
def vocab(spark):
    words = ["the", "cat", "sat", "on", "mat", *[f"w{i}" for i in range(60)]]
    return spark.createDataFrame([(w, 5, i + K.SPECIALS) for i, w in enumerate(words)], "token string, count int, id int")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "row_id string, x string, y string")


SIDES = [("x", "input_ids", 6), ("y", "labels", 3)]


def values(df):
    return sorted(map(tuple, df.collect()))


def test_both_paths_give_equal_ids(rows, vocab):
    inside, joined = K.tokenize(rows, vocab, SIDES), K.tokenize(rows, vocab, SIDES, in_row_bytes=0)
    assert values(inside) == values(joined)
    by = {r.row_id: r for r in inside.collect()}
    assert by["a"].input_ids == [3, 4, 5, 6, 3, K.EOS] and by["b"].labels == [K.EOS] and by["d"].input_ids == [K.UNK] * 5 + [K.EOS]


def test_no_exchange_by_row_in_the_row(rows, vocab):
    for df in (K.tokenize(rows, vocab, SIDES), K.decode_ids(K.tokenize(rows, vocab, SIDES), vocab, "labels", "text")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(row_id" not in plan and "Generate" not in plan
    assert "hashpartitioning(row_id" in K.tokenize(rows, vocab, SIDES, in_row_bytes=0)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("skip", [True, False])
def test_both_paths_decode_alike(spark, vocab, skip):
    ids = spark.createDataFrame([("a", [3, 4, 1]), ("b", []), ("c", None), ("d", [0, 2, 999, 5, -100])], "row_id string, ids array<int>")
    inside = K.decode_ids(ids, vocab, "ids", "text", skip)
    assert values(inside) == values(K.decode_ids(ids, vocab, "ids", "text", skip, in_row_bytes=0))
    assert {r.row_id: r.text for r in inside.collect()}["a"] == ("the cat" if skip else "the cat </s>")


def test_an_empty_vocabulary_knows_nothing(spark, rows, vocab):
    empty = vocab.limit(0)
    assert values(K.tokenize(rows, empty, SIDES)) == values(K.tokenize(rows, empty, SIDES, in_row_bytes=-1))


def test_a_tokenizer_file_in_arrow_batches(rows):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    got = {r.row_id: (r.input_ids, r.labels) for r in K.tokenize_with(rows, path, SIDES, eos=0).collect()}
    for i, x, y in ROWS:
        assert got[i] == tuple(tok.encode(t or "", add_special_tokens=False).ids[:n - 1] + [0] for t, n in ((x, 6), (y, 3)))
