"""The preparing chain over all rows, and over a slice."""
import duckdb

from checks.compare import TABLES, digest
from revisio.operators.prepare import prepare

SF = "/root/testdata/sf0.01"


def test_prepare_all_passes_rank_900(spark):
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()["prepare_all"](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()["prepare_all"])
    cols = [d[0] for d in res.description]
    assert digest(df.columns, rows)[0] == digest(cols, res.fetchall())[0]
    ids = sorted(r[0] for r in con.execute("SELECT * FROM (" + E.oracle_sql()["drop_empty_pairs"] + ")").fetchall())
    # Of the pairs with both sides only the first ten ranks and less than one batch are missing.
    assert len(ids) - 10 - 8 < len(rows) <= len(ids)


def test_stop_is_a_slice(spark):
    pairs = spark.createDataFrame([(f"r{i:02d}", None if i == 5 else f"in {i}", f"out {i}") for i in range(40)], "row_id string, input string, output string")
    vocab = spark.createDataFrame([("in", 3), ("out", 4)], "token string, id int")

    def ids(**bounds):
        return sorted(int(r.row_id[1:]) for r in prepare(pairs, vocab, 4, 7, 8, 8, mode="fixed", **bounds).collect())

    assert ids(start=3, stop=9) == [3, 4, 6, 7, 8]
    assert ids(start=38, stop=99) == [38, 39]
    assert ids(start=3) == [3, 4, *range(6, 40)]


def test_texts_are_read_once(spark, tmp_path):
    """The batches are made from the stored ids: a plan that goes back to the texts reads them for the sizes and for the ranks."""
    path = str(tmp_path / "pairs")
    spark.range(50).selectExpr("concat('r', id) row_id", "concat('in ', id) input", "concat('out ', id) output").write.parquet(path)
    vocab = spark.createDataFrame([("in", 3), ("out", 4)], "token string, id int")
    out = prepare(spark.read.parquet(path), vocab, 4, 7, 8, 8, mode="fixed")
    assert out.count() == 50
    assert out.inputFiles() and not [f for f in out.inputFiles() if path in f]


def test_only_words_that_may_be_kept_are_ranked(spark, monkeypatch):
    from revisio.operators import tokenize as K
    ranked = []

    def rank(df, *args, **more):
        ranked.append(df.count())
        return real(df, *args, **more)

    real = K.ordered_rank
    monkeypatch.setattr(K, "ordered_rank", rank)
    texts = spark.createDataFrame([("b b b a a a c c " + " ".join(f"once{i}" for i in range(300)),), (" c d d  e",), (None,)], "text string")
    for size, words in ((8, ["a", "b", "c", "d", "e"]), (6, ["a", "b", "c"]), (5, ["a", "b"]), (3, []), (400, None)):
        got = [tuple(r) for r in K.build_vocab(texts, ["text"], size).orderBy("id").collect()]
        if words is None:
            assert len(got) == 305
        else:
            assert [r[0] for r in got] == words and [r[2] for r in got] == list(range(3, 3 + len(words)))
    assert ranked[1] == 3 and ranked[2] == 3  # "a", "b" and "c" are alike frequent


def test_first_words(spark):
    from revisio.functions.text import first_words, words
    texts = ["", " ", "a", " a", "a ", " a b", "a b c", "  a\tb\n c  ", "a b c d e", " a b c d e ", "\u3000a\u00a0b c", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (0, 1, 2, 3, 10):
        for r in df.select(words("t").alias("w"), first_words("t", n).alias("f")).collect():
            assert r.f == (None if r.w is None else r.w[:n])
