"""Columns with clashing names, odd and large openings against SQL, the manifest's SQL."""
import duckdb
import pytest

from revisio.llm import chat, merkle
from revisio.llm import quality_rules as Q

RULE = [(Q.Condition("n_words", True, 40),)]


def test_quality_rules_pass_clashing_columns_through(spark):
    names = ["_stats", "_qr_t", "_qr_words", "_qr_win", "_qr_sorted", "_qr_at", "_qr_lines", "_qr_base", "doc", "stats", "n_words"]
    rows = [(i, "word " * n, *[f"{c}{i}" for c in names]) for i, n in enumerate((5, 20, 30, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    out = Q.apply_rules(docs, RULE)
    assert out.columns == docs.columns
    # Windows of one repeated word cover the text, so the base rule rejects all of them.
    assert out.collect() == []
    varied = [(i, " ".join(f"w{k}" for k in range(n)), *[f"{c}{i}" for c in names]) for i, n in enumerate((5, 20, 30, 60))]
    kept = Q.apply_rules(spark.createDataFrame(varied, docs.schema), RULE)
    assert sorted(map(tuple, kept.collect())) == varied[1:3]


def _duck(sql: str, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toPandas())
    return con.execute(sql).fetchall(), [d[0] for d in con.description]


@pytest.mark.parametrize("group_rows", [100_000, 50])
def test_shared_openings_of_odd_and_large_size_equal_the_sql(spark, group_rows):
    rows = []
    for opening, n, first in (("three", 3, 0), ("many", 1203, 10_000), ("two", 2, 5), ("one", 1, 9), ("far", 5, 10**12)):
        for i in range(n):
            conv = first + i * 7
            rows += [(conv, 0, "user", opening), (conv, 1, "assistant", "x" * (i % 11))]
    rows += [(77, 0, "user", "silent"), (78, 0, "user", "silent"), (79, 0, "user", "silent")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    turns = chat.turns_of(conversations)
    got = chat.format_preferences(*chat.preference_pairs(turns, group_rows=group_rows))
    want, names = _duck(chat.ORACLE_SQL, conversations=conversations)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want)


def test_manifest_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(merkle.ORACLE_SQL).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(map(tuple, merkle.op13_merkle_manifest(spark, sf).select(*names).collect())) == sorted(want)
