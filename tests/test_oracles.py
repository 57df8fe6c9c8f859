"""Registered queries against their DuckDB oracles on the smallest tables."""
import duckdb
import pytest

from conftest import SF_SMALL
from checks.compare import TABLES, digest

FAST = ["flagship", "read_corpus", "rename_pair", "concat_columns", "filter_word_bounds", "filter_char_ratio",
        "filter_single_span", "drop_empty_pairs", "sample_prompts", "simple_pairs", "masked_pairs",
        "no_edit_pairs", "span_annotated_pairs", "alternatives_unpivot", "mask_protect_words", "encode_targets",
        "train_fraction", "global_rank", "slice_rows", "wiki_large", "IteraTeR_Fluency", "build_vocab",
        "tokenize_truncate", "assign_batches_even", "corpus_bleu", "rouge_n", "count_examples"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    df = E.queries()[name](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    a = digest(df.columns, [tuple(r) for r in df.collect()])[0]
    b = digest(cols, res.fetchall())[0]
    assert a == b


def test_every_query_registered_has_a_callable():
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 80
