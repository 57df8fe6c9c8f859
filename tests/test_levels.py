"""Scores by level and resampled intervals."""
import pytest

from revisio.operators import metrics as M

ROWS = [("1", "a b c d e", "a b c d e", "x", "en", [1, 2, 0]), ("2", "a b c", "c b a", "x", None, [1]), ("3", "", "q r s", None, "de", [0, 0]),
        ("4", "the end of it", "the end of all", "y", "en", [5, 6, 7]), ("5", None, "z", "y", "de", [])]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "row_id string, p string, r string, `from` string, type string, ids array<int>")


def test_each_level_equals_its_rows_alone(df):
    by = ["from", "type"]
    got = {(r["level"], r["from"], r["type"], r["metric"]): r["value"] for r in M.score_levels(df, "p", "r", by, "ids").collect()}
    assert len(got) == 4 * (3 + 3 + 1)
    for level, column, value in [("all", None, None), *[("from", "from", v) for v in ("x", "y", None)], *[("type", "type", v) for v in ("en", "de", None)]]:
        part = df if column is None else df.filter(df[column].eqNullSafe(value))
        key = (level, value if level == "from" else None, value if level == "type" else None)
        assert got[(*key, "bleu")] == M.corpus_bleu(part, "p", "r").first().bleu
        rouge = M.rouge_n(part, "p", "r").first()
        assert (got[(*key, "rouge1")], got[(*key, "rouge2")]) == (rouge.rouge1, rouge.rouge2)
        assert got[(*key, "gen_len")] == M.gen_len(part, "ids").first().gen_len


def test_one_pass_over_the_counts(df):
    plan = M.rouge_n(df, "p", "r", by=["from", "type"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Scan") == 1


def intervals(frame, **options):
    return [tuple(r) for r in M.rouge_intervals(frame, "p", "r", **options).orderBy("metric").collect()]


def test_intervals_do_not_depend_on_the_partitioning(df):
    many = df.unionByName(df.withColumn("row_id", df.row_id + 10)).unionByName(df.withColumn("row_id", df.row_id + 20))
    one = intervals(many.coalesce(1), replicates=200, seed=4)
    assert one == intervals(many.repartition(5), replicates=200, seed=4) and one != intervals(many, replicates=200, seed=5)
    for name, low, mid, high in one:
        assert low <= mid <= high
        assert low - 1 <= getattr(M.rouge_n(many, "p", "r").first(), name) <= high + 1


def test_equal_rows_have_no_spread(spark):
    same = spark.createDataFrame([(str(i), "a b c", "a b d") for i in range(60)], "row_id string, p string, r string")
    (_, low, mid, high), _ = intervals(same, replicates=50)
    assert low == mid == high == M.rouge_n(same, "p", "r").first().rouge1


def test_poisson_draws_have_mean_and_variance_one(spark):
    from pyspark.sql import functions as F
    drawn = spark.range(40_000).select(M._poisson(M.u32(M.h(1, "t", F.col("id"), "pw"))).alias("k")).agg(F.avg("k"), F.var_samp("k")).first()
    assert abs(drawn[0] - 1) < 0.03 and abs(drawn[1] - 1) < 0.05


def test_an_empty_table_scores_zero(df):
    assert intervals(df.limit(0), replicates=10) == [("rouge1", 0.0, 0.0, 0.0), ("rouge2", 0.0, 0.0, 0.0)]
