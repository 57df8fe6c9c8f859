"""First-k by hash and slices by place, against sorting."""
import pytest
from pyspark.sql import functions as F

from revisio.functions.rng import h
from revisio.operators import order as O


def hashed(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("row_id"), F.lit("x" * 5).alias("text"))


def key():
    return h(7, "s", F.col("row_id"), "k")


@pytest.mark.parametrize("n, k", [(0, 3), (40, 0), (40, -1), (40, 40), (40, 99), (40, 1), (40, 39), (5000, 777), (5000, 4999)])
def test_first_by_hash_is_a_sorted_prefix(spark, n, k):
    df = hashed(spark, n)
    want = [r.row_id for r in df.orderBy(key(), "row_id").limit(max(0, k)).collect()]
    got = O.first_by_hash(df, key(), ("row_id",), lambda total: k, small=50)
    assert got.columns == df.columns and sorted(r.row_id for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("band", [
    lambda lo, hi, share, n: (lo, lo + 1),                       # always misses to the right
    lambda lo, hi, share, n: (hi - 1, hi),                       # always misses to the left
    lambda lo, hi, share, n: (lo, hi),                           # never narrows
    lambda lo, hi, share, n: O._band(lo, hi, min(1.0, share + 0.2), n)])  # beside the key
def test_a_missed_band_is_searched_on_its_side(spark, band):
    df = hashed(spark, 3000)
    for k in (1, 1500, 2999):
        want = sorted(r.row_id for r in df.orderBy(key(), "row_id").limit(k).collect())
        assert sorted(r.row_id for r in O.first_by_hash(df, key(), ("row_id",), lambda total: k, small=20, band=band).collect()) == want


def test_keys_that_share_their_hash_are_told_apart_by_the_tie(spark):
    df = hashed(spark, 300)
    got = O.first_by_hash(df, F.lit("ab" * 16), ("row_id",), lambda total: 120, small=10)
    assert sorted(r.row_id for r in got.collect()) == sorted(r.row_id for r in df.orderBy("row_id").limit(120).collect())


def test_the_source_is_planned_twice_at_most(spark, tmp_path):
    """Once for the keys, which are written, and once in the result, without a shuffle or a join."""
    hashed(spark, 3000).write.parquet(str(tmp_path / "rows"))
    got = O.train_fraction(spark.read.parquet(str(tmp_path / "rows")), 0.5, 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan
    assert got.count() == 1500


SLICES = [(0, 5), (0, None), (3, 3), (9, 4), (990, 2000), (1000, 1001), (500, 501), (400, 700), (-5, 2), (999, None)]


@pytest.mark.parametrize("start, stop", SLICES)
def test_slices_are_places_in_key_order(spark, start, stop):
    rows = [(i // 7 if i // 7 != 20 else None, f"b{i % 7}", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b string, v int").repartition(4)
    ordered = [r.v for r in df.orderBy("a", "b").collect()]
    got = O.slice_rows(df, start, stop, ["a", "b"], small=30).collect()
    want = ordered[max(0, start):stop]
    assert sorted(r.v for r in got) == sorted(want)
    assert all(ordered[r["rank"]] == r.v for r in got)


@pytest.mark.parametrize("start, stop", [(0, 50), (10, 50), (95, 150), (100, 220), (120, 130), (290, 310)])
def test_ties_at_the_bounds_give_exact_sizes(spark, start, stop):
    df = spark.createDataFrame([(i // 100, i) for i in range(300)], "k int, v int").repartition(3)
    got = O.slice_rows(df, start, stop, ["k"], rank=False, small=20).collect()
    want = [v // 100 for v in range(300)][start:stop]
    assert sorted(r.k for r in got) == want and len({r.v for r in got}) == len(want)


def test_the_bounds_reach_the_scan(spark, tmp_path):
    spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("l"), F.lit("text").alias("t")).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    try:
        spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
        got = O.slice_rows(df, 1000, 1100, ["k", "l"], rank=False, small=100)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", before)
    assert "GreaterThanOrEqual(k,1000)" in plan and "LessThanOrEqual(k,1099)" in plan and "Exchange" not in plan
    assert sorted(r.k for r in got.collect()) == list(range(1000, 1100))
