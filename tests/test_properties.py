"""Invariants over every generated row of the small tables."""
import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from revisio.operators.pairs import edit_pairs, masked_pairs
from revisio.plans.recipes import RECIPES, generate
from revisio.plans.queries import CORPUS
from revisio.sources import standins as S
from revisio.sources.prompts import load_prompts

SENT = re.compile(r"<extra_id_(\d+)>")


def _roundtrip(masked: str, target: str) -> str:
    """Put the target's runs back into the masked text."""
    runs = re.split(r"\s*<extra_id_\d+>\s*", target)[1:-1] if target else []
    out = masked
    for k, run in enumerate(runs):
        out = out.replace(f"<extra_id_{k}>", run, 1)
    return " ".join(out.split())


def test_roundtrip_and_numbering(spark):
    cat = load_prompts()
    c = S.conversation_pairs(spark, SF_SMALL)
    rows = masked_pairs(c, cat["gec"], 4, False, 3).collect()
    outputs = {r.row_id: r.output for r in c.collect()}
    assert rows
    for r in rows:
        prompt, rest = r.input.split(": ", 1)
        assert prompt in cat["gec"]
        masked = rest.split(" -> ", 1)[1] if " -> " in rest else ""
        masked = r.input[r.input.index(" -> ") + 4:]
        ks = [int(k) for k in SENT.findall(masked)]
        assert ks == list(range(len(ks))) and ks
        tk = [int(k) for k in SENT.findall(r.output)]
        assert tk == list(range(len(ks) + 1))
        assert _roundtrip(masked, r.output) == " ".join(outputs[r.row_id].split())


def test_row_count_formula(spark):
    cat = load_prompts()
    c = S.related_pairs(spark, SF_SMALL).select("row_id", F.col("edited").alias("input"),
                                                 F.col("text").alias("output"))
    mask = masked_pairs(c, cat["gec"], 3, False, 1).groupBy("row_id").count()
    sizes = c.select("row_id", F.size(F.split(F.trim("output"), r"\s+")).alias("n"))
    bad = mask.join(sizes, "row_id").filter(F.col("count") != 3).count()
    assert bad == 0


def test_partitioning_invariance(spark):
    """Same rows whatever the input partitioning and shuffle width."""
    cat = load_prompts()
    c = S.conversation_pairs(spark, SF_SMALL)
    a = edit_pairs(c, cat["gec"], 2, 3, True, 5).collect()
    b = edit_pairs(c.repartition(7), cat["gec"], 2, 3, True, 5).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        g1 = generate(RECIPES["wiki_auto"], CORPUS["wiki_auto"](spark, SF_SMALL), cat, 2).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    g2 = generate(RECIPES["wiki_auto"], CORPUS["wiki_auto"](spark, SF_SMALL), cat, 2).collect()
    assert sorted(map(tuple, g1)) == sorted(map(tuple, g2))


def test_no_edit_rows_copy_their_text(spark):
    cat = load_prompts()
    g = generate(RECIPES["gyafc"], CORPUS["gyafc"](spark, SF_SMALL), cat, 1)
    ne = g.filter(F.col("type") == "no edit").collect()
    assert 0 < len(ne) <= 5000
    for r in ne:
        if r.variant == "ns0":
            p, rest = r.input.split(": ", 1)
            assert p in cat["do_not_edit"] and rest == r.output + " ->"


def test_ordered_ranks_are_dense_above_the_sampling_size(spark):
    """More rows than a range sample holds, and a column outside the key."""
    from revisio.operators.order import ordered_rank, slice_rows
    n = 400_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.md5(F.col("id").cast("string")).alias("other")).repartition(5)
    for partitions in (1, 4, 50):
        r = ordered_rank(df, ["k"], partitions=partitions)
        assert r.agg(F.count("*"), F.sum((F.col("rank") != F.col("k")).cast("int")), F.max("rank")).first() == (n, 0, n - 1)
    got = slice_rows(df, 200_000, 200_300, ["k"]).orderBy("k").collect()
    assert [x.k for x in got] == list(range(200_000, 200_300)) and all(x.other for x in got)


def test_first_k_by_hash_is_exact(spark):
    import hashlib
    from revisio.operators.order import hash_top_k, train_fraction
    df = spark.range(5000).select(F.col("id").cast("string").alias("row_id"), F.md5(F.col("id").cast("string")).alias("h"))
    order = sorted(range(5000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    for k in (0, 1, 7, 4999, 5000, 6000):
        got = {int(r.row_id) for r in hash_top_k(df, "h", ["row_id"], k).collect()}
        assert got == set(order[:k])
    for f in (0.0, 0.333, 0.95, 1.0):
        assert train_fraction(df, f, 3).count() == int(f * 5000)
    assert hash_top_k(df.limit(0), "h", ["row_id"], 3).count() == 0


def test_filter_split_checks_lazily(spark):
    import pytest
    from revisio.operators.filters import filter_split
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "x string, split string")
    assert [r.x for r in filter_split(df, ["train"], check=True).collect()] == ["a"]
    missing = filter_split(df, ["train", "validation"], check=True)
    with pytest.raises(Exception, match="validation"):
        missing.collect()
