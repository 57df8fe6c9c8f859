"""Texts put aside: examples travel without them and get the same ones back."""
import random
import re

import pytest
from pyspark.sql import functions as F

from revisio.operators.pairs import Late, late_edit_pairs
from revisio.operators.store import PLACE, dropped, fetched, put_aside
from revisio.plans import queries as Q
from revisio.plans import recipes as R

WORDS = ["a", "tail", "[MASK]", "é", "日本", "<extra_id_0>", "w" * 90, "it's", "x.", "\tq"]


def corpus(spark, n=60):
    """Pairs in all splits, with null and empty texts, null ids and rows that come twice."""
    draw, rows = random.Random(3), []
    for i in range(n):
        out = [draw.choice(WORDS) for _ in range(draw.choice([0, 1, 7, 40, 300]))]
        inp = [w for w in out if draw.random() > 0.2]
        rows.append((None if i % 17 == 5 else str(i), ("train", "validation")[i % 2], None if i % 7 == 3 else " ".join(inp), None if i % 11 == 4 else "  ".join(out)))
    return spark.createDataFrame(rows + rows[:5], "row_id string, split string, input string, output string")


def recipe(**changes):
    values = {"splits": ("train", "validation"), "prepare": lambda df: df.select("row_id", "input", "output"), "diff": True, "cap": 25} | changes
    return R.Recipe("late", "late_tag", "gec", values.pop("splits"), values.pop("prepare"), **values)


def values(df):
    return sorted(map(repr, df.collect()))


def test_texts_come_back_as_they_were(spark):
    rows = [(i, t, u) for i, (t, u) in enumerate([("a", None), (None, None), ("", "é" * 5), ("x" * 300_000, "\n"), ("日本", "")])]
    df = spark.createDataFrame(rows, "i int, t string, u string")
    aside = put_aside(df, ["t", "u"])
    assert aside.columns == ["i", *PLACE]
    none = aside.limit(1).withColumns({p: F.lit(None).cast("long") for p in PLACE}).withColumn("i", F.lit(9))
    back = fetched(aside.unionByName(aside).unionByName(none), ["t", "u"])
    assert sorted(map(repr, back.select("i", "t", "u").collect())) == sorted(map(repr, df.union(df).unionByName(spark.createDataFrame([(9, None, None)], df.schema)).collect()))
    dropped(aside)
    with pytest.raises(Exception, match="does not exist|No such file"):
        back.collect()


@pytest.mark.parametrize("changes", [{}, {"reverse_group": "formality_rev", "reverse_tag": "back"}, {"fraction": 0.8}, {"diff": False, "repeat": 3}])
def test_dealt_examples_are_the_generated_ones(spark, changes):
    r, c = recipe(**changes), corpus(spark)
    want = values(R.generate(r, c, Q.catalogue(), 5, shuffle=None))
    got = R.generate(r, c, Q.catalogue(), 5, cut_lineage=True)
    assert values(got) == want and len(want) > 200


def test_texts_are_fetched_behind_the_shuffle(spark):
    """Before, finished examples were shuffled, each with its texts."""
    got = R.generate(recipe(), corpus(spark), Q.catalogue(), 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange \w", plan)) == 1
    assert plan.index("MapInArrow") < plan.index("Exchange ")


def test_each_text_is_put_aside_once(spark):
    late = late_edit_pairs(corpus(spark).filter("row_id IS NOT NULL").dropDuplicates(["row_id"]), ["p"], 1, 5, True, 5, "s")
    rows = late.rows.select("row_id", *PLACE).distinct()
    assert late.rows.count() > 3 * rows.count() and rows.count() == rows.select("row_id").distinct().count()


def test_rows_keep_the_order_of_the_hash(spark):
    got = [tuple(r) for r in R._dealt(Late(R._generate_late(recipe(), corpus(spark), Q.catalogue(), 5).rows, 1), 5).collect()]
    key = R.shuffle_rows(spark.createDataFrame(got, ",".join(f"`{c}` string" for c in R.OUT_COLS)), 5, "row_id", ("from", "variant")).collect()
    assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in key]


def test_without_plain_file_access_finished_examples_travel(spark, monkeypatch):
    monkeypatch.setattr(R, "can_put_aside", lambda spark: False)
    got = R.generate(recipe(), corpus(spark), Q.catalogue(), 5)
    assert not re.search("MapInArrow", got._jdf.queryExecution().executedPlan().toString())
    monkeypatch.undo()
    assert values(got) == values(R.generate(recipe(), corpus(spark), Q.catalogue(), 5))
