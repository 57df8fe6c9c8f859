"""Recipes that share a scan give what they give one by one."""
import pytest

from revisio.plans import queries as Q
from revisio.plans.recipes import RECIPES, generate, generate_mixture, generate_together

SF = "/root/testdata/sf0.001"
V2, V1 = ([k for k in RECIPES if k.startswith("IteraTeR") and ("V1" in k) == v1] for v1 in (False, True))


def values(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("keys", [V2, V1])
def test_together_equals_one_by_one(spark, keys):
    corpus = Q.CORPUS[keys[0]](spark, SF).cache()
    recipes = [RECIPES[k] for k in keys]
    one_by_one = [x for r in recipes for x in values(generate(r, corpus, Q.catalogue(), Q.SEED, shuffle=None))]
    together = generate_together(recipes, corpus, Q.catalogue(), Q.SEED)
    assert values(together) == sorted(one_by_one) and len(one_by_one) > 100


def test_spans_share_one_scan(spark, tmp_path):
    corpus = Q.CORPUS[V2[0]](spark, SF)
    corpus.write.parquet(str(tmp_path / "v2"))
    stored = spark.read.parquet(str(tmp_path / "v2"))
    plan = generate_together([RECIPES[k] for k in V2], stored, Q.catalogue(), Q.SEED)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_recipes_that_differ_in_more_are_refused(spark):
    corpus = Q.CORPUS["c4_gec"](spark, SF)
    with pytest.raises(ValueError):
        generate_together([RECIPES["c4_gec"], RECIPES["lang8"]], corpus, Q.catalogue(), Q.SEED)


def test_a_mixture_groups_only_recipes_on_the_same_corpus(spark):
    a, b = Q.CORPUS[V2[0]](spark, SF), Q.CORPUS[V2[0]](spark, SF)
    recipes = [RECIPES[k] for k in V2]
    got = generate_mixture(recipes, {V2[0]: a, V2[1]: a, V2[2]: b}, Q.catalogue(), Q.SEED, shuffle=None)
    want = [x for r in recipes for x in values(generate(r, a, Q.catalogue(), Q.SEED, shuffle=None))]
    assert values(got) == sorted(want)
