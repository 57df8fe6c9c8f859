"""Hand-worked cases (FIXTURES.md section 4)."""
import math

from pyspark.sql import functions as F

from revisio.functions.text import words
from revisio.operators import batch as B
from revisio.operators import metrics as M
from revisio.operators import tokenize as K
from revisio.operators.diff import opcodes_and_mask
from revisio.operators.filters import char_ratio_ok, word_bounds
from revisio.operators.masks import with_encoding
from revisio.operators.pairs import no_edit_pairs, sample_prompts, simple_pairs, span_annotated_pairs


def _encode(spark, text, mask):
    df = spark.createDataFrame([(text, mask)], "t string, m array<boolean>").withColumn("w", words("t"))
    r = with_encoding(df, "w", "m").collect()[0]
    return r.masked, r.target


def test_h1_h3_encoding(spark):
    assert _encode(spark, "a b c d e f", [False, True, True, False, False, True]) == (
        "a <extra_id_0>  d e <extra_id_1>", "<extra_id_0> b c <extra_id_1> f <extra_id_2>")
    assert _encode(spark, "a b", [False, False]) == ("a b", "")
    assert _encode(spark, "a b c", [True, True, True]) == ("<extra_id_0>  ", "<extra_id_0> a b c <extra_id_1>")


def test_h4_h6_difference():
    ops, mask = opcodes_and_mask("I am go home now".split(), "I go to home".split())
    assert [(o["tag"], o["i1"], o["i2"]) for o in ops] == [
        ("equal", 0, 1), ("delete", 1, 2), ("equal", 2, 3), ("insert", 3, 3), ("equal", 3, 4), ("delete", 4, 5)]
    assert mask == [False, True, False, False, True]
    assert opcodes_and_mask(["x", "y"], ["x", "y"])[1] == [False, False]
    assert opcodes_and_mask(["a", "b", "c"], ["a", "c"])[1] == [False, True, False]


def test_h4_h6_diff_variants(spark):
    from revisio.operators.pairs import masked_pairs
    df = spark.createDataFrame([("r1", "I go to home", "I am go home now"), ("r2", "x y", "x y"),
                                ("r3", "a c", "a b c")], "row_id string, input string, output string")
    rows = masked_pairs(df, ["P"], 0, True, 3).collect()
    by = {}
    for r in rows:
        by.setdefault(r.row_id, []).append(r)
    full = [r for r in by["r1"] if r.variant == "md0"][0]
    assert full.input == "P: I go to home -> I <extra_id_0> go home <extra_id_1>"
    assert full.output == "<extra_id_0> am <extra_id_1> now <extra_id_2>"
    singles = [r.output for r in by["r1"] if r.variant in ("md1", "md2")]
    assert len(singles) == 2 and set(singles) <= {"<extra_id_0> am <extra_id_1>", "<extra_id_0> now <extra_id_1>"}
    assert [(r.variant, r.output) for r in by["r2"]] == [("md0", "")]
    assert sorted(r.input for r in by["r3"]) == ["P: a c -> a <extra_id_0> c"] * 2


def test_h7_simple_and_h9_clamp_h10_duplicates(spark):
    df = spark.createDataFrame([("r", "t u", "v")], "row_id string, input string, output string")
    r = simple_pairs(df, ["P"], 1, 0).collect()
    assert [(x.input, x.output) for x in r] == [("P: t u ->", "v")]
    assert simple_pairs(df, ["p", "q"], 3, 0).count() == 2
    got = df.select(sample_prompts(["p", "q", "p"], 3, 0, "s", F.col("row_id")).alias("s")).collect()[0].s
    assert sorted(got) == ["p", "p", "q"]


def test_h8_span(spark):
    df = spark.createDataFrame([("r", "<clarity> The <S>big red</S> dog", "The large dog")],
                               "row_id string, input string, output string")
    r = span_annotated_pairs(df, "clarity", ["P"], 1, 0).collect()[0]
    assert r.input == "P:  The big red dog ->  The <extra_id_0> dog"
    assert r.output == "<extra_id_0> The large dog <extra_id_1>"


def test_h11_batches(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("row_id"))
    sizes = {}
    for mode in ("even", "drop_last", "fixed"):
        c = B.assign_batches(df, 3, 0, mode).groupBy("batch_id").count().orderBy("batch_id").collect()
        sizes[mode] = [r["count"] for r in c]
    assert sizes == {"even": [3, 3, 2, 2], "drop_last": [3, 3, 3], "fixed": [3, 3, 3, 1]}


def test_h12_h14_padding(spark):
    df = spark.createDataFrame([([5, 6, 1], [5, 1, 0, 0])], "l array<int>, p array<int>")
    r = df.select(K.shift_right(F.col("l")).alias("s"), K.mask_label_padding(F.col("p")).alias("m"),
                  K.unmask_label_padding(K.mask_label_padding(F.col("p"))).alias("u")).collect()[0]
    assert r.s == [0, 5, 6] and r.m == [5, 1, -100, -100] and r.u == [5, 1, 0, 0]
    ids = spark.createDataFrame([("a", 0, list(range(9))), ("b", 0, [1])], "row_id string, batch_id long, i array<int>")
    assert {x.pad_len for x in B.batch_max_length(ids, "i", 8).collect()} == {16}


def test_h15_h16_metrics(spark):
    df = spark.createDataFrame([("0", "the cat sat on mat", "the cat sat on the mat")],
                               "row_id string, p string, r string")
    b = M.corpus_bleu(df, "p", "r").collect()[0]
    assert (b.m1, b.t1, b.m2, b.t2, b.m3, b.t3, b.m4, b.t4) == (5, 5, 3, 4, 2, 3, 1, 2)
    expect = math.exp(-0.2) * math.exp((math.log(100) + math.log(75) + math.log(200 / 3) + math.log(50)) / 4)
    assert b.bleu == round(expect, 4) == 57.893
    rn = M.rouge_n(df, "p", "r").collect()[0]
    assert (rn.rouge1, rn.rouge2) == (90.9091, 66.6667)
    assert M.rouge_l(df, "p", "r").collect()[0].rougeL == 90.9091


def test_h17_h18_filters(spark):
    df = spark.createDataFrame([("a" * 13, "b" * 10), ("a" * 14, "b" * 10), ("a" * 7, "b" * 10), ("a" * 6, "b" * 10)],
                               "input string, output string")
    assert [r.k for r in df.select(char_ratio_ok().alias("k")).collect()] == [True, False, True, False]
    t = spark.createDataFrame([(" ".join(["w"] * n),) for n in (10, 11, 99, 100)], "x string")
    assert [r.k for r in t.select(word_bounds("x", 10, 100).alias("k")).collect()] == [False, True, True, False]


def test_h19_no_edit_count(spark):
    df = spark.createDataFrame([("a", "x y"), ("b", "z"), ("c", "")], "row_id string, input string")
    assert no_edit_pairs(df, ["keep"], 5000, 0).count() == 7
    assert no_edit_pairs(df, ["keep"], 5, 0).count() == 5


def test_tokenize_null_sides(spark):
    vocab = spark.createDataFrame([("a", 3), ("b", 4)], "token string, id int")
    df = spark.createDataFrame([("1", None, "b"), ("2", "a zz", None), ("3", "a b", "b a")], "row_id string, s string, t string")
    got = {r.row_id: (r.i, r.l) for r in K.tokenize(df, vocab, [("s", "i", 9), ("t", "l", 9)]).collect()}
    assert got == {"1": ([1], [4, 1]), "2": ([3, 2, 1], [1]), "3": ([3, 4, 1], [4, 3, 1])}
    plain = K.decode_ids(spark.createDataFrame([("1", [3, 2, 1, 0])], "row_id string, i array<int>"), vocab, "i", "t", skip_special=False).first()
    assert plain.t == "a <unk> </s> <pad>"


def test_padding_of_batches(spark):
    df = spark.createDataFrame([("1", 0, [5, 6, 1], [7, 1]), ("2", 0, [5, 1], [7, 8, 9, 1])], "row_id string, batch_id long, input_ids array<int>, labels array<int>")
    got = {r.row_id: r for r in B.pad_batches(df, multiple=4).collect()}
    assert got["2"].input_ids == [5, 1, 0, 0] and got["2"].attention_mask == [1, 1, 0, 0]
    assert got["1"].labels == [7, 1, -100, -100] and got["2"].labels == [7, 8, 9, 1]


def test_resolve_columns():
    import pytest
    from revisio.operators.projections import resolve_columns
    assert resolve_columns(["a", "b", "c"]) == ("a", "b")
    assert resolve_columns(["a", "b"], dataset_name="xsum") == ("document", "summary")
    assert resolve_columns(["a", "b"], summary_column="a") == ("a", "a")
    assert resolve_columns(["a", "b"], "b", dataset_name="xsum") == ("b", "summary")
    with pytest.raises(ValueError, match="zz"):
        resolve_columns(["a", "b"], text_column="zz")


def test_bleu_tokens_and_zero_matches(spark):
    df = spark.createDataFrame([("It's 3.14 well-known, 5-6 (a&amp;b)! x.", "a b c d e", "v w x y z")], "t string, p string, r string")
    assert df.select(M.bleu_tokens("t").alias("x")).first().x == ["It's", "3.14", "well-known", ",", "5", "-", "6", "(", "a", "&", "b", ")", "!", "x", "."]
    assert M.corpus_bleu(df, "p", "r").first().bleu == 0.0
    none = spark.createDataFrame([(None, "a"), ("", ""), ("b", None)], "p string, r string")
    assert M.corpus_bleu(none, "p", "r").first().bleu == 0.0 and M.rouge_n(none, "p", "r").first().rouge1 == 0.0


def test_row_local_matches_by_counting(spark):
    import random
    from collections import Counter
    rng = random.Random(4)
    rows = [(" ".join(rng.choice("abc") for _ in range(rng.randrange(12))), " ".join(rng.choice("abc") for _ in range(rng.randrange(12)))) for _ in range(60)]
    got = M.corpus_bleu(spark.createDataFrame(rows, "p string, r string"), "p", "r").first()
    for n in range(1, 5):
        grams = [[Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) for w in (p.split(), r.split())] for p, r in rows]
        assert got[f"m{n}"] == sum(sum((a & b).values()) for a, b in grams) and got[f"t{n}"] == sum(sum(a.values()) for a, _ in grams)


def test_union_lcs():
    import random

    def table(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t

    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        t, i, j, places = table(a, b), len(a), len(b), set()
        while i and j:
            if a[i - 1] == b[j - 1]:
                places.add(i - 1)
                i, j = i - 1, j - 1
            elif t[i][j - 1] > t[i - 1][j]:
                j -= 1
            else:
                i -= 1
        assert M._lcs_places(a, b) == places and len(places) == t[-1][-1] == M._lcs(a, b)
    # Two predicted sentences cover different words of one reference sentence.
    assert M._summary_hits([["a", "b"], ["d", "e"]], [["a", "b", "c", "d", "e"]]) == 4
    assert M._summary_hits([["a"]], [["a"], ["a"]]) == 1


def test_score_report(spark):
    df = spark.createDataFrame([("0", "The cat sat. It ran.", "The cat sat. It ran.", [3, 4, 1, 0])], "row_id string, p string, r string, i array<int>")
    got = {r.metric: r.value for r in M.score(df, "p", "r", "i").collect()}
    assert set(got) == {"bleu", "rouge1", "rouge2", "rougeL", "rougeLsum", "gen_len"}
    assert got["gen_len"] == 3.0 and all(abs(got[k] - 100) < 1e-6 for k in got if k != "gen_len")


def test_pair_predictions_meets_every_row(spark):
    import pytest
    p, r = spark.createDataFrame([("1", "a"), ("2", "b")], "row_id string, prediction string"), spark.createDataFrame([("1", "x")], "row_id string, reference string")
    assert [tuple(x) for x in M.pair_predictions(p.limit(1), r).collect()] == [("1", "a", "x")]
    with pytest.raises(Exception, match="no partner for 2"):
        M.pair_predictions(p, r).collect()
