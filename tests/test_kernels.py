"""The Arrow kernels against the plain forms that they replace."""
import random
from collections import Counter

from pyspark.sql import functions as F

from revisio.functions.text import strip, words
from revisio.operators import diff as D
from revisio.operators import metrics as M


def test_words_and_strip_are_pythons_over_every_character(spark):
    texts = [f"{chr(c)}a{chr(c)}{chr(c + 1)}b" for c in range(1, 0x3100, 2) if not 0xD7FF <= c <= 0xDFFF]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", words("t").alias("w"), strip("t").alias("s")).collect():
        assert r.w == r.t.split() and r.s == r.t.strip(), [hex(ord(c)) for c in r.t]


def test_13a_word_by_word_is_13a_over_the_text(spark):
    rng = random.Random(3)
    pieces = [*"ab01.,-'! \t&;/", " ", "é", "..", "-\n", "&quot;", "1,5", "<skipped>", "\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(M.bleu_tokens("t").alias("w"), M._plain_13a("t").alias("p")).collect():
        assert M._13a_words(r.p) == r.w, r.p


def test_overlaps_by_counting():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        want = []
        for n in (1, 2, 4):
            g, k = ([tuple(s[i:i + n]) for i in range(len(s) - n + 1)] for s in (a, b))
            want += [sum((Counter(g) & Counter(k)).values()), len(g), len(k)]
        assert M._overlaps(a, b, (1, 2, 4)) == want


def test_poisson_from_hex_is_poisson_from_numbers(spark):
    df = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("d"))
    df = df.unionByName(spark.createDataFrame([("f" * 32,), ("0" * 32,)], "d string"))
    assert df.filter(M._poisson_hex(F.col("d")) != M._poisson(M.u32(F.col("d")))).count() == 0


def test_union_over_sentences_with_a_token_is_the_union_over_all(monkeypatch):
    rng = random.Random(7)
    for _ in range(300):
        pred, ref = ([[rng.choice("abcdef") for _ in range(rng.randrange(7))] for _ in range(rng.randrange(7))] for _ in range(2))
        left_p, left_r, hits = Counter(t for s in pred for t in s), Counter(t for s in ref for t in s), 0
        for s in ref:
            for i in sorted(set().union(*(M._lcs_places(s, p) for p in pred))):
                if left_p[s[i]] > 0 and left_r[s[i]] > 0:
                    hits, left_p[s[i]], left_r[s[i]] = hits + 1, left_p[s[i]] - 1, left_r[s[i]] - 1
        assert M._summary_hits(pred, ref) == hits
    # Sentences without a token in common are never compared: each meets its own.
    calls, plain = [], M._lcs_places
    monkeypatch.setattr(M, "_lcs_places", lambda a, b: calls.append(1) or plain(a, b))
    text = [[f"{w}{k}" for w in "abcd"] for k in range(100)]
    assert M._summary_hits(text, text) == 400 and len(calls) <= 100


def test_difference_kernel_keeps_numbers_not_words():
    """A batch's words are numbered row by row: equal words get equal numbers within a row."""
    import pyarrow as pa
    x, y = pa.array([["a", "b", "a"]]), pa.array([["b", "c"]])
    assert D._numbers(x[0], y[0]) == ([0, 1, 0], [1, 2])


def test_difference_kernel_with_nulls_and_empty_rows(spark):
    rows = [("a b c d", "a c d e"), (None, "a"), ("a", None), ("", ""), ("", "x"), ("x y", ""), ("a b", "a b")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").coalesce(1)
    got = df.withColumn("d", D.diff_opcodes(words("a"), words("b"))).orderBy("i").collect()
    for r, (a, b) in zip(got, rows):
        if a is None or b is None:
            assert r.d.ops is None and r.d.mask is None
            continue
        ops, mask = D.opcodes_and_mask(a.split(), b.split())
        assert [x.asDict() for x in r.d.ops] == ops and r.d.mask == mask
    # Also where a task has no row, and where its first batch is all null.
    assert df.filter("false").withColumn("d", D.diff_opcodes(words("a"), words("b"))).count() == 0
    null = df.filter("i = 1").withColumn("d", D.diff_opcodes(words("a"), words("b"))).collect()
    assert null[0].d.ops is None


def test_score_reads_its_rows_once(spark):
    """The report gives each metric's own value, from one pass (before, every metric derived the rows anew)."""
    rows = [(str(i), p, r, ids) for i, (p, r, ids) in enumerate([
        ("The cat sat. On the mat!", "The cat sat on the mat.", [4, 5, 0]), (None, "a b", [1]), ("x y z", None, None), ("", "", []),
        ("One two three four five. Six seven.", "One two three four six. Six seven eight.", [1, 2, 3])])]
    df = spark.createDataFrame(rows, "row_id string, p string, r string, ids array<int>")
    seen = spark.sparkContext.accumulator(0)

    def tap(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = {r.metric: r.value for r in M.score(df.mapInArrow(tap, df.schema), "p", "r", "ids").collect()}
    assert seen.value == len(rows)
    each = [M.corpus_bleu(df, "p", "r").select("bleu"), M.rouge_n(df, "p", "r"), M.rouge_l(df, "p", "r"), M.rouge_lsum(df, "p", "r"), M.gen_len(df, "ids")]
    assert got == {k: v for t in each for k, v in t.first().asDict().items()} and len(got) == 6
    assert M.score(df, "p", "r").count() == 5


def test_the_union_of_subsequences_does_not_depend_on_the_order_of_places():
    draw = random.Random(5)
    for _ in range(200):
        s, preds = ([[draw.choice("abcdefgh") for _ in range(draw.randint(0, 9))] for _ in range(n)] for n in (1, draw.randint(0, 6)))
        having = {}
        for k, p in enumerate(preds):
            for t in set(p):
                having.setdefault(t, []).append(k)
        kept = [[j for j, t in enumerate(s[0]) if t in p] for p in preds]
        whole = {j[i] for j, p in zip(kept, preds) for i in M._lcs_places([s[0][x] for x in j], p)}
        assert M._union_places(s[0], [(p, set(p)) for p in preds], having) == whole
