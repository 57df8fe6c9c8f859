"""The stemmer's steps against published examples and a letter-by-letter version."""
import re

import duckdb
from pyspark.sql import functions as F

from revisio.operators import metrics as M
from revisio.operators.stem import STEP_2, STEP_3, STEP_4, sql_stems, stems

# Examples of the published description and their stems.
GOLDEN = dict(x.split(":") for x in """
caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing
conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file
happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc hesitanci:hesit digitizer:digit
conformabli:conform radicalli:radic differentli:differ vileli:vile analogousli:analog vietnamization:vietnam predication:predic
operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit
sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electriciti:electr electrical:electr hopeful:hope goodness:good
revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit
replacement:replac adjustment:adjust dependent:depend adoption:adopt homologou:homolog communism:commun activate:activ
angulariti:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll
generalizations:gener oscillators:oscil apology:apolog yellow:yellow yes:yes
""".split())


def vowel(w, i):
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not vowel(w, i - 1))


def measure(w):
    return len(re.findall("VC", re.sub(r"(.)\1+", r"\1", "".join("V" if vowel(w, i) else "C" for i in range(len(w))))))


def cvc(w):
    return len(w) > 2 and not vowel(w, len(w) - 3) and vowel(w, len(w) - 2) and not vowel(w, len(w) - 1) and w[-1] not in "wxy"


def short(w):
    """A stem that is one consonant group, one vowel and one consonant."""
    return cvc(w) and measure(w) == 1


def replaced(w, rules, ok):
    for s, new in sorted(rules, key=lambda r: -len(r[0])):
        if w.endswith(s):
            stem = w[:-len(s)]
            return stem + new if ok(stem, s) else w
    return w


def porter(w):
    has = lambda s: any(vowel(s, i) for i in range(len(s)))
    if len(w) < 4:
        return w
    for s, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(s):
            w = w[:-len(s)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for s in ("ed", "ing"):
            if w.endswith(s):
                stem = w[:-len(s)]
                if has(stem):
                    w = stem
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and not vowel(w, len(w) - 1) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif short(w):
                        w += "e"
                break
    if w.endswith("y") and has(w[:-1]):
        w = w[:-1] + "i"
    w = replaced(w, STEP_2, lambda s, _: measure(s) > 0)
    w = replaced(w, STEP_3, lambda s, _: measure(s) > 0)
    w = replaced(w, [(s, "") for s in (*STEP_4, "ion")], lambda s, e: measure(s) > 1 and (e != "ion" or s.endswith(("s", "t"))))
    if w.endswith("e"):
        stem = w[:-1]
        if measure(stem) > 1 or (measure(stem) == 1 and not short(stem)):
            w = stem
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w


def words(spark):
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = texts.select(F.explode(M.rouge_tokens("text")).alias("w")).distinct().filter("w rlike '^[a-z]+$' and length(w) < 30").orderBy("w").limit(4000)
    suffixed = [a + b for a in ("relat", "hop", "tan", "sky", "yell", "agre", "oper", "y", "by", "trou", "fizz", "control") for b in
                ("", "e", "ed", "ing", "ies", "ational", "ization", "iveness", "fulness", "ment", "ement", "ion", "sion", "ll", "y", "ly", "eed", "sses", "al", "icate")]
    return sorted({r.w for r in found.collect()} | set(GOLDEN) | set(suffixed))


def test_published_examples_and_every_word_of_the_corpus(spark):
    every = words(spark)
    df = spark.createDataFrame([(every,)], "w array<string>")
    got = dict(zip(every, df.select(stems(F.col("w")).alias("s")).first().s))
    assert {w: got[w] for w in GOLDEN} == GOLDEN
    assert got == {w: porter(w) for w in every} and len(every) > 1000


def test_sql_says_the_same(spark):
    every = words(spark)[::7]
    df = spark.createDataFrame([(every,)], "w array<string>")
    got = df.select(stems(F.col("w")).alias("s")).first().s
    assert duckdb.execute(f"SELECT {sql_stems('w')} FROM (SELECT $1::VARCHAR[] AS w) t", [every]).fetchone()[0] == got


def test_nulls_and_short_words(spark):
    df = spark.createDataFrame([([],), (None,), (["as", "ties", "the"],)], "w array<string>")
    assert [r.s for r in df.select(stems(F.col("w")).alias("s")).collect()] == [[], None, ["as", "ti", "the"]]


def test_stemmed_scores(spark):
    df = spark.createDataFrame([("the cats are running", "the cat runs")], "p string, r string")
    assert M.rouge_n(df, "p", "r", (1,)).first().rouge1 < M.rouge_n(df, "p", "r", (1,), stem=True).first().rouge1


def test_python_steps_are_the_native_ones(spark):
    """The kernel of stemmed ROUGE against the column expressions, on every suffix behind every kind of stem, digits and short words."""
    from revisio.operators.stem import STEP_2, STEP_3, STEP_4, stemmed
    ends = [s for s, _ in (*STEP_2, *STEP_3)] + [*STEP_4, "ion", "sion", "eed", "ed", "ing", "y", "e", "s", "ss", "sses", "ies", "ll", "tted", "zzing", "1", ""]
    every = sorted({b + e for b in ("", "y", "yay", "b", "sky", "tr", "hop", "fill", "ab", "relat", "condit", "o", "aa", "x9", "zzz", "syz") for e in ends} - {""})
    native = spark.createDataFrame([(every,)], "w array<string>").select(stems(F.col("w")).alias("s")).first().s
    assert stemmed(every) == native and stemmed(every) == native  # as computed, and as remembered


def test_stemmed_rouge_cuts_and_stems_in_one_kernel(spark):
    """Before, each word went through every condition of every step as a column expression."""
    from revisio.operators import metrics as M
    df = spark.createDataFrame([("Running dogs, relational", "the dog runs relate"), (None, "a"), ("", "")], "p string, r string")
    got = M.rouge_n(df, "p", "r", stem=True)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "transform" not in plan
    # run dog relat / the dog run relat: 3 matches of 3 and 4, no pair in common.
    assert got.first().rouge1 == round(100 * (6 / 7) / 3, 4)
