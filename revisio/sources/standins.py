"""Stand-in corpora derived from the driver tables (FIXTURES.md section 3).

The reference reads 18 external corpora that are not available offline. Each
function here derives a corpus with the *same column names* the recipe
expects from ``documents`` or ``conversations``, so the recipes run unchanged
on whole tables and their work grows with the data. Every rule is plain SQL
that DuckDB evaluates identically (see ``checks/oracle.py``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revisio.functions.rng import u32
from revisio.functions.text import materialize, words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _key(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def edited_text(doc_id: Column, w: Column) -> Column:
    """A related text from the word array ``w`` (a materialised column): word
    i is dropped when ``u32(edit|doc|i) % 10 == 0`` and doubled when it is 1;
    words are re-joined with single spaces. Each draw, and the part of its key
    that is the row's, is computed once."""
    def draws(key):
        return F.transform(w, lambda x, i: (u32(F.md5(F.concat(key, i.cast("string")))) % 10).cast("int"))

    key = F.concat(F.concat_ws("|", F.lit("edit"), doc_id.cast("string")), F.lit("|"))
    drawn = F.transform(F.array(key), draws)[0]
    # array_join leaves out nulls.
    toks = F.zip_with(w, drawn, lambda x, r: F.when(r == 1, F.concat(x, F.lit(" "), x)).when(r != 0, x))
    return F.array_join(toks, " ")


def split_of(doc_id: Column) -> Column:
    r = doc_id % 10
    return F.when(r == 0, "test").when(r == 1, "validation").otherwise("train")


def related_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as (row_id, split, doc_id, text, edited)."""
    return related_from(table(spark, sf_dir, "documents"))


def related_from(documents: DataFrame) -> DataFrame:
    """Row-local, so it also accepts a streaming ``documents`` source."""
    d = documents.select("doc_id", "text")
    d = d.select(F.col("doc_id").cast("string").alias("row_id"), split_of(F.col("doc_id")).alias("split"),
                 "doc_id", "text")
    d = materialize(d, {"_tw": words("text")})
    return materialize(d, {"edited": edited_text(F.col("doc_id"), F.col("_tw"))}).drop("_tw")


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn t answered by assistant turn t+1 of the same conversation:
    (row_id, input, output). An equi-join on (conv_id, turn)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = c.filter(F.col("role") == "user").alias("u")
    a = c.filter(F.col("role") == "assistant").alias("a")
    j = u.join(a, (F.col("u.conv_id") == F.col("a.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1))
    return j.select(F.concat(F.col("u.conv_id").cast("string"), F.lit(":"), F.col("u.turn").cast("string"))
                    .alias("row_id"), F.col("u.text").alias("input"), F.col("a.text").alias("output"))


def _rel(spark, sf_dir, related=None):
    """``related``: the pairs, where they have been derived and stored before."""
    return related_pairs(spark, sf_dir) if related is None else related


def c4_corpus(spark, sf_dir, related=None):
    r = _rel(spark, sf_dir, related)
    return r.select("row_id", "split", F.col("edited").alias("input"), F.col("text").alias("output"))


lang8_corpus = c4_corpus


def fce_corpus(spark, sf_dir, related=None):
    r = _rel(spark, sf_dir, related)
    residual = F.slice(F.array(F.lit("x"), F.lit("y"), F.lit("z")), 1, (F.col("doc_id") % 4).cast("int"))
    return r.select("row_id", "split", F.col("edited").alias("text"), F.col("text").alias("edited_text"),
                    residual.alias("still_need_edit"))


bea19_corpus = fce_corpus


def gyafc_corpus(spark, sf_dir, related=None):
    r = _rel(spark, sf_dir, related)
    d = F.col("doc_id")
    split = F.when(d % 10 == 0, "test").when(d % 2 == 1, "family_train").otherwise("ent_train")
    return r.select("row_id", split.alias("split"), F.col("edited").alias("informal"), F.col("text").alias("formal"))


def disco_fuse_corpus(spark, sf_dir, related=None):
    r = materialize(_rel(spark, sf_dir, related), {"_tw": words("text")})
    w = F.col("_tw")
    half = (F.size(w) / 2).cast("int")
    return r.select(
        "row_id", "split",
        F.array_join(F.slice(w, 1, half), " ").alias("incoherent_first_sentence"),
        F.array_join(F.slice(w, half + 1, F.size(w) - half), " ").alias("incoherent_second_sentence"),
        F.col("edited").alias("coherent_first_sentence"),
        F.lit("").alias("coherent_second_sentence"),
        F.lit("and").alias("connective_string"), F.lit("PAIR").alias("discourse_type"),
        F.lit(False).alias("has_coref_type_pronoun"), F.lit(False).alias("has_coref_type_nominal"))


def wiki_auto_corpus(spark, sf_dir, related=None):
    r = _rel(spark, sf_dir, related)
    return r.select("row_id", "split", F.col("text").alias("normal"), F.col("edited").alias("simple"))


def wiki_large_corpus(spark, sf_dir, related=None):
    r = _rel(spark, sf_dir, related)
    return r.select("row_id", "split", F.col("text").alias("input"), F.col("edited").alias("simple"))


def para_bank_corpus(spark, sf_dir, related=None):
    r = _rel(spark, sf_dir, related)
    return r.select("row_id", "split", F.col("text").alias("input_text"), F.col("edited").alias("paraphrased_text"),
                    F.lit(0.5).alias("similarity"))


def wnc_corpus(spark, sf_dir, related=None):
    r = _rel(spark, sf_dir, related)
    return r.select("row_id", "split", F.col("edited").alias("text"), F.col("text").alias("edited_text"))


def appdia_corpus(spark, sf_dir, related=None):
    r = _rel(spark, sf_dir, related)
    return r.select("row_id", "split", F.col("edited").alias("offensive-text"),
                    F.col("text").alias("style-transferred-text"))


def paradetox_corpus(spark, sf_dir, related=None):
    r = _rel(spark, sf_dir, related)
    d = F.col("doc_id")
    return r.select("row_id", "split", F.col("edited").alias("toxic"), F.col("text").alias("neutral1"),
                    F.when(d % 2 == 0, F.lit(None)).otherwise(F.concat(F.col("text"), F.lit(" indeed")))
                    .alias("neutral2"),
                    F.when(d % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("Well, "), F.col("text")))
                    .alias("neutral3"))


def label_of(doc_id: Column) -> Column:
    r = doc_id % 3
    return F.when(r == 0, "clarity").when(r == 1, "coherence").otherwise("fluency")


def iterater_v2_corpus(spark, sf_dir, related=None):
    """Before-text with one ``<S>..</S>`` span over words k..k+2 (two spans
    when ``doc_id % 5 == 0``), prefixed ``<label>`` (no prefix when
    ``doc_id % 7 == 0``); after-text is the document."""
    r = materialize(_rel(spark, sf_dir, related), {"_ew": words("edited")})
    d = F.col("doc_id")
    ew = F.col("_ew")
    n = F.size(ew)
    r = materialize(r, {"_k": (u32(_key("span", d.cast("string"))) % F.greatest(n - 2, F.lit(1))).cast("int")})
    k = F.col("_k")
    last = F.least(k + 2, n - 1)
    span = F.concat(F.lit("<S>"), F.array_join(F.slice(ew, k + 1, last - k + 1), " "), F.lit("</S>"))
    tagged = F.array_join(F.concat(F.slice(ew, F.lit(1), k), F.array(span), F.slice(ew, last + 2, F.greatest(n - last - 1, F.lit(0)))), " ")
    tagged = F.when(n > 0, tagged).when(n == 0, F.lit(""))
    tagged = F.when(d % 5 == 0, F.concat(tagged, F.lit(" <S>more</S>"))).otherwise(tagged)
    label = label_of(d)
    prefix = F.when(d % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("<"), label, F.lit(">")))
    return r.select("row_id", "split", F.concat(prefix, tagged).alias("before_sent_with_intent"),
                    F.col("text").alias("after_sent"), F.col("edited").alias("before_sent"),
                    label.alias("labels"), F.lit(0.9).alias("confidence"), "doc_id",
                    F.lit(1).alias("revision_depth"))


def iterater_v1_corpus(spark, sf_dir, related=None):
    r = _rel(spark, sf_dir, related)
    d = F.col("doc_id")
    split = F.when(d % 10 == 0, "human_validation").when(d % 10 == 1, "full_validation").otherwise("train")
    return r.select("row_id", split.alias("split"), F.col("edited").alias("input"), F.col("text").alias("output"),
                    label_of(d).alias("task"))
