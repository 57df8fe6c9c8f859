"""Registered queries: one per operator / recipe of the inventory.

Each takes ``(spark, sf_dir)`` and reads the driver tables (or data Spark
derives from them), so its work grows with the tables. Arrays that are
results are rendered as text (``'0110'`` masks, space-joined ids) so that
results compare as plain values.
"""
from __future__ import annotations

from typing import Callable, Dict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revisio.functions.text import materialize, words
from revisio.operators import filters as FL
from revisio.operators import order as O
from revisio.operators import projections as P
from revisio.operators.diff import diff_opcodes
from revisio.operators.masks import (full_diff_variant, positions, protect_positions, random_span_variants,
                                     render_runs, single_run_variants, variant_mask, with_encoding)
from revisio.operators.metrics import pair_predictions
from revisio.session import written
from revisio.operators.pairs import (alternatives_unpivot, edit_pairs, masked_pairs, no_edit_pairs,
                                     sample_prompts, simple_pairs, span_annotated_pairs)
from revisio.sources import standins as S
from revisio.sources.prompts import load_prompts

SEED = 7
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: Dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def catalogue():
    return load_prompts()


def mask_text(c) -> F.Column:
    return F.array_join(F.transform(c, lambda b: F.when(b, F.lit("1")).otherwise(F.lit("0"))), "")


# ---------------------------------------------------------------- sources
@query("read_corpus")
def q_read_corpus(spark, sf):
    """A corpus laid out by split, read back without its test split."""
    path = _scratch(spark, "read_corpus")
    S.c4_corpus(spark, sf).write.partitionBy("split").parquet(path)
    return read_corpus(spark, path, splits=["train", "validation"]).select("row_id", "split", "input", "output")


# ------------------------------------------------------------ projections
@query("rename_pair")
def q_rename_pair(spark, sf):
    return P.rename_pair(S.fce_corpus(spark, sf), "text", "edited_text", keep=["row_id", "split"])


@query("drop_columns")
def q_drop_columns(spark, sf):
    return P.drop_columns(S.disco_fuse_corpus(spark, sf),
                          ["connective_string", "discourse_type", "coherent_second_sentence",
                           "has_coref_type_pronoun", "has_coref_type_nominal"])


@query("concat_columns")
def q_concat_columns(spark, sf):
    d = S.disco_fuse_corpus(spark, sf)
    return P.concat_columns(d, "incoherent_first_sentence", "incoherent_second_sentence", "input") \
        .select("row_id", "input", F.col("coherent_first_sentence").alias("output"))


@query("tag_rows")
def q_tag_rows(spark, sf):
    return P.tag_rows(S.conversation_pairs(spark, sf), "conversations", "simple")


@query("reverse_pair")
def q_reverse_pair(spark, sf):
    return P.reverse_pair(S.conversation_pairs(spark, sf))


@query("add_prefix")
def q_add_prefix(spark, sf):
    return P.add_prefix(S.conversation_pairs(spark, sf), "input", "summarize: ")


@query("resolve_columns")
def q_resolve_columns(spark, sf):
    """Each way of finding the two columns: by position, by the known map, by name."""
    keep = ["row_id", "split"]
    wiki = S.wiki_large_corpus(spark, sf)
    known = wiki.select(*keep, F.col("simple").alias("summary"), F.lit(1).alias("other"), F.col("input").alias("dialogue"))
    named = wiki.select(*keep, F.lit(1).alias("other"), "simple", "input")
    ways = {"position": P.select_pair(wiki, keep=keep), "map": P.select_pair(known, dataset_name="samsum", keep=keep),
            "name": P.select_pair(named, "input", "simple", "samsum", keep=keep)}
    out = None
    for way, df in ways.items():
        df = df.withColumn("way", F.lit(way))
        out = df if out is None else out.unionByName(df)
    return out


@query("rename_splits")
def q_rename_splits(spark, sf):
    return P.rename_splits(S.c4_corpus(spark, sf), {"test": "validation"}).select("row_id", "split")


# ---------------------------------------------------------------- filters
@query("filter_word_bounds")
def q_filter_word_bounds(spark, sf):
    return FL.filter_word_bounds(S.conversation_pairs(spark, sf), [("input", 10, 100)])


@query("filter_char_ratio")
def q_filter_char_ratio(spark, sf):
    return FL.filter_char_ratio(S.c4_corpus(spark, sf)).select("row_id")


@query("filter_residual_edits")
def q_filter_residual_edits(spark, sf):
    return FL.filter_residual_edits(S.bea19_corpus(spark, sf), "still_need_edit", 2) \
        .select("row_id", F.size("still_need_edit").alias("residual"))


@query("filter_label")
def q_filter_label(spark, sf):
    return FL.filter_label(S.iterater_v2_corpus(spark, sf), "labels", "clarity").select("row_id", "labels")


@query("filter_not_null")
def q_filter_not_null(spark, sf):
    return FL.filter_not_null(S.paradetox_corpus(spark, sf), ["neutral2", "neutral3"]).select("row_id")


@query("filter_single_span")
def q_filter_single_span(spark, sf):
    return FL.filter_single_span(S.iterater_v2_corpus(spark, sf), "before_sent_with_intent").select("row_id")


@query("filter_intent_prefix")
def q_filter_intent_prefix(spark, sf):
    return FL.filter_intent_prefix(S.iterater_v2_corpus(spark, sf), "before_sent_with_intent", "coherence") \
        .select("row_id")


def with_gaps(df: DataFrame) -> DataFrame:
    """Null sides where doc_id % 11 == 0, empty where doc_id % 13 == 0."""
    d = F.col("doc_id")
    return df.select("row_id",
                     F.when(d % 11 == 0, F.lit(None)).otherwise(F.col("edited")).alias("input"),
                     F.when(d % 13 == 0, F.lit("")).otherwise(F.col("text")).alias("output"))


@query("drop_empty_pairs")
def q_drop_empty_pairs(spark, sf):
    return FL.drop_empty_pairs(with_gaps(S.related_pairs(spark, sf))).select("row_id")


@query("filter_split")
def q_filter_split(spark, sf):
    return FL.filter_split(S.c4_corpus(spark, sf), ["train", "validation"], check=True).select("row_id", "split")


# ---------------------------------------------------------------- joins
@query("pair_predictions")
def q_pair_predictions(spark, sf):
    """Prediction i meets reference i by key: an equi-join on row_id."""
    d = S.table(spark, sf, "documents").select("doc_id", "text")
    preds = materialize(d, {"_tw": words("text")})
    preds = preds.select(F.col("doc_id").cast("string").alias("row_id"),
                         S.edited_text(F.col("doc_id"), F.col("_tw")).alias("prediction"))
    refs = d.select(F.col("doc_id").cast("string").alias("row_id"), F.col("text").alias("reference"))
    return pair_predictions(preds, refs)


# ------------------------------------------------------- pair generation
def conv_pairs_bounded(spark, sf):
    return FL.filter_word_bounds(S.conversation_pairs(spark, sf), [("input", 10, 100)])


@query("sample_prompts")
def q_sample_prompts(spark, sf):
    c = S.conversation_pairs(spark, sf)
    return c.select("row_id", F.posexplode(sample_prompts(catalogue()["gec"], 3, SEED, "q", F.col("row_id")))
                    .alias("j", "prompt"))


@query("simple_pairs")
def q_simple_pairs(spark, sf):
    return simple_pairs(conv_pairs_bounded(spark, sf), catalogue()["gec"], 2, SEED, "q")


@query("masked_pairs")
def q_masked_pairs(spark, sf):
    return masked_pairs(S.conversation_pairs(spark, sf), catalogue()["gec"], 4, False, SEED, "q")


@query("no_edit_pairs")
def q_no_edit_pairs(spark, sf):
    return no_edit_pairs(S.conversation_pairs(spark, sf), catalogue()["do_not_edit"], 300, SEED, stream="q")


def spans_source(spark, sf):
    d = S.iterater_v2_corpus(spark, sf)
    return d.select("row_id", F.col("before_sent_with_intent").alias("input"), F.col("after_sent").alias("output"))


@query("span_annotated_pairs")
def q_span_annotated_pairs(spark, sf):
    return span_annotated_pairs(spans_source(spark, sf), "clarity", catalogue()["simplification"], 3, SEED, "q")


@query("bidirectional_pairs")
def q_bidirectional_pairs(spark, sf):
    c = conv_pairs_bounded(spark, sf)
    cat = catalogue()
    fwd = edit_pairs(c, cat["formality"], 1, 2, False, SEED, "q/fwd").withColumn("from", F.lit("formal"))
    rev = edit_pairs(P.reverse_pair(c), cat["formality_rev"], 1, 2, False, SEED, "q/rev") \
        .withColumn("from", F.lit("informal"))
    return fwd.unionByName(rev)


@query("alternatives_unpivot")
def q_alternatives_unpivot(spark, sf):
    d = S.paradetox_corpus(spark, sf).select("row_id", F.col("toxic").alias("input"), "neutral1", "neutral2",
                                              "neutral3")
    return alternatives_unpivot(d, ["row_id", "input"], ["neutral1", "neutral2", "neutral3"]).select("row_id", "input", "output")


# ---------------------------------------------------------------- masks
def _related_words(spark, sf):
    r = S.related_pairs(spark, sf)
    return r.select("row_id", words("text").alias("_w"), words("edited").alias("_iw"))


@query("diff_opcodes")
def q_diff_opcodes(spark, sf):
    r = _related_words(spark, sf).withColumn("_d", diff_opcodes(F.col("_w"), F.col("_iw")))
    return r.select("row_id", F.posexplode("_d.ops").alias("k", "op")).select("row_id", "k", "op.*")


@query("mask_diff_full")
def q_mask_diff_full(spark, sf):
    r = _related_words(spark, sf).withColumn("_d", diff_opcodes(F.col("_w"), F.col("_iw")))
    return r.select("row_id", mask_text(F.col("_d.mask")).alias("mask"))


@query("mask_diff_single_run")
def q_mask_diff_single_run(spark, sf):
    r = _related_words(spark, sf).withColumn("_d", diff_opcodes(F.col("_w"), F.col("_iw")))
    r = r.select("row_id", "_w", F.col("_d.mask").alias("_full"))
    ex = r.select("row_id", "_w", F.explode(single_run_variants(F.col("_full"), F.size("_w"), SEED, "q",
                                                                F.col("row_id"))).alias("_v"))
    return ex.select("row_id", F.col("_v.variant").alias("variant"),
                     mask_text(variant_mask(F.col("_v"), F.size("_w"))).alias("mask"))


def _random_variants(spark, sf):
    c = S.conversation_pairs(spark, sf).select("row_id", words("output").alias("_w"))
    return c.select("row_id", "_w", F.explode(random_span_variants(F.size("_w"), 4, SEED, "q", F.col("row_id")))
                    .alias("_v"))


@query("mask_random_spans")
def q_mask_random_spans(spark, sf):
    ex = _random_variants(spark, sf)
    return ex.select("row_id", F.col("_v.variant").alias("variant"),
                     mask_text(variant_mask(F.col("_v"), F.size("_w"))).alias("mask"))


@query("mask_protect_words")
def q_mask_protect_words(spark, sf):
    ex = _random_variants(spark, sf)
    m = protect_positions(variant_mask(F.col("_v"), F.size("_w")), F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(99)))
    return ex.select("row_id", F.col("_v.variant").alias("variant"), mask_text(m).alias("mask"))


@query("encode_sentinels")
def q_encode_sentinels(spark, sf):
    ex = materialize(_random_variants(spark, sf), {"_runs": F.col("_v.runs")})
    return render_runs(ex, "_w", "_runs").select("row_id", F.col("_v.variant").alias("variant"), "masked")


@query("encode_targets")
def q_encode_targets(spark, sf):
    ex = materialize(_random_variants(spark, sf), {"_mask": variant_mask(F.col("_v"), F.size("_w"))})
    return with_encoding(ex, "_w", "_mask").select("row_id", F.col("_v.variant").alias("variant"), "target")


# ------------------------------------------------- order, limits, splits
@query("union_splits")
def q_union_splits(spark, sf):
    f = S.fce_corpus(spark, sf)
    parts = [f.filter(F.col("split") == s) for s in ("train", "validation", "test")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("row_id", "split")


@query("union_examples")
def q_union_examples(spark, sf):
    c = conv_pairs_bounded(spark, sf)
    cat = catalogue()
    a = simple_pairs(c, cat["gec"], 1, SEED, "q").withColumn("type", F.lit("simple"))
    b = masked_pairs(c, cat["gec"], 2, False, SEED, "q").withColumn("type", F.lit("mask"))
    n = no_edit_pairs(c, cat["do_not_edit"], 5000, SEED, stream="qn").withColumn("type", F.lit("no edit"))
    return a.unionByName(b).unionByName(n)


def _docs(spark, sf):
    return S.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("row_id"), "lang")


@query("shuffle_rows")
def q_shuffle_rows(spark, sf):
    """The order of the shuffled rows as they are written: each row with its place over the files in part order."""
    shuffled = written(O.shuffle_rows(_docs(spark, sf), SEED), "shuffled")
    rows = shuffled.select("*", F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int").alias("_pid"), F.col("_metadata.row_index").alias("_at"))
    sizes = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"))  # a row a file
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "_pid").select("row_id", "lang", (F.col("base") + F.col("_at")).alias("position"))


@query("head_rows")
def q_head_rows(spark, sf):
    c = S.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return O.head_rows(c, 100, ["conv_id", "turn"])


@query("capped_sample")
def q_capped_sample(spark, sf):
    return O.capped_sample(_docs(spark, sf), 100, SEED)


@query("slice_rows")
def q_slice_rows(spark, sf):
    """A late slice of a table with more rows than a range sample, with a column that is not in the key."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return O.slice_rows(S.table(spark, sf, "lineitem").select(*key, "l_quantity"), 40_000, 40_300, key)


@query("train_fraction")
def q_train_fraction(spark, sf):
    return O.train_fraction(_docs(spark, sf), 0.95, 1337)


@query("global_rank")
def q_global_rank(spark, sf):
    li = S.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in li.columns]))
    return O.hash_rank(li, key, ())


@query("sample_one")
def q_sample_one(spark, sf):
    return O.sample_one(_docs(spark, sf), SEED)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    from revisio.operators.projections import tag_rows
    pairs = simple_pairs(conv_pairs_bounded(spark, sf), catalogue()["gec"], 2, SEED, "q")
    return tag_rows(pairs, "conversations", "simple")


@query("flagship")
def q_flagship(spark, sf):
    return flagship(spark, sf)


# ---------------------------------------------------------------- recipes
from revisio.plans.recipes import RECIPES, generate, generate_mixture  # noqa: E402

CORPUS = {
    "c4_gec": S.c4_corpus, "fce_gec": S.fce_corpus, "lang8": S.lang8_corpus, "bea19": S.bea19_corpus,
    "gyafc": S.gyafc_corpus, "disco_fuse": S.disco_fuse_corpus, "wiki_auto": S.wiki_auto_corpus,
    "wiki_large": S.wiki_large_corpus, "para_bank_v2": S.para_bank_corpus, "wnc": S.wnc_corpus,
    "APPDIA_offensive": S.appdia_corpus, "Paradetox_toxic": S.paradetox_corpus,
    "IteraTeR_Simplicity": S.iterater_v2_corpus, "IteraTeR_Coherence": S.iterater_v2_corpus,
    "IteraTeR_Fluency": S.iterater_v2_corpus, "IteraTeR_V1_Simplicity": S.iterater_v1_corpus,
    "IteraTeR_V1_Coherence": S.iterater_v1_corpus, "IteraTeR_V1_Fluency": S.iterater_v1_corpus,
}


def recipe_frame(spark, sf, key: str) -> DataFrame:
    return generate(RECIPES[key], CORPUS[key](spark, sf), catalogue(), SEED, cut_lineage=True)


def _register_recipe(key: str):
    REGISTRY[key] = lambda spark, sf: recipe_frame(spark, sf, key)


for _k in RECIPES:
    _register_recipe(_k)


@query("mixture")
def q_mixture(spark, sf):
    """All recipes, merged and shuffled. The pairs are derived and stored once;
    recipes on the same corpus share its scan where their settings allow."""
    related = written(S.related_pairs(spark, sf), "related")
    frames = {f: f(spark, sf, related) for f in dict.fromkeys(CORPUS.values())}
    return generate_mixture(list(RECIPES.values()), {k: frames[f] for k, f in CORPUS.items()}, catalogue(), SEED)


# ------------------------------------------------- tokenise, pad, batch
from revisio.operators import batch as B  # noqa: E402
from revisio.operators import metrics as M  # noqa: E402
from revisio.operators import sentences as SE  # noqa: E402
from revisio.operators import tokenize as K  # noqa: E402

VOCAB = 5000
SRC_LEN, TGT_LEN = 128, 64


def vocab_frame(spark, sf):
    return K.build_vocab(S.table(spark, sf, "documents"), ["text"], VOCAB)


def tokenized(spark, sf, vocab=None):
    r = S.related_pairs(spark, sf)
    return K.tokenize(r, vocab or vocab_frame(spark, sf), [("edited", "input_ids", SRC_LEN), ("text", "labels", TGT_LEN)])


@query("build_vocab")
def q_build_vocab(spark, sf):
    return vocab_frame(spark, sf)


@query("tokenize_truncate")
def q_tokenize_truncate(spark, sf):
    t = tokenized(spark, sf)
    return t.select("row_id", K.ids_text("input_ids").alias("input_ids"), K.ids_text("labels").alias("labels"))


@query("pad_to_length")
def q_pad_to_length(spark, sf):
    t = tokenized(spark, sf)
    return t.select("row_id", K.ids_text(K.pad_to_length(F.col("input_ids"), SRC_LEN)).alias("input_ids"),
                    K.ids_text(K.attention_mask(F.col("input_ids"), SRC_LEN)).alias("attention_mask"))


def _padded_labels(spark, sf):
    t = tokenized(spark, sf)
    return t.select("row_id", K.mask_label_padding(K.pad_to_length(F.col("labels"), TGT_LEN)).alias("labels"))


@query("mask_label_padding")
def q_mask_label_padding(spark, sf):
    return _padded_labels(spark, sf).select("row_id", K.ids_text("labels").alias("labels"))


@query("unmask_label_padding")
def q_unmask_label_padding(spark, sf):
    return _padded_labels(spark, sf).select("row_id", K.ids_text(K.unmask_label_padding(F.col("labels")))
                                            .alias("labels"))


@query("shift_right")
def q_shift_right(spark, sf):
    return _padded_labels(spark, sf).select("row_id", K.ids_text(K.shift_right(F.col("labels")))
                                            .alias("decoder_input_ids"))


@query("decoder_attention_mask")
def q_decoder_attention_mask(spark, sf):
    return _padded_labels(spark, sf).select("row_id", K.ids_text(K.decoder_attention_mask(F.col("labels")))
                                            .alias("decoder_attention_mask"))


def _batched(spark, sf, mode):
    return B.assign_batches(_docs(spark, sf), 7, SEED, mode).select("row_id", "batch_id", "pos_in_batch")


@query("assign_batches_drop_last")
def q_b1(spark, sf):
    return _batched(spark, sf, "drop_last")


@query("assign_batches_even")
def q_b2(spark, sf):
    return _batched(spark, sf, "even")


@query("assign_batches_fixed")
def q_b3(spark, sf):
    return _batched(spark, sf, "fixed")


@query("pad_batches")
def q_pad_batches(spark, sf):
    t = B.pad_batches(B.assign_batches(written(tokenized(spark, sf), "tokens"), 8, SEED, "fixed"), multiple=8)
    return t.select("row_id", "batch_id", "pad_len", "label_len", K.ids_text("input_ids").alias("input_ids"),
                    K.ids_text("attention_mask").alias("attention_mask"), K.ids_text("labels").alias("labels"))


def _prepared(spark, sf, start):
    from revisio.operators.prepare import prepare
    t = prepare(with_gaps(S.related_pairs(spark, sf)), vocab_frame(spark, sf), 8, SEED, SRC_LEN, TGT_LEN, start=start, prefix="fix: ", mode="drop_last")
    return t.select("row_id", "batch_id", "pos_in_batch", "pad_len", "label_len", K.ids_text("input_ids").alias("input_ids"),
                    K.ids_text("labels").alias("labels"))


@query("prepare")
def q_prepare(spark, sf):
    """All pairs with gaps: cleaned, prefixed, tokenised, batched and padded."""
    return _prepared(spark, sf, 0)


@query("prepare_all")
def q_prepare_all(spark, sf):
    """The same chain behind a slice: all rows from rank 10 on."""
    return _prepared(spark, sf, 10)


@query("batch_plan")
def q_batch_plan(spark, sf):
    return B.batch_plan(_docs(spark, sf), 8, epochs=3, devices=2, accumulation=4)


@query("collate")
def q_collate(spark, sf):
    b = B.assign_batches(_docs(spark, sf), 7, SEED, "fixed")
    c = B.collate(b, ["row_id"])
    return c.select("batch_id", F.array_join("row_id", ",").alias("row_ids"))


@query("collate_padded")
def q_collate_padded(spark, sf):
    """Batches as a trainer takes them: a row a batch with its padded ids, masks and labels as arrays of arrays."""
    b = B.pad_batches(B.assign_batches(written(tokenized(spark, sf), "tokens"), 8, SEED, "drop_last"), multiple=8)
    c = B.collate(b, ["input_ids", "attention_mask", "labels"])
    return c.select("batch_id", *[F.array_join(F.transform(n, K.ids_text), "|").alias(n) for n in ("input_ids", "attention_mask", "labels")])


# ---------------------------------------------------------------- metrics
def _preds(spark, sf):
    return q_pair_predictions(spark, sf)


@query("clean_text")
def q_clean_text(spark, sf):
    return _preds(spark, sf).select("row_id", M.clean_text(F.col("prediction")).alias("prediction"))


@query("split_sentences")
def q_split_sentences(spark, sf):
    return _preds(spark, sf).select("row_id", M.split_sentences(M.clean_text(F.col("reference"))).alias("reference"))


@query("abbreviations")
def q_abbreviations(spark, sf):
    """How strongly the corpus says that a word's full stop ends no sentence."""
    scores = SE.abbreviation_scores(S.table(spark, sf, "documents"), ["text"])
    return scores.select("word", "with_stop", "without_stop", F.round("score", 6).alias("score"), (F.col("score") >= SE.LEAST).alias("abbreviation"))


@query("split_sentences_learned")
def q_split_sentences_learned(spark, sf):
    """Sentences of the references, with the abbreviations that the corpus itself shows."""
    known = written(SE.abbreviations(SE.abbreviation_scores(S.table(spark, sf, "documents"), ["text"])), "abbreviations")
    refs = _preds(spark, sf).select("row_id", M.clean_text(F.col("reference")).alias("reference"))
    return SE.split_learned(refs, "reference", known, "sentences").select("row_id", "sentences")


@query("decode_ids")
def q_decode_ids(spark, sf):
    vocab = vocab_frame(spark, sf)
    return K.decode_ids(tokenized(spark, sf, vocab), vocab, "labels", "text", True)


@query("corpus_bleu")
def q_corpus_bleu(spark, sf):
    return M.corpus_bleu(_preds(spark, sf), "prediction", "reference")


@query("rouge_n")
def q_rouge_n(spark, sf):
    return M.rouge_n(_preds(spark, sf), "prediction", "reference")


@query("rouge_l")
def q_rouge_l(spark, sf):
    return M.rouge_l(_preds(spark, sf), "prediction", "reference")


@query("rouge_lsum")
def q_rouge_lsum(spark, sf):
    return M.rouge_lsum(_preds(spark, sf), "prediction", "reference")


@query("score")
def q_score(spark, sf):
    """The whole report: all metrics of the predictions and their generated ids."""
    d = _preds(spark, sf).join(tokenized(spark, sf).select("row_id", "input_ids"), "row_id")
    return M.score(d, "prediction", "reference", "input_ids")


@query("score_levels")
def q_score_levels(spark, sf):
    """Scores of each source, of each kind and of all rows, from one pass over the counts of each metric."""
    tags = S.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("row_id"), F.col("source").alias("from"), F.col("lang").alias("type"))
    d = _preds(spark, sf).join(tags, "row_id").join(tokenized(spark, sf).select("row_id", "input_ids"), "row_id")
    return M.score_levels(d, "prediction", "reference", ["from", "type"], "input_ids")


@query("rouge_intervals")
def q_rouge_intervals(spark, sf):
    """Resampled 95 % intervals of ROUGE-1 and ROUGE-2 over 1,000 replicates."""
    return M.rouge_intervals(_preds(spark, sf), "prediction", "reference", replicates=1000, seed=SEED)


@query("rouge_stemmed")
def q_rouge_stemmed(spark, sf):
    return M.rouge_n(_preds(spark, sf), "prediction", "reference", stem=True)


@query("gen_len")
def q_gen_len(spark, sf):
    t = tokenized(spark, sf).select(K.pad_to_length(F.col("input_ids"), SRC_LEN).alias("ids"))
    return M.gen_len(t, "ids")


@query("scale_round")
def q_scale_round(spark, sf):
    """The metric report: BLEU (already 0-100) and ROUGE-1/2 (x100), 4 places."""
    p = _preds(spark, sf)
    b = M.corpus_bleu(p, "prediction", "reference").select(F.lit("bleu").alias("metric"),
                                                           F.col("bleu").alias("value"))
    r = M.rouge_n(p, "prediction", "reference")
    r = r.select(F.explode(F.array(F.struct(F.lit("rouge1").alias("metric"), F.col("rouge1").alias("value")),
                                   F.struct(F.lit("rouge2").alias("metric"), F.col("rouge2").alias("value"))))
                 .alias("m")).select("m.*")
    return b.unionByName(r)


@query("count_examples")
def q_count_examples(spark, sf):
    return M.count_examples(S.c4_corpus(spark, sf), {"train": 500, "validation": 50, "test": 1000})


# ----------------------------------------------------------- sinks, files
import uuid  # noqa: E402

from revisio.session import scratch_path  # noqa: E402
from revisio.sources import sinks as SK  # noqa: E402
from revisio.sources.corpus import read_corpus, read_files  # noqa: E402
from revisio.sources.lines import numbered_lines, pair_lines  # noqa: E402


def _scratch(spark, name):
    return scratch_path(spark, f"revisio-out/{name}-{uuid.uuid4().hex}")


@query("write_corpus")
def q_write_corpus(spark, sf):
    """Generate a recipe, write it partitioned by from/type in seeded random
    order to the shared folder, read it back."""
    path = _scratch(spark, "corpus")
    SK.write_corpus(generate(RECIPES["wiki_large"], CORPUS["wiki_large"](spark, sf), catalogue(), SEED, shuffle=None),
                    path, seed=SEED)
    return spark.read.parquet(path).select("row_id", "variant", "input", "output", "type", "from")


@query("write_predictions")
def q_write_predictions(spark, sf):
    """Line i of the written predictions is example i: the lines are read back with their places."""
    path = _scratch(spark, "predictions")
    SK.write_predictions(q_clean_text(spark, sf), path)
    return numbered_lines(spark, path).select("line", "value")


@query("pair_by_position")
def q_pair_by_position(spark, sf):
    """Predictions and references written as plain lines, over several files each and without a key, meet by line number."""
    d = _preds(spark, sf)
    predictions, references = _scratch(spark, "predictions"), _scratch(spark, "references")
    SK.write_predictions(d.select("row_id", M.clean_text(F.col("prediction")).alias("prediction")), predictions)
    SK.write_predictions(d.select("row_id", M.clean_text(F.col("reference")).alias("reference")), references, "reference")
    return pair_lines(spark, predictions, references)


@query("write_metrics")
def q_write_metrics(spark, sf):
    path = _scratch(spark, "metrics")
    SK.write_metrics(q_scale_round(spark, sf), path, prefix="eval_")
    return spark.read.json(path)


@query("read_files")
def q_read_files(spark, sf):
    """Pairs written as CSV (train) and JSON lines (validation), read back
    with the format taken from each file name."""
    c = S.conversation_pairs(spark, sf).withColumn("_odd", F.substring_index("row_id", ":", 1).cast("int") % 2)
    base = _scratch(spark, "files")
    train, val = f"{base}/train.csv", f"{base}/validation.jsonl"
    c.filter(F.col("_odd") == 0).drop("_odd").write.option("header", True).option("escape", '"').csv(train)
    c.filter(F.col("_odd") == 1).drop("_odd").write.json(val)
    schema = "row_id string, input string, output string"
    from pyspark.sql.types import _parse_datatype_string
    return read_files(spark, {"train": train, "validation": val}, _parse_datatype_string(schema), multiline=True)


@query("build_all")
def q_build_all(spark, sf):
    """Every enabled recipe of the default configuration: corpora stored by
    name and split, read by name, generated, written and read back."""
    import os
    from revisio.plans.recipes import build_all
    from revisio.sources.config import load_recipe_config
    config = os.path.join(os.path.dirname(os.path.dirname(__file__)), "resources", "recipes.yaml")
    root, stored = _scratch(spark, "corpora"), set()
    for key, opts in load_recipe_config(config):
        name = opts.get("name", key)
        if name not in stored:
            stored.add(name)
            CORPUS[key](spark, sf).write.partitionBy("split").parquet(f"{root}/{name}")
    return build_all(spark, config, root, _scratch(spark, "build_all"), catalogue(), SEED)


@query("stream_examples")
def q_stream_examples(spark, sf):
    """A recipe's plain and masked pairs from a stream over stored corpus files,
    a few files a batch, written by the streaming sink and read back."""
    from revisio.streaming import stream_to_corpus
    source, out, state = (_scratch(spark, f"stream-{n}") for n in ("in", "out", "state"))
    corpus = CORPUS["wiki_large"](spark, sf)
    # Two batches of as many files as there are cores to read them.
    cores = max(2, spark.sparkContext.defaultParallelism)
    corpus.repartition(2 * cores, "row_id").write.parquet(source)
    rows = spark.readStream.schema(corpus.schema).option("maxFilesPerTrigger", cores).parquet(source)
    stream_to_corpus(rows, RECIPES["wiki_large"], catalogue(), out, state, SEED).awaitTermination()
    return spark.read.parquet(out).select("row_id", "variant", "input", "output", "type", "from")


@query("assign_prompts")
def q_assign_prompts(spark, sf):
    """Rows x the recipe's prompt group, keep a sample per row: the group is
    a literal array, so this needs no join (and no cross product)."""
    c = S.conversation_pairs(spark, sf)
    return c.select("row_id", F.array_join(sample_prompts(catalogue()["formality"], 2, SEED, "j1", F.col("row_id")),
                                           " | ").alias("prompts"))
