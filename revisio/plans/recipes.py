"""Corpus recipes: filter -> project -> [subset] ->
{plain + masked + no-edit} -> tag -> shuffle.

A recipe is a value, not a subclass: its corpus-specific steps are small
``DataFrame -> DataFrame`` functions. ``generate`` returns
``(row_id, variant, input, output, type, from)``; ``row_id`` and ``variant``
identify each example and can be dropped at the sink.
"""
from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from typing import Callable, Dict, List, Mapping, Optional, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revisio.operators.filters import char_ratio_ok, filter_single_span, word_bounds
from revisio.operators.order import shuffle_for_write, shuffle_rows, train_fraction
from revisio.operators.pairs import Late, alternatives_unpivot, edit_pairs, finished, late_edit_pairs, late_span_pairs, no_edit_pairs, span_annotated_pairs
from revisio.operators.projections import reverse_pair
from revisio.operators.store import can_put_aside, tasks_for
from revisio.session import removed, written

Step = Callable[[DataFrame], DataFrame]
OUT_COLS = ["row_id", "variant", "input", "output", "type", "from"]


def _pair(inp: str, out: str) -> Step:
    return lambda df: df.select("row_id", F.col(f"`{inp}`").alias("input"), F.col(f"`{out}`").alias("output"))


#: Which of the recipes that share a scan a row is for.
OF = "_of"


def _of(df: DataFrame) -> List[str]:
    return [c for c in (OF,) if c in df.columns]


@dataclass(frozen=True)
class Recipe:
    key: str
    tag: str
    group: str
    splits: Sequence[str]
    prepare: Step                       # corpus rows -> (row_id, input, output, ...)
    repeat: int = 1
    mask_sample_size: int = 4
    diff: bool = False
    cap: int = 5000
    reverse_group: Optional[str] = None
    reverse_tag: Optional[str] = None
    fraction: Optional[float] = None    # exact-size random train subset
    fraction_seed: int = 1337
    expand: Optional[Step] = None       # after the subset (one row per alternative)
    intent: Optional[str] = None        # annotated-span recipes
    type_filter: Optional[tuple] = None  # (column, value) applied first

    def with_options(self, **opts) -> "Recipe":
        mapping = {"repeat_with_different_prompts": "repeat", "mask_sample_size": "mask_sample_size",
                   "diff_mask": "diff", "max_no_edit_samples": "cap"}
        changes = {mapping[k]: v for k, v in opts.items() if k in mapping}
        return dataclasses.replace(self, **changes)


def _c4(df):
    df = df.filter(word_bounds("input", 10, 100) & char_ratio_ok("input", "output"))
    return df.select("row_id", "input", "output")


def _fce(df):
    df = df.filter(F.coalesce(F.size("still_need_edit") == 0, F.lit(False)) & word_bounds("text", None, 300))
    return _pair("text", "edited_text")(df)


def _lang8(df):
    return df.filter(word_bounds("input", 12, 50)).select("row_id", "input", "output")


def _bea19(df):
    df = df.filter(word_bounds("text", None, 350) & F.coalesce(F.size("still_need_edit") < 2, F.lit(False)))
    return _pair("text", "edited_text")(df)


def _gyafc(df):
    return _pair("informal", "formal")(df).filter(word_bounds("input", 7, 70))


def _disco(df):
    df = df.filter(word_bounds("incoherent_first_sentence", 8, None) & word_bounds("incoherent_second_sentence", 8, None))
    return df.select("row_id", F.concat(F.col("incoherent_first_sentence"), F.lit(" "),
                                        F.col("incoherent_second_sentence")).alias("input"),
                     F.col("coherent_first_sentence").alias("output"))


def _wiki_auto(df):
    return _pair("normal", "simple")(df.filter(word_bounds("normal", 10, 400) & word_bounds("simple", 10, 400)))


def _wiki_large(df):
    return _pair("input", "simple")(df.filter(word_bounds("input", 20, 100) & word_bounds("simple", 15, 100)))


def _paradetox(df):
    df = df.filter(word_bounds("toxic", 6, None) & word_bounds("neutral1", 6, None))
    return df.select("row_id", F.col("toxic").alias("input"), "neutral1", "neutral2", "neutral3")


def _paradetox_expand(df):
    return alternatives_unpivot(df, ["row_id", "input"], ["neutral1", "neutral2", "neutral3"])


def _iterater_v2(df):
    df = df.filter(word_bounds("before_sent_with_intent", 10, None) & word_bounds("after_sent", 10, None))
    df = filter_single_span(df, "before_sent_with_intent")
    return df.select("row_id", F.col("before_sent_with_intent").alias("input"), F.col("after_sent").alias("output"), *_of(df))


def _iterater_v1(df):
    return df.select("row_id", "input", "output", *_of(df))


def _v2(kind: str, group: str, repeat: int) -> Recipe:
    return Recipe(f"IteraTeR_{ {'clarity': 'Simplicity', 'coherence': 'Coherence', 'fluency': 'Fluency'}[kind] }",
                  f"IteraTeRV2_{kind}", group, ("train",), _iterater_v2, repeat=repeat, intent=kind,
                  type_filter=("labels", kind))


def _v1(kind: str, group: str, repeat: int) -> Recipe:
    return Recipe(f"IteraTeR_V1_{ {'clarity': 'Simplicity', 'coherence': 'Coherence', 'fluency': 'Fluency'}[kind] }",
                  f"IteraTerV1_{kind}", group, ("train", "human_validation", "full_validation"), _iterater_v1,
                  repeat=repeat, type_filter=("task", kind))


# Recipe parameters of the default configuration (splits,
# bounds, prompt groups, repeat / mask / diff settings, `from` tags).
RECIPES: Dict[str, Recipe] = {r.key: r for r in [
    Recipe("c4_gec", "c4_gec", "gec", ("train",), _c4, repeat=1, mask_sample_size=2, diff=True),
    Recipe("fce_gec", "fce_gec", "gec", ("train", "validation", "test"), _fce, repeat=3, mask_sample_size=10,
           diff=True),
    Recipe("lang8", "clang8_gec", "gec", ("train",), _lang8, repeat=1, mask_sample_size=1, diff=True),
    Recipe("bea19", "bea19_gec", "gec", ("train", "validation"), _bea19, repeat=2, mask_sample_size=10, diff=True),
    Recipe("gyafc", "gyafc_formal", "formality", ("ent_train", "family_train"), _gyafc, repeat=1,
           mask_sample_size=5, reverse_group="formality_rev", reverse_tag="gyafc_informal"),
    Recipe("disco_fuse", "disco_fuse_coh", "coherence", ("train",), _disco, repeat=1, mask_sample_size=4,
           fraction=0.95),
    Recipe("wiki_auto", "wiki_auto_simplicity", "simplification", ("train",), _wiki_auto, repeat=1,
           mask_sample_size=3),
    Recipe("wiki_large", "wiki_large_simplicity", "simplification", ("train",), _wiki_large, repeat=1,
           mask_sample_size=2),
    Recipe("para_bank_v2", "parabank_paraphrase", "paraphrasing", ("train",), _pair("input_text", "paraphrased_text"),
           repeat=1, mask_sample_size=5, fraction=0.95),
    Recipe("wnc", "wnc_neut", "neutralization", ("train", "validation"), _pair("text", "edited_text"), repeat=1,
           mask_sample_size=5, diff=True, fraction=0.95),
    Recipe("APPDIA_offensive", "appdia_offensive", "offensive", ("train", "validation"),
           _pair("offensive-text", "style-transferred-text"), repeat=1, mask_sample_size=5, diff=True),
    Recipe("Paradetox_toxic", "paradetox_toxic", "toxic", ("train",), _paradetox, repeat=1, mask_sample_size=3,
           diff=True, fraction=0.95, expand=_paradetox_expand),
    _v2("clarity", "simplification", 3),
    _v2("coherence", "coherence", 4),
    _v2("fluency", "gec", 3),
    _v1("clarity", "simplification", 3),
    _v1("coherence", "coherence", 4),
    _v1("fluency", "gec", 3),
]}


def _cut(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder, as compressed columns, and read back."""
    return written(df, "prepared")


def prepared(recipe: Recipe, corpus: DataFrame, cut_lineage: bool = False) -> DataFrame:
    """Filter, project and subset a corpus: ``(row_id, input, output)``. The
    exact subset runs the plan below it once more to find its last key, so
    ``cut_lineage`` writes the rows before the subset."""
    return _prepared(recipe, corpus, cut_lineage)[0]


def _prepared(recipe: Recipe, corpus: DataFrame, cut_lineage: bool) -> tuple:
    """``prepared``, and the table that it reads if it was cut."""
    df = corpus.filter(F.col("split").isin(list(recipe.splits)))
    if recipe.type_filter:
        col, val = recipe.type_filter
        df = df.filter(F.col(col) == F.lit(val))
    base = recipe.prepare(df)
    if cut_lineage:
        base = _cut(base)
    cut = base if cut_lineage else None
    if recipe.fraction is not None:
        base = train_fraction(base, recipe.fraction, recipe.fraction_seed)
    if recipe.expand is not None:
        base = recipe.expand(base)
    return base.select("row_id", "input", "output"), cut


def generate(recipe: Recipe, corpus: DataFrame, catalogue: Mapping[str, List[str]], seed: int = 0,
             shuffle: Optional[str] = "hash", cut_lineage: bool = False) -> DataFrame:
    """All examples of one recipe.

    The prepared corpus has several readers (plain and masked pairs, the no-edit
    cap and its keys, the keys of an exact subset). Over a stored corpus that is a
    cheap scan; where the corpus is costly to derive, ``cut_lineage`` writes the
    filtered rows once as Parquet (a job that runs at once).
    Annotated-span recipes have one reader and are never cut. Finding the last
    key of a subset or a cap runs small jobs on narrow tables of keys; everything
    else is a lazy plan, but for texts put aside.

    ``shuffle``: ``"hash"`` (default) deals rows by a seeded key and orders
    each task's rows by it: a seeded random permutation with no range-sampling
    pass (which would run the whole upstream plan, difference UDF included, a
    second time). Each row's texts are put aside first (a job that runs at once),
    and examples get theirs when they are in order. ``"sort"`` is a total order
    by the key; ``None`` keeps generation order.
    """
    if shuffle == "hash" and recipe.intent is None and not corpus.isStreaming and can_put_aside(corpus.sparkSession):
        return _dealt(_generate_late(recipe, corpus, catalogue, seed, cut_lineage), seed)
    base = prepared(recipe, corpus, cut_lineage and recipe.intent is None and not corpus.isStreaming)
    stream = recipe.key
    if recipe.intent is not None:
        out = span_annotated_pairs(base, recipe.intent, catalogue[recipe.group], recipe.repeat, seed,
                                   stream=f"{stream}/span")
        return out.withColumns({"type": F.lit("mask"), "from": F.lit(recipe.tag)}).select(OUT_COLS)
    parts = [p.withColumn("from", F.lit(tag)) for p, tag in _edit_pairs(edit_pairs, recipe, base, catalogue, seed)]
    parts.append(_no_edit(recipe, base, catalogue, seed))
    out = parts[0].select(OUT_COLS)
    for p in parts[1:]:
        out = out.unionByName(p.select(OUT_COLS))
    return _shuffle(out, seed, shuffle)


def _edit_pairs(pairs: Callable, recipe: Recipe, base: DataFrame, catalogue: Mapping[str, List[str]], seed: int) -> list:
    """``pairs`` of each direction of a recipe, with its tag."""
    out = [(pairs(base, catalogue[recipe.group], recipe.repeat, recipe.mask_sample_size, recipe.diff, seed, f"{recipe.key}/fwd"), recipe.tag)]
    if recipe.reverse_group:
        out.append((pairs(reverse_pair(base), catalogue[recipe.reverse_group], recipe.repeat, recipe.mask_sample_size, recipe.diff, seed,
                          f"{recipe.key}/rev"), recipe.reverse_tag))
    return out


def _generate_late(recipe: Recipe, corpus: DataFrame, catalogue: Mapping[str, List[str]], seed: int, cut_lineage: bool = False) -> Late:
    """The examples of ``generate`` with their texts aside. The no-edit examples,
    which a cap holds down, are written finished, so that the cut table can go."""
    base, cut = _prepared(recipe, corpus, cut_lineage and recipe.intent is None)
    if recipe.intent is not None:
        return late_span_pairs(base, recipe.intent, catalogue[recipe.group], recipe.repeat, seed, f"{recipe.key}/span").tagged(recipe.tag)
    out = Late(written(_no_edit(recipe, base, catalogue, seed).select(OUT_COLS), "no-edit"))
    for late, tag in _edit_pairs(late_edit_pairs, recipe, base, catalogue, seed):
        out = out.union(late.tagged(tag))
    if cut is not None:
        removed(cut)
    return out


def _no_edit(recipe: Recipe, base: DataFrame, catalogue: Mapping[str, List[str]], seed: int) -> DataFrame:
    ne = no_edit_pairs(base, catalogue["do_not_edit"], recipe.cap, seed, stream=f"{recipe.key}/noedit")
    return ne.withColumns({"type": F.lit("no edit"), "from": F.lit(recipe.tag)})


def _shares_scan(a: Recipe, b: Recipe) -> bool:
    """Recipes that differ only in the value of their type filter and in what a column can carry."""
    same = ("splits", "prepare", "mask_sample_size", "diff", "reverse_group", "fraction", "expand")
    return all(getattr(a, n) == getattr(b, n) for n in same) and not (a.diff or a.reverse_group or a.fraction or a.expand) \
        and bool(a.type_filter) and bool(b.type_filter) and a.type_filter[0] == b.type_filter[0] and (a.intent is None) == (b.intent is None)


def generate_together(recipes: Sequence[Recipe], corpus: DataFrame, catalogue: Mapping[str, List[str]], seed: int = 0) -> DataFrame:
    """The examples of several recipes on one corpus from one scan of it.

    Each row gets an array of the recipes whose type filter it meets, which is
    exploded once; prompts, repeats, streams and tags follow the recipe's number.
    Same rows as ``generate`` with each recipe, in no particular order."""
    return _together(recipes, corpus, catalogue, seed, False)


def _together(recipes: Sequence[Recipe], corpus: DataFrame, catalogue: Mapping[str, List[str]], seed: int, late: bool):
    """``generate_together``; ``late``: its examples with their texts aside."""
    first = recipes[0]
    if not all(_shares_scan(first, r) for r in recipes):
        raise ValueError("these recipes cannot share a scan")
    meets = F.array(*[F.when(F.col(first.type_filter[0]) == F.lit(r.type_filter[1]), F.lit(i)) for i, r in enumerate(recipes)])
    df = corpus.filter(F.col("split").isin(list(first.splits))).withColumn(OF, F.explode(F.array_compact(meets)))
    base = first.prepare(df)

    def each(values: Sequence) -> Column:
        return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), F.col(OF) + 1)

    prompts = each([F.array(*[F.lit(p) for p in catalogue[r.group]]) for r in recipes])
    repeat, tag = each([r.repeat for r in recipes]), each([r.tag for r in recipes])
    if first.intent is not None:
        values = (base, each([r.intent for r in recipes]), prompts, repeat, seed, each([f"{r.key}/span" for r in recipes]))
        if late:
            return late_span_pairs(*values, keep=[OF]).tagged(tag)
        return span_annotated_pairs(*values, keep=[OF]).withColumns({"type": F.lit("mask"), "from": tag}).select(OUT_COLS)
    values = (base, prompts, repeat, first.mask_sample_size, False, seed, each([f"{r.key}/fwd" for r in recipes]))
    # Each recipe's no-edit examples have a cap of their own.
    parts = [_no_edit(r, base.filter(F.col(OF) == i), catalogue, seed).select(OUT_COLS) for i, r in enumerate(recipes)]
    if late:
        out = late_edit_pairs(*values, keep=[OF]).tagged(tag)
        for p in parts:
            out = out.union(Late(written(p, "no-edit")))
        return out
    out = edit_pairs(*values, keep=[OF]).withColumn("from", tag).select(OUT_COLS)
    for p in parts:
        out = out.unionByName(p)
    return out


def _dealt(late: Late, seed: int) -> DataFrame:
    """Late examples in the order of ``shuffle_for_write``, which then get their
    texts."""
    return finished(shuffle_for_write(late.rows, seed, "row_id", ("from", "variant"), tasks_for(late.bytes))).select(OUT_COLS)


def _shuffle(df: DataFrame, seed: int, how: Optional[str]) -> DataFrame:
    if how is None:
        return df
    if how == "sort":
        return shuffle_rows(df, seed, "row_id", ("from", "variant"))
    return shuffle_for_write(df, seed, "row_id", ("from", "variant"))


def mixture(frames: Sequence[DataFrame], seed: int = 0, shuffle: Optional[str] = "hash") -> DataFrame:
    """All recipes' examples as one shuffled table (bag union)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return _shuffle(out, seed, shuffle)


def generate_mixture(recipes: Sequence[Recipe], corpora: Mapping[str, DataFrame], catalogue: Mapping[str, List[str]], seed: int = 0,
                     shuffle: Optional[str] = "hash") -> DataFrame:
    """All recipes' examples, merged and shuffled. ``corpora`` gives each
    recipe's corpus by key; recipes with one and the same DataFrame whose
    settings allow it are generated together. The corpora are read by each
    group of recipes, so they should be stored."""
    groups: List[List[Recipe]] = []
    for r in recipes:
        for g in groups:
            if corpora[g[0].key] is corpora[r.key] and _shares_scan(g[0], r):
                g.append(r)
                break
        else:
            groups.append([r])
    if shuffle == "hash" and all(can_put_aside(corpora[r.key].sparkSession) for r in recipes):
        lates = [_generate_late(g[0], corpora[g[0].key], catalogue, seed) if len(g) == 1
                 else _together(g, corpora[g[0].key], catalogue, seed, True) for g in groups]
        out = lates[0]
        for late in lates[1:]:
            out = out.union(late)
        return _dealt(out, seed)
    return mixture([generate(g[0], corpora[g[0].key], catalogue, seed, shuffle=None) if len(g) == 1
                    else generate_together(g, corpora[g[0].key], catalogue, seed) for g in groups], seed, shuffle)


def build(config: Sequence, read, catalogue: Mapping[str, List[str]], out_dir: str, seed: int = 0) -> List[str]:
    """Generate and write every enabled recipe of a configuration (as returned
    by ``load_recipe_config``) to ``out_dir/<key>``, one folder a recipe, so
    that recipes on one source never collide. ``read(name, splits)`` gives a
    corpus by the configuration's ``name``. Returns the written paths."""
    from revisio.sources.sinks import write_corpus
    paths = []
    for key, opts in config:
        recipe = RECIPES[key].with_options(**opts)
        path = f"{out_dir.rstrip('/')}/{key}"
        corpus = read(opts.get("name", key), list(recipe.splits))
        if can_put_aside(corpus.sparkSession):
            late = _generate_late(recipe, corpus, catalogue, seed)
            write_corpus(_dealt(late, seed), path)
            late.drop()
        else:
            write_corpus(generate(recipe, corpus, catalogue, seed, shuffle=None), path, seed=seed)
        paths.append(path)
    return paths


def build_all(spark: SparkSession, config_path: str, corpus_root: str, out_dir: str,
              catalogue: Optional[Mapping[str, List[str]]] = None, seed: int = 0) -> DataFrame:
    """From a configuration file to one table of all recipes' examples.

    Corpora are Parquet folders ``corpus_root/<name>`` with ``split=...``
    partitions; only the splits a recipe uses are read."""
    from revisio.sources.config import load_recipe_config
    from revisio.sources.corpus import read_corpus
    from revisio.sources.prompts import load_prompts
    paths = build(load_recipe_config(config_path), lambda name, splits: read_corpus(spark, f"{corpus_root.rstrip('/')}/{name}", splits=splits),
                  catalogue or load_prompts(), out_dir, seed)
    frames = [spark.read.parquet(p).select(OUT_COLS) for p in paths]  # one partitioned root per recipe
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
