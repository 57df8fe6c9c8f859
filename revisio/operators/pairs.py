"""Pair generation: prompted plain pairs, masked pairs, no-edit
pairs, annotated-span pairs, alternatives.

Each generator turns one source row into an array of example structs and
explodes it once (no self-union, no extra scan). Output rows carry
``row_id`` and ``variant`` so every example has a stable identity.
"""
from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Callable, Optional, Sequence, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisio.functions.rng import h, randint
from revisio.operators.order import hash_top_k
from revisio.functions.text import materialize, words
from revisio.operators.diff import full_diff_mask
from revisio.operators.masks import (RUN, VARIANT, full_diff_variant, protect_positions, random_span_variants,
                                     render_runs, single_run_variants, variant_mask, with_mask_runs)
from revisio.operators.store import PLACE, dropped, fetched, put_aside

# Prompts, repeats, streams and intents are values, or columns where recipes that
# share a scan differ from row to row.
Prompts = Union[Sequence[str], Column]


def prompt_array(prompts: Prompts) -> Column:
    if isinstance(prompts, Column):
        return prompts
    if not prompts:
        raise ValueError("empty prompt list")
    return F.array(*[F.lit(p) for p in prompts])


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def sample_prompts(prompts: Prompts, times: Union[int, Column], seed: int, stream: Union[str, Column], row_id: Column) -> Column:
    """``random.sample(prompts, times)`` per row: distinct positions, ``times``
    clamped to the list size. Positions are ranked by a per-row hash."""
    keyed = F.transform(prompt_array(prompts),
                        lambda p, i: F.struct(h(seed, stream, row_id, "sp", i).alias("k"), i.alias("i"), p.alias("p")))
    return F.transform(F.slice(F.array_sort(keyed), F.lit(1), _col(times)), lambda s: s["p"])


def pick_prompt(prompts: Prompts, seed: int, stream: Union[str, Column], row_id: Column, purpose: str, *parts) -> Column:
    """One prompt drawn uniformly (with replacement across calls)."""
    among = prompt_array(prompts)
    idx = randint(1, F.size(among) if isinstance(prompts, Column) else len(prompts), seed, stream, row_id, purpose, *parts)
    return F.element_at(among, idx)


def simple_pairs(df: DataFrame, prompts: Sequence[str], times: int = 1, seed: int = 0, stream: str = "fwd",
                 row_id: str = "row_id", inp: str = "input", out: str = "output") -> DataFrame:
    """``"{prompt}: {input} ->"`` / ``output`` for ``times`` distinct prompts per row."""
    base = df.select(F.col(row_id).alias("row_id"), F.col(inp).alias("_in"), F.col(out).alias("_out"))
    ex = base.select("*", F.posexplode(sample_prompts(prompts, times, seed, stream, F.col("row_id")))
                     .alias("_j", "_p"))
    return ex.select(
        "row_id",
        F.concat(F.lit("s"), F.col("_j").cast("string")).alias("variant"),
        F.concat(F.col("_p"), F.lit(": "), F.col("_in"), F.lit(" ->")).alias("input"),
        F.col("_out").alias("output"),
    )


def mask_variants(n: Column, full: Optional[Column], mask_sample_size: int, diff: bool,
                  seed: int, stream: str, row_id: Column, full_runs: Optional[Column] = None) -> Column:
    """All mask variants of one row: the full difference mask and up to two
    single runs (``diff``), then ``mask_sample_size`` random span sets.
    ``n`` and ``full`` must be cheap: sizes / materialised columns (a Python
    UDF result cannot be used inside a higher-order function anyway)."""
    parts = []
    if diff:
        parts.append(full_diff_variant(full_runs))
        parts.append(single_run_variants(full, n, seed, stream, row_id))
    parts.append(random_span_variants(n, mask_sample_size, seed, stream, row_id))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _with_diff(base: DataFrame) -> DataFrame:
    """Difference mask (Arrow UDF, once per row) and its runs."""
    base = base.withColumn("_full", full_diff_mask(F.col("_w"), words(F.col("_in"))))
    return with_mask_runs(base, "_full", "_fruns")


def _render(ex: DataFrame, runs: Column, protect: bool) -> DataFrame:
    """Exploded variants -> ``masked`` / ``target`` from their runs; with
    protected positions the runs are recomputed from the adjusted mask."""
    if protect:
        mask = protect_positions(F.transform(F.sequence(F.lit(0), F.size("_w") - 1),
                                             lambda i: F.exists(runs, lambda r: (i >= r["st"]) & (i < r["en"]))),
                                 F.col("_protect"))
        ex = with_mask_runs(materialize(ex, {"_pm": F.when(F.size("_w") > 0, mask)
                                             .otherwise(F.array().cast("array<boolean>"))}), "_pm", "_runs")
        return render_runs(ex, "_w", "_runs").drop("_pm", "_runs")
    return render_runs(materialize(ex, {"_runs": runs}), "_w", "_runs").drop("_runs")


def masked_pairs(df: DataFrame, prompts: Sequence[str], mask_sample_size: int = 4, diff: bool = False,
                 seed: int = 0, stream: str = "fwd", row_id: str = "row_id", inp: str = "input",
                 out: str = "output", protect: Optional[str] = None) -> DataFrame:
    """``"{prompt}: {input} -> {masked output}"`` / sentinel target, one
    independent prompt draw per mask variant.

    Rows per source row: ``mask_sample_size*[n>0] + (diff ? 1 + min(2, masked) : 0)``.
    """
    rid = F.col(row_id)
    base = df.select(rid.alias("row_id"), F.col(inp).alias("_in"), words(out).alias("_w"),
                     *([F.col(protect).alias("_protect")] if protect else []))
    if diff:
        base = _with_diff(base)
    variants = mask_variants(F.size("_w"), F.col("_full") if diff else None, mask_sample_size, diff,
                             seed, stream, F.col("row_id"), F.col("_fruns") if diff else None)
    ex = base.select("row_id", "_in", "_w", *(["_protect"] if protect else []), F.explode(variants).alias("_v"))
    enc = _render(ex, F.col("_v.runs"), bool(protect)).withColumn("variant", F.col("_v.variant"))
    prompt = pick_prompt(prompts, seed, stream, F.col("row_id"), "mp", F.col("variant"))
    return enc.select(
        "row_id",
        F.concat(F.lit("m"), F.col("variant")).alias("variant"),
        F.concat(prompt, F.lit(": "), F.col("_in"), F.lit(" -> "), F.col("masked")).alias("input"),
        F.col("target").alias("output"),
    )


def no_edit_pairs(df: DataFrame, prompts: Sequence[str], cap: int = 5000, seed: int = 0,
                  col: str = "input", row_id: str = "row_id", mask_sample_size: int = 2,
                  stream: str = "noedit") -> DataFrame:
    """"Leave it alone" examples from ``col``: one plain pair (text is its own
    output) plus ``mask_sample_size`` random-mask pairs per row, shuffled and
    capped at ``cap`` rows.

    The cap is exact and distributed (``hash_top_k``: the last key is found on a
    narrow table of keys, and rows are compared with it where they stand), and
    only the surviving rows build text.
    """
    rid = F.col(row_id)
    n = F.size(words(col))
    kinds = F.concat(F.array(F.lit("s0")),
                     F.when(n > 0, F.array(*[F.lit(f"r{v}") for v in range(mask_sample_size)]))
                     .otherwise(F.array().cast("array<string>")))
    keys = df.select(rid.alias("row_id"), F.col(col).alias("_t"), F.explode(kinds).alias("_k"))
    keys = keys.withColumn("_sk", h(seed, stream, F.col("row_id"), "nx", F.col("_k")))
    top = hash_top_k(keys, "_sk", ("row_id", "_k"), cap)
    # Late materialisation: everything below runs on at most ``cap`` rows.
    top = materialize(top, {"_w": words("_t")})
    specs = random_span_variants(F.size("_w"), mask_sample_size, seed, stream, F.col("row_id"))
    mask_idx = F.substring(F.col("_k"), 2, 10).cast("int")
    is_simple = F.col("_k") == "s0"
    runs = F.when(is_simple, F.array().cast(RUN)).otherwise(F.element_at(specs, mask_idx + 1)["runs"])
    enc = render_runs(materialize(top, {"_runs": runs}), "_w", "_runs")
    simple_prompt = sample_prompts(prompts, 1, seed, stream, F.col("row_id"))[0]
    prompt_m = pick_prompt(prompts, seed, stream, F.col("row_id"), "mp", F.col("_k"))
    return enc.select(
        "row_id",
        F.concat(F.lit("n"), F.col("_k")).alias("variant"),
        F.when(is_simple, F.concat(simple_prompt, F.lit(": "), F.col("_t"), F.lit(" ->")))
        .otherwise(F.concat(prompt_m, F.lit(": "), F.col("_t"), F.lit(" -> "), F.col("masked"))).alias("input"),
        F.when(is_simple, F.col("_t")).otherwise(F.col("target")).alias("output"),
    )


def span_annotated_pairs(df: DataFrame, intent: Union[str, Column], prompts: Prompts, repeat: Union[int, Column] = 1, seed: int = 0,
                         stream: Union[str, Column] = "span", row_id: str = "row_id", inp: str = "input",
                         out: str = "output", keep: Sequence[str] = ()) -> DataFrame:
    """Annotated-span examples: strip ``<intent>``; the span becomes
    ``<extra_id_0>`` in the masked text; the target is the whole after-text
    between sentinels; ``repeat`` rows, prompts drawn with replacement.
    Rows without the intent tag are dropped. ``keep`` passes columns through."""
    ex = _spans(df, intent, repeat, row_id, inp, out, keep).withColumn("_r", _each_repeat())
    return ex.select(
        "row_id", _span_variant(),
        F.concat(_span_prompt(prompts, seed, stream), F.lit(": "), F.col("_in"), F.lit(" -> "), F.col("_mid")).alias("input"),
        F.col("_out").alias("output"), *keep,
    )


def _spans(df: DataFrame, intent: Union[str, Column], repeat: Union[int, Column], row_id: str, inp: str, out: str, keep: Sequence[str]) -> DataFrame:
    """The texts of each row's annotated-span examples, and how often it ``_again`` gives one."""
    tag = F.concat(F.lit("<"), _col(intent), F.lit(">"))
    rid, again = F.col(row_id), _col(repeat)
    src = df.filter(F.coalesce(F.startswith(F.col(inp), tag), F.lit(False)) & (again > 0))
    before = F.substr(F.col(inp), F.length(tag) + 1)
    masked = F.replace(F.replace(F.regexp_replace(before, F.lit(r"(?d)<S>(.*?)</S>"), F.lit("<extra_id_0>")),
                                 F.lit("<S>"), F.lit("")), F.lit("</S>"), F.lit(""))
    plain = F.replace(F.replace(before, F.lit("<S>"), F.lit("")), F.lit("</S>"), F.lit(""))
    return src.select(rid.alias("row_id"), plain.alias("_in"), masked.alias("_mid"),
                      F.concat(F.lit("<extra_id_0> "), F.col(out), F.lit(" <extra_id_1>")).alias("_out"), *keep, again.alias("_again"))


def _each_repeat() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("_again") - 1))


def _span_variant() -> Column:
    return F.concat(F.lit("g"), F.col("_r").cast("string")).alias("variant")


def _span_prompt(prompts: Prompts, seed: int, stream: Union[str, Column]) -> Column:
    return pick_prompt(prompts, seed, stream, F.col("row_id"), "gp", F.col("_r"))


def alternatives_unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], row_id: str = "row_id",
                         value: str = "output") -> DataFrame:
    """One row per non-null alternative column, in one scan; ``row_id``
    becomes ``row_id:column``."""
    long = df.unpivot(list(ids), list(cols), "_alt", value).filter(F.col(value).isNotNull())
    return long.withColumn(row_id, F.concat(F.col(row_id), F.lit(":"), F.col("_alt"))).drop("_alt")


def _described(df: DataFrame, prompts: Prompts, repeat: Union[int, Column], mask_sample_size: int, diff: bool, seed: int,
               stream: Union[str, Column], row_id: str, inp: str, out: str, protect: Optional[str], keep: Sequence[str]) -> DataFrame:
    """Each row's texts, words and ``_x``, an array of its examples' descriptors:
    ``repeat`` plain ones, then every mask variant."""
    rid = F.col(row_id)
    base = df.select(rid.alias("row_id"), F.col(inp).alias("_in"), F.col(out).alias("_out"),
                     words(out).alias("_w"), *([F.col(protect).alias("_protect")] if protect else []), *keep)
    if diff:
        base = _with_diff(base)
    r = F.col("row_id")
    plain = F.transform(sample_prompts(prompts, repeat, seed, stream, r),
                        lambda p, j: F.struct(F.concat(F.lit("s"), j.cast("string")).alias("variant"),
                                              p.alias("prompt"), F.lit(None).cast(VARIANT).alias("spec")))
    masks = mask_variants(F.size("_w"), F.col("_full") if diff else None, mask_sample_size, diff, seed, stream, r,
                          F.col("_fruns") if diff else None)
    masked = F.transform(masks, lambda v: F.struct(F.concat(F.lit("m"), v["variant"]).alias("variant"),
                                                   F.lit(None).cast("string").alias("prompt"),
                                                   v.alias("spec")))
    return base.select("row_id", "_in", "_out", "_w", *(["_protect"] if protect else []), *keep, F.concat(plain, masked).alias("_x"))


def _drawn(prompts: Prompts, seed: int, stream: Union[str, Column]) -> Column:
    """The prompt of an exploded descriptor ``_x``."""
    mprompt = pick_prompt(prompts, seed, stream, F.col("row_id"), "mp", F.substring(F.col("_x.variant"), 2, 10))
    return F.when(F.col("_x.spec").isNull(), F.col("_x.prompt")).otherwise(mprompt)


def _example(plain: Column, prompt: Column) -> list:
    """``input`` and ``output`` of a plain or a masked example, from its texts and their encoding."""
    return [F.when(plain, F.concat(prompt, F.lit(": "), F.col("_in"), F.lit(" ->")))
            .otherwise(F.concat(prompt, F.lit(": "), F.col("_in"), F.lit(" -> "), F.col("masked"))).alias("input"),
            F.when(plain, F.col("_out")).otherwise(F.col("target")).alias("output")]


def _kind(plain: Column) -> Column:
    return F.when(plain, F.lit("simple")).otherwise(F.lit("mask"))


def edit_pairs(df: DataFrame, prompts: Prompts, repeat: Union[int, Column] = 1, mask_sample_size: int = 4,
               diff: bool = False, seed: int = 0, stream: Union[str, Column] = "fwd", row_id: str = "row_id",
               inp: str = "input", out: str = "output", protect: Optional[str] = None, keep: Sequence[str] = ()) -> DataFrame:
    """Plain and masked pairs of one corpus in a single pass.

    One array of example descriptors per source row (``repeat`` plain ones,
    then every mask variant) is exploded once, so the source is scanned once
    and the difference UDF runs once per row. Same rows and values as
    ``simple_pairs`` followed by ``masked_pairs``; adds ``type``. ``keep``
    passes columns through.
    """
    base = _described(df, prompts, repeat, mask_sample_size, diff, seed, stream, row_id, inp, out, protect, keep)
    ex = base.withColumn("_x", F.explode("_x"))
    is_plain = F.col("_x.spec").isNull()
    runs = F.when(is_plain, F.array().cast(RUN)).otherwise(F.col("_x.spec.runs"))
    enc = _render(ex, runs, bool(protect))
    return enc.select("row_id", F.col("_x.variant").alias("variant"), *_example(is_plain, _drawn(prompts, seed, stream)),
                      _kind(is_plain).alias("type"), *keep)


#: The texts of a late example; ``_mid`` is the masked text where it is known before.
TEXTS = ["_in", "_mid", "_out"]


@dataclass(frozen=True)
class Late:
    """Examples whose texts lie aside: ``rows`` have the columns of a finished
    example, with null texts, and what ``finished`` needs to build them; rows
    that are finished already have no place. ``bytes`` of text they will have,
    about; ``aside`` are the tables with their texts."""
    rows: DataFrame
    bytes: int = 0
    aside: tuple = ()

    def tagged(self, tag: Union[str, Column]) -> Late:
        return replace(self, rows=self.rows.withColumn("from", _col(tag)))

    def union(self, other: Late) -> Late:
        return Late(self.rows.unionByName(other.rows, allowMissingColumns=True), self.bytes + other.bytes, (*self.aside, *other.aside))

    def drop(self) -> None:
        """Delete the texts, which nothing reads any more."""
        for table in self.aside:
            dropped(table)


def _late(aside: DataFrame, copies: Column, one: Callable, variant: Column, kind: Column, prompt: Column, runs: Column, keep: Sequence[str]) -> Late:
    """A row of ``aside`` as ``copies`` examples; ``one`` explodes them."""
    text = F.lit(None).cast("string")
    weight = aside.agg(F.sum(F.col("_bytes") * copies)).first()[0]
    rows = one(aside).select("row_id", variant.alias("variant"), text.alias("input"), text.alias("output"), kind.alias("type"), *keep,
                             *PLACE, prompt.alias("_prompt"), runs.cast(RUN).alias("_runs"))
    return Late(rows, int(weight or 0), (aside,))


def late_edit_pairs(df: DataFrame, prompts: Prompts, repeat: Union[int, Column] = 1, mask_sample_size: int = 4,
                    diff: bool = False, seed: int = 0, stream: Union[str, Column] = "fwd", row_id: str = "row_id",
                    inp: str = "input", out: str = "output", keep: Sequence[str] = ()) -> Late:
    """The examples of ``edit_pairs``, which ``finished`` gives their texts: the
    texts of each row are written once, whatever the number of its examples."""
    base = _described(df, prompts, repeat, mask_sample_size, diff, seed, stream, row_id, inp, out, None, keep)
    base = base.drop("_w").withColumn("_mid", F.lit(None).cast("string"))
    return _late(put_aside(base, TEXTS, "descriptors"), F.size("_x"), lambda rows: rows.withColumn("_x", F.explode("_x")), F.col("_x.variant"),
                 _kind(F.col("_x.spec").isNull()), _drawn(prompts, seed, stream), F.col("_x.spec.runs"), keep)


def late_span_pairs(df: DataFrame, intent: Union[str, Column], prompts: Prompts, repeat: Union[int, Column] = 1, seed: int = 0,
                    stream: Union[str, Column] = "span", row_id: str = "row_id", inp: str = "input",
                    out: str = "output", keep: Sequence[str] = ()) -> Late:
    """The same for ``span_annotated_pairs``; adds ``type``."""
    aside = put_aside(_spans(df, intent, repeat, row_id, inp, out, keep), TEXTS, "descriptors")
    return _late(aside, F.col("_again"), lambda rows: rows.withColumn("_r", _each_repeat()), _span_variant(), F.lit("mask"),
                 _span_prompt(prompts, seed, stream), F.lit(None), keep)


def finished(rows: DataFrame) -> DataFrame:
    """The rows of a ``Late`` with their texts, in their order. Texts are taken
    and rendered where the rows stand."""
    late, plain, span = F.col("_file").isNotNull(), F.col("type") == "simple", F.col("_mid").isNotNull()
    w = F.when(plain | span, F.array().cast("array<string>")).otherwise(words("_out"))
    runs = F.when(plain | span, F.array().cast(RUN)).otherwise(F.col("_runs"))
    enc = render_runs(materialize(fetched(rows, TEXTS), {"_w": w, "_runs_of": runs}), "_w", "_runs_of")
    enc = enc.withColumns({"masked": F.when(span, F.col("_mid")).otherwise(F.col("masked")), "target": F.when(span, F.col("_out")).otherwise(F.col("target"))})
    made = zip(("input", "output"), _example(plain, F.col("_prompt")))
    return enc.select(*[c for c in rows.columns if c not in (*PLACE, "_prompt", "_runs", "input", "output")],
                      *[F.when(late, c).otherwise(F.col(n)).alias(n) for n, c in made])
