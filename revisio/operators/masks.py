"""Span masks over the output's words and their sentinel encoding.

A mask is an ``ARRAY<BOOLEAN>`` aligned with the word array, kept out of band
(a literal ``[MASK]`` word in the text stays an ordinary word). A mask
*variant* is ``STRUCT<variant STRING, spans ARRAY<STRUCT<st INT, ln INT>>,
mask ARRAY<BOOLEAN>>``: random and single-run variants carry spans, the full
difference mask carries the mask itself.

Work is staged so that every per-word lambda reads only materialised
columns: variant specs are built per row and exploded (the explode is an
optimisation barrier), the mask is a column, run bounds are columns, then the
text is rendered. Each stage is linear in the word count.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisio.functions.rng import randint
from revisio.functions.text import materialize

SPAN = "array<struct<st:int,ln:int>>"
RUN = "array<struct<st:int,en:int>>"
VARIANT = f"struct<variant:string,runs:{RUN}>"


def positions(n: Column) -> Column:
    """0..n-1, and an empty array when n is 0 (``sequence(0,-1)`` counts down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _sentinel(k: Column) -> Column:
    return F.concat(F.lit("<extra_id_"), k.cast("string"), F.lit(">"))


def _variant(name: Column, runs: Column) -> Column:
    return F.struct(name.alias("variant"), runs.alias("runs"))


def empty_variants() -> Column:
    return F.array().cast(f"array<{VARIANT}>")


def random_span_variants(n: Column, variants: int, seed: int, stream: str, row_id: Column) -> Column:
    """``variants`` random span sets (none when the text is empty).

    Each has ``randint(1, max(2, min(n//10, 20)))`` spans; a span has length
    ``randint(1, min(10, n))`` and start ``randint(0, n - length)``; spans may
    overlap or touch. ``n`` must be cheap (the size of a materialised array).
    """
    if variants <= 0:
        return empty_variants()

    def one(v):
        k = randint(1, F.greatest(F.least((n / 10).cast("int"), F.lit(20)), F.lit(2)),
                    seed, stream, row_id, "rk", v)

        def span(s):
            ln = randint(1, F.least(F.lit(10), n), seed, stream, row_id, "rl", v, s)
            st = randint(0, n - ln, seed, stream, row_id, "rs", v, s)
            return F.struct(st.alias("st"), ln.alias("ln"))

        return _variant(F.concat(F.lit("r"), v.cast("string")),
                        spans_to_runs(F.transform(F.sequence(F.lit(1), k), span)))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(variants - 1)), one)).otherwise(empty_variants())


def single_run_variants(full: Column, n: Column, seed: int, stream: str, row_id: Column) -> Column:
    """Up to two variants, each the contiguous run of ``full`` around a masked
    word picked uniformly (with repetition); one if exactly one word is
    masked, none if none. ``full`` must be a materialised column."""
    masked = F.filter(positions(n), lambda i: full[i])
    m = F.size(masked)

    def one(j):
        c = F.element_at(masked, randint(0, m - 1, seed, stream, row_id, "dc", j) + 1)
        lo = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), c), lambda i: ~full[i])) + 1, F.lit(0))
        hi = F.coalesce(F.array_min(F.filter(F.sequence(c, n - 1), lambda i: ~full[i])), n)
        return _variant(F.concat(F.lit("d"), (j + 1).cast("string")),
                        F.array(F.struct(lo.alias("st"), hi.alias("en"))))

    picks = F.when(m > 0, F.sequence(F.lit(0), F.least(m, F.lit(2)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(picks, one)


def full_diff_variant(full_runs: Column) -> Column:
    """The full difference mask as one variant; ``full_runs`` are its
    materialised runs (``with_mask_runs``)."""
    return F.array(_variant(F.lit("d0"), full_runs))


def variant_mask(variant: Column, n: Column) -> Column:
    """The boolean mask of one exploded variant (display, protection)."""
    return runs_mask(variant["runs"], n)


def spans_to_runs(spans: Column) -> Column:
    """Merge possibly overlapping or touching spans into sorted maximal runs
    ``[st, en)``. A fold over at most 20 spans: no per-word work."""
    ivals = F.array_sort(F.transform(spans, lambda sp: F.struct(sp["st"].alias("st"),
                                                                (sp["st"] + sp["ln"]).alias("en"))))

    def step(acc, x):
        last = F.get(acc, F.size(acc) - 1)
        merged = F.struct(last["st"].alias("st"), F.greatest(last["en"], x["en"]).alias("en"))
        return F.when(last.isNotNull() & (x["st"] <= last["en"]),
                      F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged))) \
            .otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(ivals, F.array().cast(RUN), step)


def with_mask_runs(df: DataFrame, mask: str, out: str) -> DataFrame:
    """Maximal runs of a materialised boolean mask (two linear scans)."""
    mk = F.col(mask)

    def at(i):
        return F.coalesce(F.get(mk, i), F.lit(False))

    m = F.size(mk)
    staged = materialize(df, {
        "_st": F.filter(positions(m), lambda i: at(i) & ~at(i - 1)),
        "_en": F.filter(positions(m), lambda i: at(i) & ~at(i + 1)),
    })
    en = F.col("_en")
    runs = F.transform("_st", lambda s, k: F.struct(s.alias("st"), (en[k] + 1).alias("en")))
    return materialize(staged, {out: runs}).drop("_st", "_en")


def runs_mask(runs: Column, n: Column) -> Column:
    """Boolean mask of runs (for display and for protected positions)."""
    return F.transform(positions(n), lambda i: F.exists(runs, lambda r: (i >= r["st"]) & (i < r["en"])))


def render_runs(df: DataFrame, words: str, runs: str, masked: str = "masked", target: str = "target") -> DataFrame:
    """Sentinel encoding from materialised runs: native slices only.

    Each run becomes one ``<extra_id_k>`` and its other words empty strings
    (so joining with single spaces keeps the extra spaces); the target is
    ``<extra_id_0> run0 <extra_id_1> ... <extra_id_n>``, or empty when there
    is no run.
    """
    w, rs = F.col(words), F.col(runs)
    n = F.size(w)

    def piece(r, k):
        prev = F.coalesce(F.get(rs, k - 1)["en"], F.lit(0))
        return F.concat(F.slice(w, prev + 1, r["st"] - prev), F.array(_sentinel(k)),
                        F.array_repeat(F.lit(""), r["en"] - r["st"] - 1))

    last = F.coalesce(F.get(rs, F.size(rs) - 1)["en"], F.lit(0))
    tail = F.when(last < n, F.slice(w, last + 1, n - last)).otherwise(F.array().cast("array<string>"))
    masked_text = F.array_join(F.concat(F.flatten(F.transform(rs, piece)), tail), " ")

    def run(r, k):
        return F.concat(F.lit(" "), F.array_join(F.slice(w, r["st"] + 1, r["en"] - r["st"]), " "), F.lit(" "),
                        _sentinel(k + 1))

    target_text = F.when(F.size(rs) == 0, F.lit("")).otherwise(
        F.concat(F.lit("<extra_id_0>"), F.array_join(F.transform(rs, run), "")))
    return df.withColumns({masked: masked_text, target: target_text})


def protect_positions(mask: Column, protect: Column) -> Column:
    """Unmask listed word positions; indices outside the text are ignored."""
    return F.transform(mask, lambda m, i: m & ~F.coalesce(F.array_contains(protect, i), F.lit(False)))


def with_encoding(df: DataFrame, words: str, mask: str, masked: str = "masked", target: str = "target") -> DataFrame:
    """Sentinel encoding of a boolean ``mask`` over ``words`` (see ``render_runs``)."""
    return render_runs(with_mask_runs(df, mask, "_runs"), words, "_runs", masked, target).drop("_runs")


def encode_sentinels(df: DataFrame, words: str, mask: str) -> DataFrame:
    """Select only the encoding: ``(masked, target)`` plus the input columns."""
    return with_encoding(df, words, mask)
