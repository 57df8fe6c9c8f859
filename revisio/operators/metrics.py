"""Scoring: cleaning, sentence split, corpus BLEU, ROUGE-N,
ROUGE-L, ROUGE-Lsum, mean generated length, example counts, one report.

N-gram matches are counted inside the row (an Arrow kernel that holds the tokens
of one row at a time), so only the sums are shuffled and the driver receives one
row.
Definitions: BLEU uses the public 13a tokenizer, exponential smoothing of zero
precisions, and is 0 without any match; ROUGE lower-cases, keeps ``[a-z0-9]``
runs without stemming, and averages per-row F1 (no bootstrap). Rounding is half
to even.
"""
from __future__ import annotations

import math
import re
import sys
from collections import Counter
from itertools import chain
from typing import Iterator, Mapping, Optional, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revisio.functions.rng import draw_key, h, u32  # noqa: F401
from revisio.functions.text import WS_CLASS, materialize, strip, words
from revisio.operators.stem import stemmed, stems

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The 13a rules (pattern, replacement), applied in order to the
# text between two spaces; the result is split at white space.
RULES_13A = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),  # punctuation but . , - and '
    (r"([^0-9])([\.,])", "$1 $2 "),  # period and comma unless after a digit
    (r"([\.,])([^0-9])", " $1 $2"),  # period and comma unless before a digit
    (r"([0-9])(-)", "$1 $2 "),  # dash after a digit
)
# Texts that 13a replaces first.
PLAIN_13A = (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
SENT_END = r"([.!?])" + WS_CLASS + "+"
LOG_ZERO = -9999999999.0


def clean_text(c) -> Column:
    return strip(c)


def split_sentences(c) -> Column:
    """Newline after sentence-final punctuation (a rule in place of a trained
    sentence model)."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, SENT_END, "$1\n")


def _plain_13a(c) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    for old, new in PLAIN_13A:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def bleu_tokens(c) -> Column:
    x = F.concat(F.lit(" "), _plain_13a(c), F.lit(" "))
    for pattern, new in RULES_13A:
        x = F.regexp_replace(x, pattern, new)
    return words(x)


def rouge_tokens(c, stem: bool = False) -> Column:
    tokens = words(F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), "[^a-z0-9]+", " "))
    return stems(tokens) if stem else tokens


#: Words whose tokens are remembered by a Python worker.
MEMO = 1 << 16
_13A: dict = {}
_PY_13A = [(re.compile(p), new.replace("$1", r"\1").replace("$2", r"\2")) for p, new in RULES_13A]
_ROUGE_WORD = re.compile("[a-z0-9]+")


def _word_13a(word: str) -> list:
    """The 13a tokens of one word. No rule looks past the white space beside a
    word, so the rules hold word by word; letters and digits alone stay whole."""
    if word.isalnum():
        return [word]
    found = _13A.get(word)
    if found is None:
        text = f" {word} "
        for pattern, new in _PY_13A:
            text = pattern.sub(new, text)
        found = text.split()
        if len(_13A) < MEMO and len(word) < 64:
            _13A[word] = found
    return found


def _13a_words(text: str) -> list:
    return [t for w in text.split() for t in _word_13a(w)]


def _rouge_words(text: str) -> list:
    return _ROUGE_WORD.findall(text)


def _rouge_stems(text: str) -> list:
    return stemmed(_ROUGE_WORD.findall(text))


def _overlaps(a: list, b: list, orders: Sequence[int]) -> list:
    """For each order (ascending): clipped matches and both sides' n-grams. Words
    are numbered, and an n-gram is one number made of its words' numbers."""
    number: dict = {}
    ids = np.fromiter((number.setdefault(t, len(number)) for t in chain(a, b)), np.int64, len(a) + len(b))
    sides, words_of, top, out = [ids[:len(a)], ids[len(a):]], (ids[:len(a)], ids[len(a):]), len(number), []
    for n in range(1, max(orders) + 1):
        if n > 1:
            if top * len(number) >= 1 << 62:  # numbered anew before they outgrow 64 bits
                _, places = np.unique(np.concatenate(sides), return_inverse=True)
                sides, top = [places[:len(sides[0])], places[len(sides[0]):]], len(places)
            sides = [g[:-1] * len(number) + w[n - 1:] if len(g) else g for g, w in zip(sides, words_of)]
            top *= len(number)
        if n in orders:
            found, places = np.unique(np.concatenate(sides), return_inverse=True)
            h, r = (np.bincount(p, minlength=len(found)) for p in (places[:len(sides[0])], places[len(sides[0]):]))
            out += [int(np.minimum(h, r).sum()), len(sides[0]), len(sides[1])]
    return out


def _each(column: pa.Array, cut) -> Iterator[list]:
    """The tokens of each row of a column of texts (``cut``) or of token arrays, a row at a time; null is empty."""
    if cut is not None:
        for x in column:
            text = x.as_py()
            yield [] if text is None else cut(text)
        return
    for x in column:
        yield x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []


def _overlap_kernel(orders: Sequence[int], cut=None):
    """Arrow kernel over two columns: ``_overlaps`` of each row."""
    def counts(h: pa.Array, r: pa.Array) -> pa.Array:
        return pa.array([_overlaps(a, b, orders) for a, b in zip(_each(h, cut), _each(r, cut))], pa.list_(pa.int64()))

    return F.arrow_udf(counts, T.ArrayType(T.LongType()))


def _counts(orders: Sequence[int], at: str = "_c") -> list:
    """``m{n}, h{n}, r{n}`` from the array ``at`` of an overlap kernel."""
    return [F.col(at)[i].alias(c) for i, c in enumerate(f"{s}{n}" for n in orders for s in ("m", "h", "r"))]


def _counted(df: DataFrame, hyp: Column, ref: Column, orders: Sequence[int], keep: Sequence[str] = (), cut=None) -> DataFrame:
    """``m{n}, h{n}, r{n}`` for each row: clipped matches and both sides'
    n-grams. ``hyp`` and ``ref`` are token arrays, or texts that ``cut`` cuts
    into tokens. No shuffle."""
    return df.select(*keep, _overlap_kernel(list(orders), cut)(hyp, ref).alias("_c")).select(*keep, *_counts(orders))


def _levels(rows: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    """Aggregates over all rows; with ``by``, one row for each value of each of
    these columns and one for all rows, from one pass (grouping sets). ``level``
    names the column that a row stands for (``all``); the others are null."""
    if not by:
        return rows.agg(*aggs)
    level = F.lit("all")
    for c in by:
        level = F.when(F.grouping(c) == 0, F.lit(c)).otherwise(level)
    return rows.groupingSets([[F.col(c)] for c in by] + [[]], *by).agg(level.alias("level"), *aggs)


def _named(by: Sequence[str]) -> list:
    return ["level", *by] if by else []


def corpus_bleu(df: DataFrame, pred: str, ref: str, by: Sequence[str] = ()) -> DataFrame:
    """One row: ``bleu`` (0-100, 4 places), clipped matches and totals per
    order, hypothesis and reference lengths. ``by``: a row for each value of
    these columns too (``level`` and the columns come first)."""
    s = _levels(_counted(df, _plain_13a(pred), _plain_13a(ref), BLEU_ORDERS, by, _13a_words), by, *_bleu_sums())
    return s.select(*_named(by), *_bleu())


#: N-grams of BLEU.
BLEU_ORDERS = range(1, 5)


def _bleu_sums() -> list:
    return [*[F.sum(f"m{n}").alias(f"m{n}") for n in BLEU_ORDERS], *[F.sum(f"h{n}").alias(f"t{n}") for n in BLEU_ORDERS], F.sum("r1").alias("ref_len")]


def _bleu() -> list:
    """``bleu`` and the counts from the sums over all rows."""
    orders = BLEU_ORDERS
    zeros, logs, matched = F.lit(0), [], F.lit(0)
    for n in orders:
        m, t = F.col(f"m{n}"), F.col(f"t{n}")
        matched = matched + m
        zeros = zeros + F.when((m == 0) & (t > 0), 1).otherwise(0)
        p = F.when(t == 0, F.lit(0.0)).when(m > 0, F.lit(100.0) * m / t) \
            .otherwise(F.lit(100.0) / (F.pow(F.lit(2.0), zeros) * t))
        logs.append(F.when(p > 0, F.log(p)).otherwise(F.lit(LOG_ZERO)))
    hyp_len, ref_len = F.col("t1"), F.col("ref_len")
    bp = F.when(hyp_len >= ref_len, F.lit(1.0)).when(hyp_len > 0, F.exp(1 - ref_len / hyp_len)).otherwise(0.0)
    bleu = F.when(matched == 0, F.lit(0.0)).otherwise(bp * F.exp((logs[0] + logs[1] + logs[2] + logs[3]) / 4))
    return [F.bround(bleu, 4).alias("bleu"), *[F.col(f"m{n}") for n in orders], *[F.col(f"t{n}") for n in orders], F.col("t1").alias("hyp_len"), F.col("ref_len")]


def _rouge_n_rows(df: DataFrame, pred: str, ref: str, orders: Sequence[int], stem: bool, keep: Sequence[str]) -> DataFrame:
    """``f{n}`` for each row: its F1."""
    rows = _counted(df, F.lower(pred), F.lower(ref), orders, keep, _rouge_stems if stem else _rouge_words)
    return rows.select(*keep, *_rouge_n_f1(orders))


def _rouge_n_f1(orders: Sequence[int], of: str = "") -> list:
    fs = []
    for n in orders:
        p = F.col(f"{of}m{n}") / F.greatest(F.col(f"{of}h{n}"), F.lit(1))
        r = F.col(f"{of}m{n}") / F.greatest(F.col(f"{of}r{n}"), F.lit(1))
        fs.append(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias(f"f{n}"))
    return fs


def rouge_n(df: DataFrame, pred: str, ref: str, orders: Sequence[int] = (1, 2), by: Sequence[str] = (), stem: bool = False) -> DataFrame:
    """One row: ``rouge{n}`` = mean per-row F1 x 100, 4 places; ``by`` as for
    ``corpus_bleu``; ``stem``: words are stemmed first."""
    rows = _rouge_n_rows(df, pred, ref, orders, stem, by)
    out = _levels(rows, by, *_rouge_n_means(orders))
    return out.select(*_named(by), *[f"rouge{n}" for n in orders])


def _rouge_n_means(orders: Sequence[int]) -> list:
    return [F.bround(F.avg(f"f{n}") * 100, 4).alias(f"rouge{n}") for n in orders]


def _poisson(unit: Column) -> Column:
    """A Poisson(1) count from 32 uniform bits: how many cumulative probabilities lie at or below them."""
    share, cumulative, out = math.exp(-1), 0.0, F.lit(0)
    for k in range(1, 13):
        cumulative += share
        out = out + F.when(unit >= int(cumulative * (1 << 32)), 1).otherwise(0)
        share /= k
    return out


def _poisson_hex(digest: Column) -> Column:
    """The same from a hex digest: its first 8 digits compare as text as their numbers do, and most draws are small."""
    share, cumulative, out = math.exp(-1), 0.0, None
    for k in range(12):
        cumulative += share
        below = digest < f"{int(cumulative * (1 << 32)):08x}"
        out = F.when(below, k) if out is None else out.when(below, k)
        share /= k + 1
    return out.otherwise(12).cast("long")


def rouge_intervals(df: DataFrame, pred: str, ref: str, orders: Sequence[int] = (1, 2), replicates: int = 1000, seed: int = 0,
                    row_id: str = "row_id", stem: bool = False, level: float = 0.95) -> DataFrame:
    """``metric, low, mid, high`` (x 100, 4 places): percentiles of the mean F1
    over resampled corpora.

    Instead of drawing rows with replacement, each row counts in each replicate
    as often as a seeded Poisson(1) draw of its id says, so that a replicate
    needs no other row and the result does not depend on the partitioning. Sums
    by replicate are added inside each task; ``replicates`` rows are shuffled
    from each. A replicate without any row has the score 0."""
    rows = _rouge_n_rows(df, pred, ref, orders, stem, [row_id])
    # The draws of a row are one array, so that each is computed once.
    draws = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda b: F.md5(F.concat(F.col("_key"), b.cast("string"))))
    key = F.concat(draw_key(seed, "boot", F.col(row_id), "pw"), F.lit("|"))
    # Scores are summed as whole numbers of 10^-12, whose sum has no order, in
    # two parts (millions and the rest) that fit a long over any number of rows.
    whole = [F.round(F.col(f"f{n}") * 1e12).cast("long").alias(f"w{n}") for n in orders]
    each = materialize(rows.select(*whole, key.alias("_key")), {f"{p}{n}": F.expr(f"w{n} {op} 1000000") for n in orders for p, op in (("a", "div"), ("b", "%"))})
    each = each.select(*[f"{p}{n}" for n in orders for p in "ab"], F.posexplode(draws).alias("_b", "_d"))
    weighed = each.select("*", _poisson_hex(F.col("_d")).alias("_w"))
    parts = [F.sum(F.col("_w") * F.col(f"{p}{n}")).alias(f"{p}{n}") for n in orders for p in "ab"]
    sums = weighed.groupBy("_b").agg(F.sum("_w").alias("_n"), *parts).filter("_n > 0")
    total = [(F.col(f"a{n}").cast("decimal(20,0)") * 1_000_000 + F.col(f"b{n}")).alias(f"s{n}") for n in orders]
    sums = sums.select("_b", "_n", *total)
    every = df.sparkSession.range(replicates).select(F.col("id").cast("int").alias("_b")).join(sums, "_b", "left")
    means = every.select(*[F.coalesce(F.col(f"s{n}").cast("double") / F.col("_n").cast("double") / 1e12, F.lit(0.0)).alias(f"m{n}") for n in orders])
    edge = (1 - level) / 2
    cuts = F.array(F.lit(edge), F.lit(0.5), F.lit(1 - edge))
    found = means.agg(*[F.percentile(f"m{n}", cuts).alias(f"p{n}") for n in orders])
    entries = [F.struct(F.lit(f"rouge{n}").alias("metric"), *[F.bround(F.col(f"p{n}")[i] * 100, 4).alias(c) for i, c in enumerate(("low", "mid", "high"))])
               for n in orders]
    return found.select(F.inline(F.array(*entries)))


def _lcs(a, b) -> int:
    """LCS length by the bit-parallel method (Allison-Dix / Hyyro): one
    big-integer pass per token of ``a``; O(len(a) * len(b) / word size)."""
    if len(a) == 0 or len(b) == 0:
        return 0
    masks = {}
    for j, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << j)
    v = (1 << len(b)) - 1
    for tok in a:
        u = v & masks.get(tok, 0)
        v = (v + u) | (v - u)
    v &= (1 << len(b)) - 1
    return len(b) - bin(v).count("1")


def _f1(hits: int, n: int, m: int) -> float:
    """F1 of ``hits`` out of ``n`` predicted and ``m`` expected."""
    return 2 * hits / (n + m) if hits else 0.0


@F.arrow_udf(T.DoubleType())
def _rouge_l_f(h: pa.Array, r: pa.Array) -> pa.Array:
    return pa.array([_f1(_lcs(a, b), len(a), len(b)) for a, b in zip(_each(h, _rouge_words), _each(r, _rouge_words))], pa.float64())


def rouge_l(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """One row: ``rougeL`` = mean per-row LCS F1 x 100, 4 places. The LCS is
    a per-row kernel (Arrow-batched UDF); the mean is a native aggregate."""
    return df.agg(_percent(_rouge_l_f(F.lower(pred), F.lower(ref)), "rougeL"))


def _percent(f: Column, name: str) -> Column:
    """The mean of scores of rows x 100, 4 places."""
    return F.bround(F.avg(f) * 100, 4).alias(name)


def _lcs_places(a, b) -> set:
    """Places in ``a`` of one longest common subsequence with ``b``: the rows
    of the bit-parallel method are kept and walked back, taking a match where
    there is one, else dropping ``a``'s token unless that loses a match."""
    masks: dict = {}
    for j, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << j)
    full = (1 << len(b)) - 1
    rows = [full]
    for tok in a:
        v = rows[-1]
        u = v & masks.get(tok, 0)
        rows.append(((v + u) | (v - u)) & full)
    out, i, j = set(), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
            continue
        low = (1 << j) - 1
        if (rows[i] & low).bit_count() < (rows[i - 1] & low).bit_count():
            j -= 1
        else:
            i -= 1
    return out


def _union_places(s: list, preds: list, having: Mapping[str, list]) -> set:
    """Places in ``s`` of its longest common subsequences with each of ``preds``
    (pairs of a sentence and its set of tokens), in union. ``having``: the
    sentences that hold a token. Only a sentence that holds the token of a place
    can add the place, so each place looks at such sentences until one does. Rare
    tokens come first: their few sentences, most like ``s``, mostly add the places of the
    frequent ones too (the union does not depend on the order)."""
    union, seen = set(), set()
    for i in sorted(range(len(s)), key=[len(having.get(tok, ())) for tok in s].__getitem__):
        if i in union:
            continue
        for k in having.get(s[i], ()):
            if k in seen:
                continue
            seen.add(k)
            p, tokens = preds[k]
            # Tokens that the other side lacks are passed over by the walk.
            kept = [j for j, t in enumerate(s) if t in tokens]
            union.update([kept[0]] if len(kept) == 1 else [kept[j] for j in _lcs_places([s[j] for j in kept], p)])
            if i in union:
                break
    return union


def _summary_hits(pred: list, ref: list) -> int:
    """Union-LCS hits over sentences (lists of tokens), each token counted at
    most as often as it stands on either side."""
    left_p, left_r = Counter(t for s in pred for t in s), Counter(t for s in ref for t in s)
    preds = [(list(p), set(p)) for p in dict.fromkeys(map(tuple, pred))]
    having: dict = {}
    for k, (_, tokens) in enumerate(preds):
        for t in tokens:
            having.setdefault(t, []).append(k)
    # A place that no sentence adds is looked for in all that hold its token: the answer is kept for sentences that come again.
    places: dict = {}
    hits = 0
    for s in ref:
        key = tuple(s)
        if key not in places:
            places[key] = sorted(_union_places(s, preds, having))
        for i in places[key]:
            if left_p[s[i]] > 0 and left_r[s[i]] > 0:
                hits += 1
                left_p[s[i]] -= 1
                left_r[s[i]] -= 1
    return hits


@F.arrow_udf(T.DoubleType())
def _rouge_lsum_f(h: pa.Array, r: pa.Array) -> pa.Array:
    def sentences(text: str) -> list:
        return [_rouge_words(s) for s in text.split("\n")]

    return pa.array([_f1(_summary_hits(a, b), sum(map(len, a)), sum(map(len, b))) for a, b in zip(_each(h, sentences), _each(r, sentences))], pa.float64())


def rouge_lsum(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """One row: ``rougeLsum`` = mean per-row F1 x 100 of the union LCS over
    sentences (``split_sentences`` of the cleaned texts), 4 places."""
    return df.agg(_percent(_rouge_lsum_rows(pred, ref), "rougeLsum"))


def _rouge_lsum_rows(pred: str, ref: str) -> Column:
    return _rouge_lsum_f(*[F.lower(split_sentences(clean_text(F.col(c)))) for c in (pred, ref)])


def score(df: DataFrame, pred: str, ref: str, ids_col: str = "") -> DataFrame:
    """``(metric, value)`` rows: bleu, rouge1, rouge2, rougeL, rougeLsum, and
    gen_len where ``ids_col`` names the generated ids."""
    orders = (1, 2)
    # The steps of each metric, side by side: the rows are read (and derived) once, and each metric's sums are its own.
    rows = df.select(
        _overlap_kernel(list(BLEU_ORDERS), _13a_words)(_plain_13a(pred), _plain_13a(ref)).alias("_b"),
        _overlap_kernel(list(orders), _rouge_words)(F.lower(pred), F.lower(ref)).alias("_n"),
        _rouge_l_f(F.lower(pred), F.lower(ref)).alias("_l"), _rouge_lsum_rows(pred, ref).alias("_s"),
        *([_gen_len(ids_col).alias("_len")] if ids_col else []))
    rows = rows.select(F.struct(*_counts(BLEU_ORDERS, "_b")).alias("_b"), F.struct(*_counts(orders, "_n")).alias("_n"), "_l", "_s", *(["_len"] if ids_col else []))
    rows = rows.select("_b.*", "_n", "_l", "_s", *(["_len"] if ids_col else [])) \
        .select("*", F.inline(F.array(F.struct(*_rouge_n_f1(orders, "_n.")))))
    one = rows.agg(*_bleu_sums(), *_rouge_n_means(orders), _percent(F.col("_l"), "rougeL"), _percent(F.col("_s"), "rougeLsum"),
                   *([_gen_len_mean(4)] if ids_col else []))
    one = one.select(_bleu()[0], *[f"rouge{n}" for n in orders], "rougeL", "rougeLsum", *(["gen_len"] if ids_col else []))
    return one.unpivot([], one.columns, "metric", "value")


def pair_predictions(predictions: DataFrame, references: DataFrame, key: str = "row_id") -> DataFrame:
    """Predictions beside their references by key. A key that stands on one
    side only fails the job that reads the result."""
    p, r = predictions.withColumn("_p", F.lit(True)), references.withColumn("_r", F.lit(True))
    both = p.join(r, key, "full_outer")
    whole = F.col("_p").isNotNull() & F.col("_r").isNotNull()
    checked = F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("no partner for "), F.col(key).cast("string"))).cast("boolean"))
    return both.filter(checked).drop("_p", "_r")


def gen_len(df: DataFrame, ids_col: str, pad: int = 0, digits: Optional[int] = 4, by: Sequence[str] = ()) -> DataFrame:
    """Mean count of non-pad ids; ``digits=None`` leaves it unrounded; ``by`` as for ``corpus_bleu``."""
    rows = df.select(*by, _gen_len(ids_col, pad).alias("_len"))
    return _levels(rows, by, _gen_len_mean(digits)).select(*_named(by), "gen_len")


def _gen_len(ids_col: str, pad: int = 0) -> Column:
    return F.size(F.filter(ids_col, lambda x: x != pad))


def _gen_len_mean(digits: Optional[int]) -> Column:
    mean = F.avg("_len")
    return (mean if digits is None else F.bround(mean, digits)).alias("gen_len")


def score_levels(df: DataFrame, pred: str, ref: str, by: Sequence[str], ids_col: str = "") -> DataFrame:
    """``level, *by, metric, value``: BLEU, ROUGE-1, ROUGE-2 (and gen_len) for
    each value of each column of ``by`` and for all rows."""
    tables = [corpus_bleu(df, pred, ref, by).select(*_named(by), "bleu"), rouge_n(df, pred, ref, by=by)]
    if ids_col:
        tables.append(gen_len(df, ids_col, by=by))
    out = None
    for t in tables:
        long = t.unpivot(_named(by), [c for c in t.columns if c not in _named(by)], "metric", "value")
        out = long if out is None else out.unionByName(long)
    return out


def count_examples(df: DataFrame, limits: dict, split_col: str = "split") -> DataFrame:
    """Examples per split, capped by the configured maximum:
    ``train_samples``, ``eval_samples``, ``predict_samples``."""
    names = {"train": "train_samples", "validation": "eval_samples", "test": "predict_samples"}
    c = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"))
    cap = F.lit(None).cast("long")
    for s, lim in limits.items():
        cap = F.when(F.col(split_col) == s, F.lit(lim)).otherwise(cap)
    name = F.lit(None).cast("string")
    for s, nm in names.items():
        name = F.when(F.col(split_col) == s, F.lit(nm)).otherwise(name)
    return c.filter(name.isNotNull()).select(name.alias("metric"),
                                              F.coalesce(F.least("n", cap), F.col("n")).alias("value"))
