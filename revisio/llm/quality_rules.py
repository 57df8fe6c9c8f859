"""8. Quality rules: a learned decision list over text statistics.

Statistics are integers computed in the row by Spark functions. A decision list
is learned by sequential covering: a rule is grown condition by condition
(threshold on one statistic, chosen by FOIL gain) on one part of the labelled
rows, pruned from its end on the other part, and kept if it is precise there;
the rows it covers are taken out and the next rule is grown. Every step is one
Spark aggregation over the labelled rows, which gives counts by statistic and
threshold (a bound that does not depend on the rows). The list comes out as an
ordered ``CASE WHEN`` expression: a document goes with the first rule that
matches and stays if none does.

Base rule beside the list: fewer than 10 words, or more than a fifth of the
words in repeated 5-word windows.

Cases: null text has no words and fails the base rule, as does empty text;
labels that are null or neither 0 nor 1 teach nothing; a document with several
label rows counts once for each; without both classes the list is empty and the
base rule alone decides; repeated documents are judged one by one; other
columns are passed through by ``apply_rules`` and ignored by ``quality_rules``.
"""
from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisio.functions.text import materialize
from revisio.llm.common import SPACE_WORD, crc32_mod, read_table, written

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics the rules may use, each with its grid of thresholds. Shares are
#: per thousand, the mean word length is in hundredths of a character.
_SHARE = (1, 2, 5, 10, 20, 30, 50, 75, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900, 950, 1000)
GRID = {
    "n_words": (10, 15, 20, 30, 50, 75, 100, 200, 500, 1000, 2000, 5000, 10000),
    "mean_word": (150, 200, 250, 300, 350, 400, 450, 500, 550, 600, 700, 800, 1000, 1500, 2500),
    "symbol_share": _SHARE,
    "upper_share": _SHARE,
    "mark_share": _SHARE,
    "digit_share": _SHARE,
    "dup_line_share": _SHARE,
    "repeat_share": _SHARE,
    "distinct_share": _SHARE,
}
MAX_RULES = 8
MAX_CONDITIONS = 3
#: Of the rows that a pruned rule covers, in the part it was not grown on.
MIN_PRECISION = 0.9
#: Least low-quality rows that a condition must cover while a rule grows.
MIN_COVER = 5


@dataclass(frozen=True)
class Condition:
    stat: str
    at_least: bool
    threshold: int

    def column(self, stats: Column) -> Column:
        return stats[self.stat] >= self.threshold if self.at_least else stats[self.stat] < self.threshold

    def __str__(self) -> str:
        return f"{self.stat} {'>=' if self.at_least else '<'} {self.threshold}"


Rule = tuple[Condition, ...]


def with_stats(docs: DataFrame, text_col: str = "text", out: str = "_stats") -> DataFrame:
    """``docs`` plus one struct column of statistics, named ``out``."""
    return judged_rows(docs, text_col).select("doc.*", F.col("_stats").alias(out))


def judged_rows(docs: DataFrame, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``doc, _stats``: each row (or those ``columns`` of it) as a struct, whatever
    its columns are called, beside its statistics; all in the row, no shuffle.

    Repeated windows are found by sorting the windows' hashes with their
    places and comparing neighbours, and only in texts that have any.
    """
    t = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns or docs.columns]).alias("doc"), t.alias("_qr_t"))
    df = materialize(rows, {"_qr_words": F.filter(F.split("_qr_t", SPACES), lambda w: w != "")})
    words = F.col("_qr_words")
    windows = F.when(F.size(words) > WINDOW, F.transform(
        F.slice(words, 1, F.size(words) - (WINDOW - 1)),
        lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)])))
    df = materialize(df, {"_qr_win": F.coalesce(windows, F.array().cast("array<bigint>"))})
    win = F.col("_qr_win")
    df = materialize(df, {"_qr_sorted": F.when(
        F.size(F.array_distinct(win)) < F.size(win),
        F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("at")))))})
    s = F.col("_qr_sorted")
    twice = F.transform(s, lambda e, i: F.when((F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]), e["at"]))
    df = materialize(df, {"_qr_at": F.array_sort(F.filter(twice, lambda x: x.isNotNull()))})
    covered = F.aggregate(
        "_qr_at", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"])
    df = materialize(df, {"_qr_lines": F.filter(F.split("_qr_t", "\n", -1), lambda x: x.rlike(SPACE_WORD))})
    n, lines = F.size(words), F.col("_qr_lines")
    df = materialize(df, {"_qr_base": F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("_qr_t", SPACES, "")).cast("long").alias("word_chars"),
        F.regexp_count("_qr_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.regexp_count("_qr_t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("_qr_t", F.lit(r"[!?]")).cast("long").alias("n_marks"),
        F.regexp_count("_qr_t", F.lit(r"[0-9]")).cast("long").alias("n_digits"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))})
    b = F.col("_qr_base")

    def per(top: str, bottom: str, unit: int = 1000) -> Column:
        return F.when(b[bottom] > 0, F.floor(b[top] * unit / b[bottom])).otherwise(0).cast("long")

    stats = F.struct(
        *[b[c].alias(c) for c in BASE], per("word_chars", "n_words", 100).alias("mean_word"),
        per("n_symbols", "word_chars").alias("symbol_share"), per("n_upper", "word_chars").alias("upper_share"),
        per("n_marks", "word_chars").alias("mark_share"), per("n_digits", "word_chars").alias("digit_share"),
        per("n_dup_lines", "n_lines").alias("dup_line_share"), per("n_repeat_words", "n_words").alias("repeat_share"),
        per("n_distinct", "n_words").alias("distinct_share"))
    return materialize(df, {"_stats": stats}).select("doc", "_stats")


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > REPEAT_PERCENT * stats["n_words"])


def _matches(rule: Rule, stats: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.column(stats) for c in rule])


def learn_rules(stats: DataFrame, labels: DataFrame, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS,
                min_precision: float = MIN_PRECISION, min_cover: int = MIN_COVER) -> list[Rule]:
    """Sequential covering over all labelled rows.

    ``stats``: doc_id and ``_stats``; ``labels``: doc_id and quality (1 good,
    0 low). Rows with equal statistics on the grid are summed up once, and each
    step reads that table and brings counts by (statistic, threshold, class) to
    the driver.
    """
    s = F.col("_stats")
    labelled = stats.select("doc_id", "_stats").join(
        labels.select(labels["doc_id"].alias("doc_id"), labels["quality"].alias("_quality")).filter("_quality in (0, 1)"), "doc_id") \
        .filter(~base_failed(s))

    def code(stat: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(g) for g in GRID[stat]]), lambda g: g <= s[stat])).alias(stat)

    cube = written(labelled.select((F.col("_quality") == 0).alias("low"), (crc32_mod(F.col("doc_id"), 3) == 0).alias("prune"), *map(code, GRID))
                   .groupBy("low", "prune", *GRID).agg(F.count(F.lit(1)).alias("n")), "quality-cube")
    # On the cube a statistic is the number of its thresholds that it reaches.
    def on_cube(c: Condition) -> Column:
        place = GRID[c.stat].index(c.threshold) + 1
        return F.col(c.stat) >= place if c.at_least else F.col(c.stat) < place

    def match(rule: Rule) -> Column:
        return reduce(lambda a, b: a & b, [on_cube(c) for c in rule], F.lit(True))

    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = cube.filter(reduce(lambda a, r: a & ~match(r), rules, F.lit(True)))
        grown: Rule = ()
        while len(grown) < max_conditions:
            counts = left.filter(~F.col("prune") & match(grown)) \
                .select("low", "n", F.inline(F.array(*[F.struct(F.lit(k).alias("stat"), F.col(k).alias("code")) for k in GRID]))) \
                .groupBy("stat", "code", "low").agg(F.sum("n").alias("n")).collect()
            best = _best_condition([tuple(r) for r in counts], min_cover)
            if best is None:
                break
            grown += (best,)
        if not grown:
            break
        prefixes = [grown[:i] for i in range(1, len(grown) + 1)]
        sums = left.filter("prune").agg(*[F.sum(F.when(match(p) & (F.col("low") == low), F.col("n")).otherwise(0)).alias(f"{i}{low}")
                                          for i, p in enumerate(prefixes) for low in (True, False)]).first()
        worth = []
        for i, p in enumerate(prefixes):
            hit, miss = sums[f"{i}True"] or 0, sums[f"{i}False"] or 0
            if hit and hit / (hit + miss) >= min_precision:
                worth.append(((hit - miss) / (hit + miss), hit, -len(p), i))
        if not worth:
            break
        rules.append(prefixes[max(worth)[-1]])
    return rules


def _best_condition(counts: list[tuple], min_cover: int) -> Condition | None:
    """The condition of highest FOIL gain from rows (stat, code, low, n); ties
    go to the first statistic and threshold in the grid's order."""
    by: dict[str, dict[bool, dict[int, int]]] = {k: {True: {}, False: {}} for k in GRID}
    for stat, code, low, n in counts:
        by[stat][low][code] = n
    first = next(iter(GRID))
    hits, misses = sum(by[first][True].values()), sum(by[first][False].values())
    if not hits or not misses:
        return None
    before, best = math.log2(hits / (hits + misses)), (1e-9, None)
    for stat, grid in GRID.items():
        for place, threshold in enumerate(grid, 1):
            up = [sum(n for code, n in by[stat][low].items() if code >= place) for low in (True, False)]
            for at_least, (p, q) in ((True, up), (False, [hits - up[0], misses - up[1]])):
                if p >= min_cover and p + q < hits + misses:
                    gain = p * (math.log2(p / (p + q)) - before)
                    if gain > best[0]:
                        best = (gain, Condition(stat, at_least, threshold))
    return best[1]


def decision(rules: list[Rule], stats: Column) -> Column:
    """The list as an expression: the number of the first matching rule, from 1; null if none."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(_matches(rules[0], stats), F.lit(1))
    for i, rule in enumerate(rules[1:], 2):
        out = out.when(_matches(rule, stats), F.lit(i))
    return out


def apply_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    return kept_rows(judged_rows(docs, text_col), rules)


def kept_rows(judged: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that stay of a table of ``judged_rows``, with their own columns."""
    s = F.col("_stats")
    return judged.filter(~base_failed(s) & decision(rules, s).isNull()).select("doc.*")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base verdict, matching rule (null: none) and verdict for each row.

    The texts are read once: the statistics are written to the shared folder,
    then learned from and judged.
    """
    stats = written(judged_rows(docs, columns=["doc_id"]).select("doc.doc_id", "_stats"), "quality-stats")
    rules = learn_rules(stats, labels)
    s = F.col("_stats")
    failed, rule = base_failed(s), decision(rules, s)
    return stats.select("doc_id", *[s[c].alias(c) for c in BASE], failed.alias("base_failed"),
                        (~failed & rule.isNull()).alias("kept"), rule.alias("rule"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
