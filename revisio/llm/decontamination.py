"""9. Benchmark decontamination by a prefix-filtered set join.

A window is 13 consecutive words of a benchmark item, or a shorter item whole.
A document holds a window if all its words stand there one after another, so
it holds each of the window's shingles (3 words, or fewer for shorter items).
For exact containment one necessary shingle is enough to find all candidates:
the prefix of length one in an order by rarity. Rarity is counted over all
documents; each window's rarest shingle joins with the documents' shingles. The
shingle's place gives where the window would begin, which must lie in the
document with its whole length (positional and length bounds), and the words
there are compared one by one.

The table of prefix shingles is broadcast while it has at most
``max_broadcast`` rows. Beyond that, narrow rows (document key, place, shingle)
are joined by shuffle, where Spark splits skewed shingles, and the survivors
fetch the words by key.

Cases: null and empty texts have no words, no hits and are clean; null or empty
items have no windows; equal windows of several items count once for the words
and for each item; repeated documents get the same result one by one; a null
item_id is left out of the list; other columns never matter; an empty benchmark
leaves everything clean.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisio.functions.text import materialize
from revisio.llm.common import ALNUM_WORD, LOWER, UPPER, lower_ascii, read_table, written

WINDOW = 13
SHINGLE = 3
#: Rows of the prefix table (about 200 bytes each) up to which it is broadcast.
MAX_BROADCAST = 100_000

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lowered = lower_ascii(F.coalesce(text.cast("string"), F.lit("")))
    return F.filter(F.split(lowered, _SEPARATOR), lambda w: w != "")


def _shingle(words: Column, first: Column, at: Column, size: int) -> Column:
    return F.xxhash64(first, *[F.get(words, at + k) for k in range(1, size)])


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``(wid, w)`` and their items ``(wid, item_id)``."""
    items = materialize(benchmark.select(benchmark["item_id"].alias("item_id"), benchmark["text"].alias("text")),
                        {"_w": words_of(F.col("text"))}).filter("size(_w) > 0")
    n = F.size("_w")
    starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    rows = items.select("item_id", "_w", F.explode(starts).alias("_at")) \
        .select("item_id", F.slice("_w", F.col("_at"), F.lit(window)).alias("w")) \
        .select("item_id", F.sha2(F.array_join("w", " "), 256).alias("wid"), "w")
    rows = written(rows, "item-windows")
    return rows.groupBy("wid").agg(F.first("w").alias("w")), rows.select("wid", "item_id").filter("item_id is not null").distinct()


def _window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """``wid, w, size, sh, at``: each window's shingles with their places."""
    def of(s: int) -> DataFrame:
        shingles = F.transform(F.slice("w", F.lit(1), F.size("w") - s + 1), lambda x, i: _shingle(F.col("w"), x, i, s))
        return windows.filter(F.least(F.size("w"), F.lit(shingle)) == s) \
            .select("wid", "w", F.lit(s).alias("size"), F.posexplode(shingles).alias("at", "sh"))

    return _union([of(s) for s in range(1, shingle + 1)])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """Document key (id and hash of the text, so that repeated ids stay apart) and words."""
    return materialize(docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("_th"), docs["text"].alias("_text")),
                       {"_words": words_of(F.col("_text"))}).drop("_text")


def _places(keyed: DataFrame, size: int) -> DataFrame:
    """Every shingle of every document with its place."""
    words = F.col("_words")
    return keyed.select("doc_id", "_th", "_words", F.posexplode(
        F.transform(words, lambda w, i: _shingle(words, w, i, size))).alias("pos", "sh"))


def find_hits(docs: DataFrame, windows: DataFrame, shingle: int = SHINGLE, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``doc_id, _th, start, size, wid``: every occurrence of every window."""
    shingles = written(_window_shingles(windows, shingle), "window-shingles")
    sizes = [r[0] for r in shingles.select("size").distinct().collect()]  # at most ``shingle`` values
    distinct = shingles.select("size", "sh").distinct()
    keyed = _keyed(docs)
    small = shingles.count() <= max_broadcast
    hint = F.broadcast if small else (lambda t: t)
    # Rarity: how often each of these shingles stands in the documents.
    found = [_places(keyed, s).select("sh").join(hint(distinct.filter(F.col("size") == s).select("sh")), "sh")
             .groupBy("sh").agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.lit(s)) for s in sizes]
    if not found:
        return keyed.select("doc_id", "_th", F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit("").alias("wid")).limit(0)
    rarity = _union(found)
    prefix = shingles.join(rarity, ["size", "sh"], "left") \
        .groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "sh", "at", "size", "w")).alias("p")) \
        .select("wid", "p.*").filter("n > 0")  # a shingle that no document has: nor has any the window
    prefix = written(prefix.withColumnRenamed("size", "k"), "prefix")
    hits = []
    for s in sizes:
        own = prefix.filter(F.col("k") == s).select("wid", "w", "sh", "at")
        begin = F.col("pos") - F.col("at")
        if small:
            words = F.col("_words")
            hits.append(_places(keyed, s).join(F.broadcast(own), "sh")
                        .filter((begin >= 0) & (begin + F.size("w") <= F.size(words)) & (F.slice(words, F.greatest(begin, F.lit(0)) + 1, F.size("w")) == F.col("w")))
                        .select("doc_id", "_th", begin.alias("start"), F.size("w").alias("size"), "wid"))
        else:
            narrow = _places(keyed, s).select("doc_id", "_th", F.size("_words").alias("_n"), "pos", "sh")
            candidates = narrow.join(own.select("wid", "sh", "at", F.size("w").alias("size")), "sh") \
                .filter((begin >= 0) & (begin + F.col("size") <= F.col("_n"))) \
                .select("doc_id", "_th", begin.alias("start"), "size", "wid").distinct()
            whole = keyed.dropDuplicates(["doc_id", "_th"]).select(F.col("doc_id").alias("_d"), F.col("_th").alias("_t"), "_words")
            there = F.slice("_words", F.col("start") + 1, F.col("size"))
            hits.append(candidates.join(whole, candidates["doc_id"].eqNullSafe(whole["_d"]) & (candidates["_th"] == whole["_t"]))
                        .select("doc_id", "_th", "start", "size", "wid", there.alias("_there"))
                        .join(own.select("wid", "w"), "wid").filter(F.col("_there") == F.col("w"))
                        .select("doc_id", "_th", "start", "size", "wid"))
    return _union(hits)


def contamination(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Hits of each document with any: ``doc_id, _th, n_hit, n_items, items_sha256``.

    The hits are few; their groups are bounded by a document's length and by
    the benchmark.
    """
    windows, owners = item_windows(benchmark)
    hits = written(find_hits(docs, windows, max_broadcast=max_broadcast), "hits")
    words = hits.groupBy("doc_id", "_th").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("_spans"))
    covered = F.aggregate(
        "_spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(acc["end"], s["start"]))).alias("n"),
                                F.greatest(acc["end"], s["start"] + s["size"]).alias("end")),
        lambda acc: acc["n"])
    words = words.select("doc_id", "_th", covered.cast("long").alias("n_hit"))
    ids = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    items = hits.select("doc_id", "_th", "wid").distinct().join(owners, "wid").groupBy("doc_id", "_th").agg(ids.alias("_ids")) \
        .select(F.col("doc_id").alias("_d"), F.col("_th").alias("_t"), "_ids")
    return words.join(items, words["doc_id"].eqNullSafe(items["_d"]) & (words["_th"] == items["_t"]), "left") \
        .select("doc_id", "_th", "n_hit", F.coalesce(F.size("_ids"), F.lit(0)).alias("_size"), "_ids") \
        .select("doc_id", "_th", "n_hit", F.greatest("_size", F.lit(0)).cast("long").alias("n_items"),
                F.sha2(F.coalesce(F.array_join("_ids", ","), F.lit("")), 256).alias("items_sha256"))


def _is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


_EITHER_CASE_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _word_count(text: Column) -> Column:
    """Pieces between separators, of which the first and the last may be empty.
    (``regexp_count`` makes a match object for every word.)"""
    pieces = F.split(text, _EITHER_CASE_SEPARATOR)
    return F.coalesce(F.array_size(F.array_remove(pieces, "")), F.lit(0)).cast("long")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row."""
    found = contamination(docs, benchmark)
    own = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("_key"), _word_count(docs["text"].cast("string")).alias("n_words"))
    found = found.withColumnRenamed("doc_id", "_d")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return own.join(found, own["doc_id"].eqNullSafe(found["_d"]) & (own["_key"] == found["_th"]), "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        _is_contaminated(n_hit, F.col("n_words")).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns.

    Hits belong to an id and a text's hash, so another row with the same id stays.
    """
    found = contamination(docs, benchmark)
    n = _word_count(docs["text"].cast("string"))
    found = found.select(F.col("doc_id").alias("_d"), "_th", F.col("n_hit").alias("_hit"))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_d"]) & (F.xxhash64(docs["text"]) == found["_th"])
                     & _is_contaminated(found["_hit"], n), "left_anti")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWERED}, '{ALNUM_WORD}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWERED}, '{ALNUM_WORD}') AS w FROM benchmark),
iw AS (SELECT item_id, w[s:s + {WINDOW - 1}] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS size FROM iw),
dw AS (SELECT k, s, size, w[s:s + size - 1] AS win FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT DISTINCT k, s, size, item_id FROM dw JOIN iw USING (win)),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + size)) AS p FROM hit) GROUP BY k),
items AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)"""
