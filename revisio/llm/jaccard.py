"""7. N-gram Jaccard join by rare-first prefix filtering.

A text's set holds its distinct word shingles (as 64-bit hashes). Two texts
link if 100 * |intersection| >= percent * |union|.

1. Texts with equal sets form a class; everything below works on classes, so
   copies are never expanded into pairs. A class is named by a 128-bit digest.
2. Shingles are ordered by how often they stand in the whole corpus, rare ones
   first (counted in ``2**SKETCH_BITS`` hash slots; any fixed order gives right
   results, rarity only makes the prefixes selective). A set's prefix are its
   first n - ceil(percent * n / 100) + 1 shingles: two sets that link share one
   of them.
3. A prefix shingle is kept for a class only if another class of a size that may
   link has it too (sizes in steps of the linking ratio; the same step or a
   neighbouring one). Classes are joined on these shingles. Candidates pass a length filter, a
   positional filter (what may still overlap from the shared place on; a pair
   that links passes it at the first shingle that both sets have, so it is not
   asked to pass at later ones), and a suffix filter: the sets' shingles are
   dealt into slots by hash, as many as fit the set's size, and two sets differ
   in at least as many shingles as there are slots in which one count is odd and
   the other even. Each pair that is left is verified once by intersecting the
   two sets.
4. The classes of a shingle that at most ``GROUP`` classes have are compared at
   once, in one join. For the others only components are asked for, so pairs
   inside a component need no further look. In a *star* step each prefix shingle's group is compared with one of
   its members only, which joins a large group of near copies with as many
   pairs as members. Star steps repeat while many pairs are left and each
   step takes a good part of them away; the last step always compares all
   remaining candidates between different components, by all their slots, so no
   link is lost.
   A shingle whose classes all lie in one component is done for good, so the
   prefix rows shrink with each step; tables of past steps are deleted.

Cases: null, empty and blank texts have empty sets, link with nothing and are
their own component; repeated rows share a class; ties do not arise (a
component's id is its smallest doc_id); a null doc_id never names a component
unless all are null; other columns are ignored (``keep_one`` passes them
through); an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revisio.llm.common import on_workers, read_table, remove, written
from revisio.llm.graph import components
from revisio.llm.shingles import shingle_sets
from revisio.llm.units import blocks

SKETCH_BITS = 18
#: Slots of the suffix filter: parities in 64-bit words, a power of two between
#: these that gives each shingle a slot (too few slots tell nothing about a large
#: set), folded into fewer where they travel with each prefix shingle.
PARITY_WORDS, MAX_PARITY_WORDS, FOLDED_WORDS = 32, 256, 8
#: Classes of a shingle up to which all of them are compared at once.
GROUP = 16
#: Pairs for each prefix row up to which what is left is compared at once.
PAIRS_PER_ROW = 2
#: Share of the pairs left that a star step must take away to be repeated.
STAR_GAIN = 0.3
#: Classes whose sets are fetched by a broadcast of their documents' ids (16
#: bytes each); more are fetched by a shuffle.
MAX_BROADCAST = 500_000
#: Shared prefix shingles (8 bytes each) that are broadcast; more are joined by
#: a shuffle of the prefixes.
MAX_SHARED = 2_000_000


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def parities(s: np.ndarray) -> np.ndarray:
    """Whether a set has an odd number of shingles in each slot, as bits of 64-bit
    words. Half as many words are the two halves' XOR."""
    words = min(MAX_PARITY_WORDS, max(PARITY_WORDS, 1 << (-(-len(s) // 64) - 1).bit_length()))
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("th"), text.alias("text"))


def _rarity(docs: DataFrame, size: int) -> np.ndarray:
    """How many documents hold a shingle of each slot; at most 2**SKETCH_BITS rows reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0)
            for a, b in blocks(texts):
                sets = shingle_sets(texts.slice(a, b - a).to_pylist(), size)
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["slot", "n"])

    rows = docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out


def _members(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row a document: set size, class, prefix in order, parities, and folded parities."""
    rarity = docs.sparkSession.sparkContext.broadcast(_rarity(docs, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = rarity.value
        for batch in batches:
            texts = batch.column(2)
            for a, b in blocks(texts):
                sets = shingle_sets(texts.slice(a, b - a).to_pylist(), size)
                prefix, parity, folded = [], [], []
                for s in sets:
                    order = np.lexsort((s, seen[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                    prefix.append(s[order[:prefix_length(len(s), percent)]].view(np.int64) if len(s) else s.view(np.int64))
                    parity.append(parities(s))
                    folded.append(np.bitwise_xor.reduce(parity[-1].reshape(-1, FOLDED_WORDS), axis=0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(s) for s in sets], pa.int32()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                     pa.array(prefix, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64())), pa.array(folded, pa.list_(pa.int64()))],
                    ["doc_id", "th", "n", "sig", "prefix", "parity", "odd"])

    return docs.mapInArrow(run, "doc_id long, th long, n int, sig binary, prefix array<long>, parity array<long>, odd array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``sig, items``: the sorted sets of the classes in ``wanted`` (first_id, first_th, sig), made from one text each."""
    wanted = written(wanted.select("first_id", "first_th"), "wanted")
    if wanted.count() <= MAX_BROADCAST:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["first_id"]) & (docs["th"] == wanted["first_th"]), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for a, b in blocks(column):
                sets = shingle_sets(column.slice(a, b - a).to_pylist(), size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in sets], pa.binary())], ["sig", "items"])

    # Repeated rows of one document give equal sets.
    return texts.mapInArrow(run, "sig binary, items binary").filter("sig is not null").dropDuplicates(["sig"])


def _band(n: Column, percent: int) -> Column:
    """Set sizes in steps of the ratio that still links: sets that link lie in the same step or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(100 / percent) * (1 + 1e-9)) if percent < 100 else n).cast("int")


def _partnered(classes: DataFrame, percent: int) -> DataFrame:
    """``shingle, band, big``: the prefix shingles that several classes of sizes
    that may link share; ``big`` if more than ``GROUP`` classes have the shingle.

    Counted by shingle and size step first, so that a frequent shingle sends one
    row a step; the steps of one shingle are then held against their neighbours."""
    counts = classes.select(_band(F.col("n"), percent).alias("band"), F.explode("prefix").alias("shingle")) \
        .groupBy("shingle", "band").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("shingle").orderBy("band")
    near = (F.coalesce(F.col("band") - F.lag("band").over(w) <= 1, F.lit(False))) | (F.coalesce(F.lead("band").over(w) - F.col("band") <= 1, F.lit(False)))
    big = F.sum("c").over(Window.partitionBy("shingle")) > GROUP
    return written(counts.withColumn("near", near).withColumn("big", big).filter("c > 1 or near").select("shingle", "band", "big"), "shared")


def _needed(na: Column, nb: Column, percent: int) -> Column:
    """Least overlap of sets of these sizes that link."""
    return F.expr("0") + F.ceil((na + nb) * percent / F.lit(100 + percent) - F.lit(1e-9))


def _apart(x: Column, y: Column) -> Column:
    """Slots whose parities differ: no more than the shingles in which two sets
    differ. Of two numbers of slots, the smaller counts."""
    least = F.least(F.size(x), F.size(y))

    def folded(z: Column) -> Column:
        merged = F.transform(F.sequence(F.lit(0), least - 1), lambda k: F.aggregate(
            F.sequence(k, F.size(z) - 1, least), F.lit(0).cast("long"), lambda s, j: s.bitwiseXOR(F.get(z, j))))
        return F.when(F.size(z) == least, z).otherwise(merged)

    return F.aggregate(F.zip_with(folded(x), folded(y), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, n: s + n)


#: What travels with each prefix shingle.
_ROW = ("sig", "n", "pos", "odd", "label")


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("shingle", *[F.col(c).alias(f"{name}_{c}") for c in _ROW])


def _may_link(percent: int, first: bool) -> Column:
    """Length, positional and suffix filters on rows with both sides' ``a_`` and ``b_`` columns.

    ``first``: of a pair that links, only the row of the first shingle that both
    sets have must pass. All prefixes have one order, so the sets share nothing
    before it."""
    na, nb, pa_, pb = F.col("a_n"), F.col("b_n"), F.col("a_pos"), F.col("b_pos")
    most = F.least(na - pa_, nb - pb) + (F.lit(0) if first else F.least(pa_, pb))
    need = _needed(na, nb, percent)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (most >= need) \
        & (na + nb - _apart(F.col("a_odd"), F.col("b_odd")) >= 2 * need)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The pairs (a, b) that link, after the suffix filter and the intersection,
    and the tables that they are read from."""
    one = classes.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("parity").alias("xa"))
    two = classes.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("xb"))
    apart = _apart(F.col("xa"), F.col("xb"))
    # The sets differ in at least ``apart`` shingles, so they share at most half of the others.
    pairs = written(pairs.join(one, "a").join(two, "b")
                    .filter(F.col("na") + F.col("nb") - apart >= 2 * _needed(F.col("na"), F.col("nb"), percent)).select("a", "b"), "pairs")
    wanted = pairs.select(F.col("a").alias("sig")).unionAll(pairs.select("b")).distinct()
    sets = written(_sets(docs, classes.join(wanted, "sig", "left_semi"), size), "sets")
    both = pairs.join(sets.select(F.col("sig").alias("b"), F.col("items").alias("y")), "b") \
        .join(sets.select(F.col("sig").alias("a"), F.col("items").alias("x")), "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return both.mapInArrow(run, "a binary, b binary"), [pairs, sets]


def jaccard_components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc_id, th, n_shingles, component_id, component_th`` for each row.

    ``th`` is the text's hash; ``component_id`` and ``component_th`` name the
    component's first document.
    """
    on_workers(docs.sparkSession)
    docs = _texts(docs)
    members = written(_members(docs, size, percent), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "n", "prefix", "parity", "odd")).alias("f")
    classes = written(members.filter("sig is not null").groupBy("sig").agg(first)
                      .select("sig", F.col("f.doc_id").alias("first_id"), F.col("f.th").alias("first_th"), "f.n", "f.prefix", "f.parity", "f.odd"), "classes")
    # From here on documents need their class alone.
    wide, members = members, written(members.select("doc_id", "th", "n", "sig"), "documents")
    remove(wide)
    shared = _partnered(classes, percent)
    n_shared = shared.count()
    band = _band(F.col("n"), percent).alias("band")
    if n_shared <= MAX_SHARED:
        rows = classes.select("sig", "n", "odd", band, F.posexplode("prefix").alias("pos", "shingle")) \
            .join(F.broadcast(shared), ["shingle", "band"])
    else:
        # Narrow rows meet the shingles; those that stay fetch their class's parities.
        narrow = classes.select("sig", band, F.posexplode("prefix").alias("pos", "shingle")).join(shared, ["shingle", "band"])
        rows = narrow.join(classes.select("sig", "n", "odd"), "sig")
    every = written(rows.select("shingle", "sig", "n", "pos", "odd", "big"), "prefixes")
    remove(shared)
    wide, classes = classes, written(classes.drop("prefix", "odd"), "classes")
    remove(wide)
    n_small, n_rows = every.agg(F.count_if(~F.col("big")), F.count_if("big")).first()
    links, labels, step, before = None, None, 0, None
    if n_small:
        small = every.filter("not big").withColumn("label", F.col("sig"))
        one, two = _side(small, "a"), _side(small, "b")
        found = one.join(two, (one["shingle"] == two["shingle"]) & (F.col("a_sig") < F.col("b_sig")) & _may_link(percent, first=True))
        new, used = _verified(found.select(F.col("a_sig").alias("a"), F.col("b_sig").alias("b")).distinct(), classes, docs, size, percent)
        links = written(new, "links")
        labels = components(links)
        for table in used:
            remove(table)
    rows = every.filter("big").drop("big")
    while n_rows:
        now, last = rows.withColumn("label", F.col("sig")), False
        if labels is not None:
            now = rows.join(labels, rows["sig"] == labels["node"], "left").drop("node").withColumn("label", F.coalesce("label", "sig"))
            # Shingles whose classes all lie in one component are done, and stay so.
            by = now.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("shingle") \
                .agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("own")).filter("all * all > own")
            open_ = written(by.select("shingle", ((F.col("all") * F.col("all") - F.col("own")) / 2).alias("left")), "open")
            left, n_open = open_.agg(F.coalesce(F.sum("left"), F.lit(0)), F.count(F.lit(1))).first()
            if not left:
                break
            last = left <= PAIRS_PER_ROW * n_rows or (before is not None and left > (1 - STAR_GAIN) * before)
            before = left
            still = F.broadcast(open_.select("shingle")) if n_open <= MAX_SHARED else open_.select("shingle")
            now = written(now.join(still, "shingle", "left_semi").select("shingle", *_ROW), "prefixes")
            remove(rows)
            remove(open_)
            rows = now.drop("label")
        if last:
            # Few enough rows to carry all slots.
            now = now.drop("odd").join(classes.select("sig", F.col("parity").alias("odd")), "sig")
            one, two = _side(now, "a"), _side(now, "b")
            found = one.join(two, (one["shingle"] == two["shingle"]) & (F.col("a_sig") < F.col("b_sig")) & (F.col("a_label") != F.col("b_label"))
                             & _may_link(percent, first=True))
        else:
            # The middle of a group: another one in each step.
            place = F.xxhash64("sig", F.lit(step)).alias("h")
            middle = now.groupBy("shingle").agg(F.min(F.struct(place, *_ROW)).alias("m")).select("shingle", *[f"m.{c}" for c in _ROW])
            middle, two = _side(middle, "a"), _side(now, "b")
            found = two.join(middle, (middle["shingle"] == two["shingle"]) & (F.col("a_label") != F.col("b_label")) & _may_link(percent, first=False))
        pairs = found.select(F.least("a_sig", "b_sig").alias("a"), F.greatest("a_sig", "b_sig").alias("b")).distinct()
        new, used = _verified(pairs, classes, docs, size, percent)
        old_links, old_labels = links, labels
        links = written(new if links is None else links.unionByName(new), "links")
        labels = components(links)
        for table in (*used, old_links, old_labels):
            if table is not None:
                remove(table)
        step += 1
        if last:
            break
    name = classes.select("sig", "first_id", "first_th")
    if labels is not None:
        name = name.join(labels, name["sig"] == labels["node"], "left").drop("node")
        least = F.min(F.struct(F.col("first_id").isNull().alias("no_id"), F.col("first_id").alias("id"), F.col("first_th").alias("t"))).alias("m")
        least = written(name.filter("label is not null").groupBy("label").agg(least), "component-names")
        name = name.join(least, "label", "left").select("sig", F.coalesce("m.id", "first_id").alias("component_id"),
                                                        F.when(F.col("m").isNotNull(), F.col("m.t")).otherwise(F.col("first_th")).alias("component_th"))
    else:
        name = name.select("sig", F.col("first_id").alias("component_id"), F.col("first_th").alias("component_th"))
    name = written(name, "class-names")
    for table in (classes, rows, links, labels):
        if table is not None:
            remove(table)
    narrow = members.select("doc_id", "th", F.col("n").cast("long").alias("n_shingles"), "sig")
    return narrow.join(name, "sig", "left").select(
        "doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n_shingles") > 0, F.col("component_th")).otherwise(F.col("th")).alias("component_th"))


def keep_one(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One document of each component, with its columns: the smallest doc_id's
    (of rows that repeat it exactly, one). Texts without a shingle all stay."""
    found = written(jaccard_components(docs, size, percent), "decided")
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("component_th"))
    key = [F.col("doc_id").alias("_id"), F.col("th").alias("_th")]
    gone = found.filter(~first).select(*key).distinct().withColumn("_again", F.lit(False))
    again = found.filter(first & (F.col("n_shingles") > 0)).groupBy(*key).agg(F.count(F.lit(1)).alias("_c")) \
        .filter("_c > 1").select("_id", "_th", F.lit(True).alias("_again"))
    moved = written(gone.unionAll(again), "moved")
    n_moved, n_again = moved.agg(F.count(F.lit(1)), F.count_if("_again")).first()

    def same(keys: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(keys["_id"]) & (F.xxhash64(docs["text"]) == keys["_th"])

    def keys(rows: DataFrame, n: int) -> DataFrame:
        return F.broadcast(rows.select("_id", "_th")) if n <= MAX_BROADCAST else rows.select("_id", "_th")

    # The texts meet all ids that do not stay as they are in one join.
    gone = keys(moved, n_moved)
    once = docs.join(gone, same(gone), "left_anti")
    if not n_again:
        return once
    again = keys(moved.filter("_again"), n_again)
    repeated = docs.join(again, same(again), "left_semi").withColumn("__llm_th", F.xxhash64("text")) \
        .dropDuplicates(["doc_id", "__llm_th"]).drop("__llm_th")
    return once.unionByName(repeated)


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    found = jaccard_components(read_table(spark, sf_dir, "documents"), size=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")
