"""13. Merkle manifest of a dataset, with leaf places from bitmap ranks.

Every row is a leaf: sha256 over its fields, each ``-`` if null, else its UTF-8
byte count, ``:`` and the value. The rows of one source form a tree in
ascending doc_id; every three consecutive nodes become their hash until one is
left, the source's subroot; the subroots, by source, likewise give the root.

1. **Places without sorting the leaves.** doc_ids become bits: one 64-bit word
   for each (source, doc_id >> 6) that occurs, merged by ``bit_or`` in partial
   aggregates, so empty words cost nothing. Popcount directories hold how many
   rows stand before a word: sums inside groups of 2^16 neighbouring words, then
   groups of 2^16 such groups, and so on, so that no window ever holds more
   than 2^16 entries, be the ids dense or scattered over all 64 bits. A leaf
   joins its word; its place is the directory's sum plus the bits below its own.
2. **Levels in keyed slot arrays.** 3^6 neighbouring nodes meet in one array
   (key: tree and block, slot: place in the block) and are reduced six levels at
   once in one row; a corpus of n leaves takes log n / log 729 such steps. Arrays
   have at most 729 slots, whatever a source holds.
3. **Proofs go down the same arrays**: a block's path to the root is joined once
   a block and continued inside it, so leaves meet no join for each level.

Verifying folds each leaf (or what tampering made of it) with its siblings up
to the root and compares.

Cases: null fields are ``-``; null sources are one tree, the first; null
doc_ids come first in their tree and are never tampered with; rows with equal
doc_id and source are ordered by their leaf hash, and wholly equal rows are
alike in every order; empty texts are ``0:``; an empty table gives an empty
result; other columns are ignored. Only ``doc_id, source, lang, n_chars, text``
are read; doc_id is a 64-bit integer.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revisio.llm.common import crc32_mod, on_workers, read_table, written

#: Children of a node, and levels that are reduced in one array.
FAN, LEVELS = 3, 6
BLOCK = FAN ** LEVELS
#: Bits of a directory group: at most this many entries in one window.
GROUP_BITS = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(c: Column) -> Column:
    c = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``tree, doc_id, leaf, fake``: ``tree`` is a source's name in order (null
    first), ``fake`` the leaf without line feeds where ``tampered`` holds."""
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *[docs[c].cast("string").alias(c) for c in FIELDS[1:]])
    tampered = F.lit(False) if tampered is None else tampered

    def digest(text: Column) -> Column:
        return F.unhex(F.sha2(F.concat(*[_field(F.col(c)) for c in FIELDS[:-1]], _field(text)).cast("binary"), 256))

    changed = tampered & F.col("text").contains("\n")
    return d.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("tree"), "doc_id", digest(F.col("text")).alias("leaf"),
                    F.when(changed, digest(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("fake"))


def _before(rows: DataFrame, key: str, group: Column, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``n`` over earlier keys of the same group of 2^16."""
    w = Window.partitionBy("tree", "_group").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_group", group).withColumn(out, F.coalesce(F.sum("n").over(w), F.lit(0)))


def word_directory(rows: DataFrame) -> DataFrame:
    """``tree, word, bits, n, before``: the bitmap's words of ``rows`` (tree,
    doc_id not null), their rows, and the tree's rows in earlier words."""
    words = written(rows.groupBy("tree", F.shiftright("doc_id", 6).alias("word"))
                    .agg(F.bit_or(F.expr("shiftleft(1L, int(doc_id & 63))")).alias("bits"), F.count(F.lit(1)).alias("n")), "merkle-words")
    out, level, key, sums = words, words.select("tree", F.col("word").alias("k0"), "n"), "k0", []
    for step in (1, 2, 3, 4):  # 58-bit words: 16, 16, 16 and 10 bits
        parent = F.shiftright(key, GROUP_BITS) if step < 4 else F.lit(0)
        level = _before(level, key, parent, f"b{step}")
        sums.append(level.select("tree", key, F.col("_group").alias(f"k{step}"), f"b{step}"))
        level = level.groupBy("tree", F.col("_group").alias(f"k{step}")).agg(F.sum("n").alias("n"))
        key = f"k{step}"
    upper = sums[-1].select("tree", "k3", F.col("b4").alias("before"))
    for step in (3, 2, 1):
        upper = sums[step - 1].join(upper, ["tree", f"k{step}"]).select("tree", f"k{step - 1}", (F.col("before") + F.col(f"b{step}")).alias("before"))
    return out.join(upper.withColumnRenamed("k0", "word"), ["tree", "word"])


def _places_of_ties(rows: DataFrame) -> DataFrame:
    """``rows`` (tree, doc_id, leaf, fake, first, size) of equal (tree, doc_id)
    with ``pos``: ``first`` and onwards by leaf. Equal rows are counted before
    they are dealt places; windows hold the leaves with one 16-bit prefix, or
    the counts of the prefixes."""
    group = ["tree", "doc_id"]
    counted = written(rows.groupBy(*group, "leaf", "fake", "first", "size").agg(F.count(F.lit(1)).alias("n"))
                      .withColumn("p", F.substring(F.hex("leaf"), 1, 4)), "merkle-ties")
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    prefixes = counted.groupBy(*group, "p").agg(F.sum("n").alias("n")) \
        .select(F.col("tree").alias("t2"), F.col("doc_id").alias("d2"), F.col("p").alias("p2"), earlier(Window.partitionBy(*group).orderBy("p")).alias("b1"))
    inside = counted.withColumn("b2", earlier(Window.partitionBy(*group, "p").orderBy("leaf", "fake")))
    at = inside.join(prefixes, (inside["tree"] == prefixes["t2"]) & inside["doc_id"].eqNullSafe(prefixes["d2"]) & (inside["p"] == prefixes["p2"])) \
        .withColumn("at", F.col("first") + F.col("b1") + F.col("b2"))
    # Equal rows take consecutive places, a thousand at a time.
    thousands = at.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 1000).cast("long"))))
    each = thousands.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(999).cast("long"), F.col("n") - 1 - F.col("k") * 1000))))
    return each.select("tree", (F.col("at") + F.col("k") * 1000 + F.col("j")).alias("pos"), "size", "doc_id", "leaf", "fake")


def placed(rows: DataFrame) -> DataFrame:
    """``tree, pos, size, doc_id, leaf, fake``: each leaf's place in its tree of ``size`` leaves."""
    directory = word_directory(rows.filter("doc_id is not null"))
    sizes = written(rows.groupBy("tree").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("doc_id").isNull()).alias("nulls")), "merkle-sizes")
    directory = written(directory.join(sizes, "tree").select("tree", "word", "bits", "n", (F.col("before") + F.col("nulls")).alias("before"), "size"),
                        "merkle-directory")
    repeats, nulls = directory.agg(F.count_if(F.expr("n > bit_count(bits)"))).first()[0], sizes.agg(F.coalesce(F.sum("nulls"), F.lit(0))).first()[0]
    low = F.expr("~shiftleft(-1L, int(doc_id & 63))")
    below = F.col("before") + F.bit_count(F.col("bits").bitwiseAND(low))
    found = rows.filter("doc_id is not null").withColumn("word", F.shiftright("doc_id", 6)).join(directory, ["tree", "word"])
    columns = ["tree", "pos", "size", "doc_id", "leaf", "fake"]
    if not repeats:
        out = found.withColumn("pos", below).select(*columns)
    else:
        # Words with repeated ids also say how many copies each bit has.
        copies = rows.filter("doc_id is not null").groupBy("tree", "doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        extra = copies.groupBy("tree", F.shiftright("doc_id", 6).alias("word")) \
            .agg(F.collect_list(F.struct("doc_id", (F.col("c") - 1).alias("more"))).alias("extra"))
        found = found.join(extra, ["tree", "word"], "left")
        more = F.aggregate("extra", F.lit(0).cast("long"), lambda s, e: s + F.when(e["doc_id"] < F.col("doc_id"), e["more"]).otherwise(0))
        found = found.withColumn("pos", below + F.coalesce(more, F.lit(0))) \
            .withColumn("tied", F.coalesce(F.exists("extra", lambda e: e["doc_id"] == F.col("doc_id")), F.lit(False)))
        found = written(found.select(*columns, "tied"), "merkle-found")
        out = found.filter("not tied").select(*columns) \
            .unionByName(_places_of_ties(found.filter("tied").withColumnRenamed("pos", "first")).select(*columns))
    if nulls:
        none = rows.filter("doc_id is null").join(sizes.select("tree", "size"), "tree").withColumn("first", F.lit(0).cast("long"))
        out = out.unionByName(_places_of_ties(none).select(*columns))
    return out


def _hash(nodes: list[bytes]) -> bytes:
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def _levels(nodes: list[bytes], whole: bool) -> list[list[bytes]]:
    """The levels above ``nodes``: down to one node if the block is its tree, else exactly ``LEVELS``."""
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= LEVELS:
        out.append([_hash(out[-1][i:i + FAN]) for i in range(0, len(out[-1]), FAN)])
    return out


def _path(levels: list[list[bytes]], at: int) -> list[bytes]:
    """Siblings of the node ``at``, an entry a level: its own slot (one byte), then the others' digests."""
    out = []
    for nodes in levels[:-1]:
        run = nodes[at // FAN * FAN:at // FAN * FAN + FAN]
        out.append(bytes([at % FAN]) + b"".join(run[:at % FAN] + run[at % FAN + 1:]))
        at //= FAN
    return out


def _others(entry: bytes) -> list[bytes]:
    return [entry[i:i + 32] for i in range(1, len(entry), 32)]


def fold(node: bytes, path: list[bytes]) -> bytes:
    """The root that ``node`` leads to with the siblings of ``path``."""
    for entry in path:
        others = _others(entry)
        node = _hash(others[:entry[0]] + [node] + others[entry[0]:])
    return node


def _slots(items: list[dict], name: str) -> list[bytes]:
    """A block's digests, each in its slot."""
    out = [b""] * len(items)
    for x in items:
        out[x["pos"] % BLOCK] = x[name]
    return out


def _blocks(nodes: DataFrame, *payload: str) -> DataFrame:
    """``tree, block, size, items``: at most ``BLOCK`` nodes in an array."""
    item = F.struct("pos", *payload)
    return nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"), "size").agg(F.collect_list(item).alias("items"))


def _reduced(blocks: DataFrame, name: str) -> DataFrame:
    """``tree, pos, size, digest, done``: the node that each block becomes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees, at, sizes, items = (c.to_pylist() for c in batch.columns)
            digests = [_levels(_slots(x, name), n <= BLOCK)[-1][0] for x, n in zip(items, sizes)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(trees, pa.string()), pa.array(at, pa.int64()), pa.array([-(-n // BLOCK) for n in sizes], pa.int64()),
                 pa.array(digests, pa.binary()), pa.array([n <= BLOCK for n in sizes], pa.bool_())], ["tree", "pos", "size", "digest", "done"])

    narrow = blocks.withColumn("items", F.transform("items", lambda x: F.struct(x["pos"].alias("pos"), x[name].alias(name))))
    return narrow.select("tree", "block", "size", "items").mapInArrow(run, "tree string, pos long, size long, digest binary, done boolean")


class Forest:
    """Trees reduced in steps. ``steps`` are the written block tables, the first
    of the given nodes; ``roots`` is ``tree, digest``."""

    def __init__(self, nodes: DataFrame, name: str, *payload: str):
        self.name, self.steps, roots = name, [written(_blocks(nodes, name, *payload), "merkle-blocks")], []
        while True:
            up = written(_reduced(self.steps[-1], name if len(self.steps) == 1 else "digest"), "merkle-nodes")
            roots.append(up.filter("done").select("tree", "digest"))
            more = up.filter("not done")
            if more.isEmpty():
                break
            self.steps.append(written(_blocks(more, "digest"), "merkle-blocks"))
        self.roots = roots[0]
        for r in roots[1:]:
            self.roots = self.roots.unionAll(r)
        self.roots = written(self.roots, "merkle-roots")

    def first_blocks(self, above: DataFrame) -> DataFrame:
        """``size, items, subroot, path``: the first blocks with their nodes' path from the
        block to the very top. ``above`` is ``tree, up`` for the trees' roots."""
        ends = self.roots.join(above, "tree").select("tree", F.col("digest").alias("subroot"), "up")
        paths = None
        for k in range(len(self.steps) - 1, -1, -1):
            # A block that is its tree goes on with the tree's path, others with their node's.
            own = self.steps[k].filter(F.col("size") <= BLOCK).join(ends, "tree").withColumn("path", F.col("up")).drop("up")
            if paths is not None:
                rest = self.steps[k].filter(F.col("size") > BLOCK).join(paths, ["tree", "block"])
                own = own.unionByName(rest)
            if k:
                paths = written(self._paths(own), "merkle-paths")
        return own

    def _paths(self, blocks: DataFrame) -> DataFrame:
        """``tree, block, subroot, path`` for the nodes of the blocks: each node is a block one step below."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[list] = [[], [], [], []]
                for tree, size, items, subroot, path in zip(*(c.to_pylist() for c in batch.columns)):
                    levels = _levels(_slots(items, "digest"), size <= BLOCK)
                    for x in items:
                        for column, value in zip(out, (tree, x["pos"], subroot, _path(levels, x["pos"] % BLOCK) + path)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()),
                                                  pa.array(out[3], pa.list_(pa.binary()))], ["tree", "block", "subroot", "path"])

        return blocks.select("tree", "size", "items", "subroot", "path").mapInArrow(run, "tree string, block long, subroot binary, path array<binary>")


def _tree_places(trees: DataFrame) -> DataFrame:
    """``trees`` (tree, digest) in order with ``pos`` and ``size``: ranges of names,
    sized, and numbered inside a range; no window holds all names."""
    n = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(trees.repartitionByRange(n, "tree").withColumn("part", F.spark_partition_id()), "merkle-trees")
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    parts = parts.select("part", F.sum("n").over(every).alias("size"),
                         F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("tree")) - 1
    return ranged.join(F.broadcast(parts), "part").select(F.lit("").alias("tree"), (F.col("before") + rank).cast("long").alias("pos"), "size",
                                                          "digest", F.col("tree").alias("name"))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row;
    ``tampered`` (a condition on ``doc_id``) says whose line feeds are lost before verifying."""
    spark = docs.sparkSession
    on_workers(spark)
    rows = written(leaves(docs, tampered), "merkle-leaves")
    sources = Forest(placed(rows), "leaf", "doc_id", "fake")
    named = _tree_places(sources.roots)
    top = Forest(named, "digest", "name")
    found = top.roots.first()
    root = bytes(found["digest"]) if found else b""
    nothing = spark.createDataFrame([("", [])], "tree string, up array<binary>")
    blocks = sources.first_blocks(_names(top.first_blocks(nothing)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, items, subroot, above in zip(*(c.to_pylist() for c in batch.columns)):
                levels, out = _levels(_slots(items, "leaf"), size <= BLOCK), []
                for x in items:
                    path = _path(levels, x["pos"] % BLOCK) + above
                    folded = fold(x["fake"] or x["leaf"], path)
                    out.append((x["doc_id"], x["leaf"].hex(), subroot.hex(), root.hex(), _hash([s for e in path for s in _others(e)]).hex(),
                                folded.hex(), folded == root))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], _NAMES)

    return blocks.select("size", "items", "subroot", "path").mapInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


_NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
_TYPES = [pa.int64(), *[pa.string()] * 5, pa.bool_()]


def _names(blocks: DataFrame) -> DataFrame:
    """``tree, up``: each source's path from its subroot to the root."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, paths = [], []
            for size, items, above in zip(*(c.to_pylist() for c in batch.columns)):
                levels = _levels(_slots(items, "digest"), size <= BLOCK)
                names += [x["name"] for x in items]
                paths += [_path(levels, x["pos"] % BLOCK) + above for x in items]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(paths, pa.list_(pa.binary()))], ["tree", "up"])

    return written(blocks.select("size", "items", "path").mapInArrow(run, "tree string, up array<binary>"), "merkle-names")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(read_table(spark, sf_dir, "documents"), F.coalesce(crc32_mod(F.col("doc_id"), 2) == 0, F.lit(False)))


def _oracle_sql(levels: int = 14, source_levels: int = 8) -> str:
    """The manifest in SQL, a step a level: enough for 3^14 leaves a source and 3^8 sources."""
    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"

    def digest(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in (*FIELDS[:-1], text)) + ")"

    def tree(name: str, nodes: str, n: int) -> list[str]:
        """Levels ``{name}k`` (tree, pos, h, n), siblings ``{name}sk`` (tree, pos, l, r) and ``{name}_roots``."""
        out = [f"{name}0 AS (SELECT tree, pos, h, count(*) OVER (PARTITION BY tree) AS n FROM {nodes})"]
        for k in range(n):
            run = "OVER (PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN"
            out.append(f"{name}s{k} AS (SELECT tree, pos, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                       f"coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE n > 1)")
            out.append(f"{name}{k + 1} AS (SELECT tree, pos, h, count(*) OVER (PARTITION BY tree) AS n FROM (SELECT tree, pos // 3 AS pos, "
                       f"sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {name}{k} WHERE n > 1 GROUP BY tree, pos // 3) x)")
        ends = " UNION ALL ".join(f"SELECT tree, h FROM {name}{k} WHERE n = 1" for k in range(n + 1))
        return [*out, f"{name}_roots AS ({ends})"]

    # crc32 by bytes; its table of 256 remainders follows from the polynomial.
    table = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
    bytes_ = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"
    ctes = [f"crc AS (SELECT {table} AS t)",
            f"leaves AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, {digest('text')} AS h, "
            f"CASE WHEN doc_id IS NOT NULL AND {crc} % 2 = 0 THEN {digest(chr(34) + 'plain' + chr(34))} ELSE {digest('text')} END AS fake "
            "FROM (SELECT *, replace(text, chr(10), '') AS plain FROM documents) d, crc)",
            "placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, fake) - 1 AS pos FROM leaves)",
            *tree("a", "placed", levels),
            "sources AS (SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS pos FROM a_roots)",
            *tree("b", "sources", source_levels)]
    rows = ("SELECT p.doc_id, p.h AS leaf, p.fake, a.h AS subroot, b.h AS root, p.tree, p.pos, s.pos AS at FROM placed p "
            "JOIN a_roots a ON p.tree = a.tree JOIN sources s ON s.name = p.tree, b_roots b")
    step = "rows0"
    ctes.append(f"rows0 AS (SELECT *, fake AS folded, '' AS proof FROM ({rows}) x)")
    for name, key, n, on in (("a", "pos", levels, "s.tree = x.tree"), ("b", "at", source_levels, "s.tree = ''")):
        for k in range(n):
            nxt = f"rows_{name}{k}"
            ctes.append(f"{nxt} AS (SELECT x.* REPLACE (CASE WHEN s.l IS NULL THEN x.folded ELSE sha256(s.l || x.folded || s.r) END AS folded, "
                        f"x.proof || coalesce(s.l || s.r, '') AS proof) FROM {step} x LEFT JOIN {name}s{k} s ON {on} AND s.pos = x.{key} // {3 ** k})")
            step = nxt
    return (f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, "
            f"folded = root AS verified FROM {step}")


ORACLE_SQL = _oracle_sql()
