"""10. Preference formatting of conversations.

A pair has a chosen and a rejected conversation. Their longest common prefix of
turns (same place, role and text) is rendered once as the prompt; what follows
is rendered for each side as its completion. Completions are masked: only the
assistant's turns bear loss, everything else in them is context.

The result is one row for each rendered turn, so that a conversation of any
length, or one that takes part in many pairs, is never gathered in one task:
common prefixes come from a join by (pair, place) and a minimum over the places
that differ. ``assemble`` joins the rows of a side into one text, for
conversations that are known to fit a row.

Cases: exactly repeated turn rows count once; several turns with the same
number stand in the order of role and text; turn rows without a conv_id or
without a turn number have no place and are dropped, so a conversation with no
numbered turn gives no row; null role or text is rendered as empty text; the marks of the template are broken up inside texts; if one side
is a prefix of the other, its completion has no rows; equal conversations give
a prompt and no completions; pairs that name a missing conversation give no
rows for it; other columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revisio.llm.common import read_table, written

#: Conversations of shared openings that one range holds, about.
GROUP_ROWS = 100_000
#: Openings that several conversations share (about 60 bytes each) that are broadcast.
MAX_GROUPS = 200_000
_OPEN, _SHUT = "<|", "|>"


def _clean(c: Column) -> Column:
    return F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit(_OPEN), F.lit("< |"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv, turn, seq, role, text``: distinct turns, with a place for ties."""
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
                                _clean(F.col("role")).alias("role"), _clean(F.col("text")).alias("text")) \
        .filter("conv is not null and turn is not null").distinct()
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("conv", "turn").orderBy("role", "text")) - 1)


def header(role: Column) -> Column:
    return F.concat(F.lit(_OPEN), role, F.lit(f"{_SHUT}\n"))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``pair_id, part, turn, seq, role, text, loss_from, loss_to`` from two
    tables of turns ``pair_id, turn, seq, role, text``.

    ``part`` is prompt, chosen or rejected. ``loss_from`` and ``loss_to`` bound
    the characters of ``text`` that bear loss (the assistant's words and the
    closing mark); both are 0 where none do.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("pair_id", "turn", "seq", F.struct("role", "text").alias(name))

    both = side(chosen, "c").join(side(rejected, "r"), ["pair_id", "turn", "seq"], "full_outer")
    at = F.struct("turn", "seq")
    split = both.groupBy("pair_id").agg(F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), at)).alias("split"))
    shared = F.col("split").isNull() | (at < F.col("split"))
    sides = F.filter(F.array(
        F.struct(F.lit("chosen").alias("part"), F.col("c").alias("m")),
        F.struct(F.lit("rejected").alias("part"), F.col("r").alias("m"))), lambda x: x["m"].isNotNull())
    parts = F.when(shared, F.array(F.struct(F.lit("prompt").alias("part"), F.col("c").alias("m")))).otherwise(sides)
    rows = both.join(split, "pair_id").select("pair_id", "turn", "seq", F.inline(parts))
    role, head = F.col("m.role"), header(F.col("m.role"))
    text = F.concat(head, F.col("m.text"), F.lit(f"\n{_OPEN}end{_SHUT}\n"))
    loss = (F.col("part") != "prompt") & (role == "assistant")
    return rows.select("pair_id", "part", "turn", F.col("seq").cast("long").alias("seq"), role.alias("role"), text.alias("text"),
                       F.when(loss, F.length(head)).otherwise(0).cast("long").alias("loss_from"),
                       F.when(loss, F.length(text) - 1).otherwise(0).cast("long").alias("loss_to"))


def assemble(formatted: DataFrame) -> DataFrame:
    """One row for each pair and part, for conversations that fit a row: the
    whole text and the loss spans in its characters."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "seq", "text", "loss_from", "loss_to")))
    spans = F.aggregate("rows", F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("s")),
                        lambda acc, x: F.struct((acc["n"] + F.length(x["text"])).cast("long").alias("n"), F.when(
                            x["loss_to"] > 0, F.concat(acc["s"], F.array(F.struct((acc["n"] + x["loss_from"]).alias("a"), (acc["n"] + x["loss_to"]).alias("b")))))
                            .otherwise(acc["s"]).alias("s")), lambda acc: acc["s"])
    return formatted.groupBy("pair_id", "part").agg(rows.alias("rows")) \
        .select("pair_id", "part", F.array_join(F.transform("rows", lambda x: x["text"]), "").alias("text"), spans.alias("loss"))


def preference_pairs(turns: DataFrame, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns (``pair_id, turn, seq, role, text``) out of plain conversations.

    * Conversations that open with the same turn answer the same request: they
      are paired two by two in the order of their ids; an odd last one is paired
      with the one before it, which then stands in two pairs. The one in which
      the assistant writes more is chosen (ties: the smaller id). ``pair_id`` is
      ``<chosen>-<rejected>``.
    * Every conversation with an assistant turn is also chosen against its own
      copy whose last such turn breaks off after half its characters.
      ``pair_id`` is ``<id>-cut``.
    * A conversation without an assistant turn has no copy; if no other opens
      like it either, it is in no pair and gives no row.

    Places in a group come from the rows' order by (opening, id): rows are dealt
    into ranges, numbered inside them, and the ranges' sizes are summed by
    opening, so that a group of any size and any ids is spread.
    """
    first = turns.groupBy("conv").agg(
        F.min(F.struct("turn", "seq", "role", "text")).alias("f"),
        F.sum(F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)).alias("said"),
        F.max(F.when(F.col("role") == "assistant", F.struct("turn", "seq"))).alias("last"))
    first = written(first.select("conv", "said", "last", F.md5(F.concat("f.role", F.lit("\n"), "f.text").cast("binary")).alias("key")), "openings")
    groups = written(first.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared-openings")
    n_groups, n_rows = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    opened = first.select("conv", "said", "key").join(F.broadcast(groups) if n_groups <= MAX_GROUPS else groups, "key")
    ranges = max(1, -(-n_rows // group_rows), min(n_rows, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # Range bounds are sampled, so the dealt rows are written before anything is counted.
    dealt = written(opened.repartitionByRange(ranges, "key", "conv").withColumn("bucket", F.spark_partition_id()), "dealt-openings")
    sizes = dealt.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("m"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("key", "bucket", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("start"))
    own = Window.partitionBy("key", "bucket").orderBy("conv")
    ranked = dealt.join(starts, ["key", "bucket"]).withColumn("i", F.col("start") + F.row_number().over(own) - 1)
    pair = F.expr("i div 2")
    places = F.when((F.col("n") % 2 == 1) & (F.col("i") == F.col("n") - 2), F.array(pair, pair + 1)).otherwise(F.array(pair))
    two = ranked.select("conv", "said", "key", F.explode(places).alias("pair")).groupBy("key", "pair").agg(
        F.max_by("conv", F.struct("said", -F.col("conv"))).alias("chosen"),
        F.min_by("conv", F.struct("said", -F.col("conv"))).alias("rejected"))
    pair_id = F.concat_ws("-", "chosen", "rejected")
    natural = two.select(pair_id.alias("pair_id"), F.inline(F.array(
        F.struct(F.col("chosen").alias("conv"), F.lit(True).alias("is_chosen")),
        F.struct(F.col("rejected").alias("conv"), F.lit(False).alias("is_chosen"))))).withColumn("cut", F.lit(None).cast("struct<turn:bigint,seq:int>"))
    broken = first.filter("last is not null").select(
        F.concat(F.col("conv").cast("string"), F.lit("-cut")).alias("pair_id"), "conv", F.explode(F.array(F.lit(True), F.lit(False))).alias("is_chosen"),
        F.col("last").cast("struct<turn:bigint,seq:int>").alias("cut"))
    rows = turns.join(natural.unionByName(broken), "conv")
    cut_here = ~F.col("is_chosen") & F.coalesce(F.struct(F.col("turn"), F.col("seq")) == F.col("cut"), F.lit(False))
    text = F.when(cut_here, F.expr("substring(text, 1, length(text) div 2)")).otherwise(F.col("text"))
    rows = rows.select("pair_id", "is_chosen", "turn", "seq", "role", text.alias("text"))
    return rows.filter("is_chosen").drop("is_chosen"), rows.filter("not is_chosen").drop("is_chosen")


def op10_preference_format(spark, sf_dir: str) -> DataFrame:
    turns = written(turns_of(read_table(spark, sf_dir, "conversations")), "turns")
    return format_preferences(*preference_pairs(turns))


ORACLE_SQL = """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv, turn ORDER BY role, text) - 1 AS seq FROM (
    SELECT DISTINCT conv_id AS conv, turn, replace(coalesce(role, ''), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
f AS (SELECT conv, arg_min(role || chr(10) || text, turn * 1000000 + seq) AS opening,
             sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS said,
             max(turn * 1000000 + seq) FILTER (role = 'assistant') AS last FROM t GROUP BY conv),
g AS (SELECT conv, said, opening, row_number() OVER (PARTITION BY opening ORDER BY conv) - 1 AS i, count(*) OVER (PARTITION BY opening) AS n FROM f),
r AS (SELECT conv, said, opening, i // 2 AS pair FROM g WHERE n > 1
      UNION ALL SELECT conv, said, opening, i // 2 + 1 FROM g WHERE n > 1 AND n % 2 = 1 AND i = n - 2),
two AS (SELECT opening, pair, list(conv ORDER BY said DESC, conv) AS cs FROM r GROUP BY 1, 2),
p AS (SELECT cs[1] || '-' || cs[2] AS pair_id, unnest([cs[1], cs[2]]) AS conv, unnest([true, false]) AS is_chosen, NULL::BIGINT AS cut FROM two
      UNION ALL SELECT conv || '-cut', conv, unnest([true, false]), last FROM f WHERE last IS NOT NULL),
m AS (SELECT pair_id, is_chosen, turn, seq, role,
             CASE WHEN NOT is_chosen AND turn * 1000000 + seq = cut THEN substr(text, 1, length(text) // 2) ELSE text END AS text FROM t JOIN p USING (conv)),
j AS (SELECT pair_id, turn, seq, c.role AS crole, c.text AS ctext, r.role AS rrole, r.text AS rtext
      FROM (SELECT * FROM m WHERE is_chosen) c FULL JOIN (SELECT * FROM m WHERE NOT is_chosen) r USING (pair_id, turn, seq)),
s AS (SELECT *, min(CASE WHEN crole IS DISTINCT FROM rrole OR ctext IS DISTINCT FROM rtext THEN turn * 1000000 + seq END) OVER (PARTITION BY pair_id) AS brk FROM j),
o AS (SELECT pair_id, 'prompt' AS part, turn, seq, crole AS role, ctext AS body FROM s WHERE brk IS NULL OR turn * 1000000 + seq < brk
      UNION ALL SELECT pair_id, 'chosen', turn, seq, crole, ctext FROM s WHERE turn * 1000000 + seq >= brk AND ctext IS NOT NULL
      UNION ALL SELECT pair_id, 'rejected', turn, seq, rrole, rtext FROM s WHERE turn * 1000000 + seq >= brk AND rtext IS NOT NULL)
SELECT pair_id, part, turn, seq::BIGINT AS seq, role, '<|' || role || '|>' || chr(10) || body || chr(10) || '<|end|>' || chr(10) AS text,
       (CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(role) + 5 ELSE 0 END)::BIGINT AS loss_from,
       (CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(role) + 5 + length(body) + 8 ELSE 0 END)::BIGINT AS loss_to
FROM o"""
