"""2. License scan by ordered signature rules.

A text's words are written one after another, each with a space on both sides,
so that a rule (a regular expression over such words) matches whole words only
and a match's place in words is half the spaces before it. The rules are
hand-written sentence forms, applied to a table of license names: grants and
SPDX tags (priority 1), full names (2), and mentions (3). A cheap expression
decides which texts are looked at; a rule runs only where its keyword stands.

Overlaps: a detection inside another of equal or better priority is dropped
(of two on the same words, the later in (priority, rule) order). Partial
overlaps both stay.

Everything happens in the row with Spark functions: no shuffle, no Python.

Cases: null and empty text have no words and no detections; a match may repeat
and every place counts; repeated rows are scanned one by one; other columns are
ignored; an empty table gives an empty result; long texts are scanned whole.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revisio.functions.text import materialize
from revisio.llm.common import ALNUM_WORD, LOWER, UPPER, lower_ascii, read_table

# Fixed values of the contract: phrase -> label.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# label: (names, versions that must follow, words by which the license is tagged)
LICENSES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "mit": (("mit", "expat"), (), ("mit",)),
    "mit-0": (("mit no attribution",), (), ("mit 0",)),
    "x11": (("x11",), (), ("x11",)),
    "isc": (("isc", "internet systems consortium"), (), ("isc",)),
    "zlib": (("zlib", "zlib libpng"), (), ("zlib",)),
    "apache-1.1": (("apache software", "apache"), ("1 1",), ("apache 1 1",)),
    "apache-2": (("apache software", "apache"), ("2 0", "2"), ("apache 2 0",)),
    "bsd-2": (("bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"), (), ("bsd 2 clause",)),
    "bsd-3": (("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd"), (), ("bsd 3 clause",)),
    "bsd-4": (("bsd 4 clause", "4 clause bsd", "original bsd"), (), ("bsd 4 clause",)),
    "0bsd": (("zero clause bsd", "0bsd"), (), ("0bsd",)),
    "gpl-2": (("gnu general public", "gnu gpl", "gpl"), ("2 0", "2"), ("gpl 2 0 only", "gpl 2 0 or later", "gpl 2 0")),
    "gpl-3": (("gnu general public", "gnu gpl", "gpl"), ("3 0", "3"), ("gpl 3 0 only", "gpl 3 0 or later", "gpl 3 0")),
    "lgpl-2.1": (("gnu lesser general public", "gnu lgpl", "lgpl"), ("2 1",), ("lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 2 1")),
    "lgpl-3": (("gnu lesser general public", "gnu lgpl", "lgpl"), ("3 0", "3"), ("lgpl 3 0 only", "lgpl 3 0 or later", "lgpl 3 0")),
    "agpl-3": (("gnu affero general public", "gnu agpl", "agpl"), ("3 0", "3"), ("agpl 3 0 only", "agpl 3 0 or later", "agpl 3 0")),
    "gfdl-1.2": (("gnu free documentation", "gfdl"), ("1 2",), ("gfdl 1 2",)),
    "gfdl-1.3": (("gnu free documentation", "gfdl"), ("1 3",), ("gfdl 1 3",)),
    "mpl-1.1": (("mozilla public", "mpl"), ("1 1",), ("mpl 1 1",)),
    "mpl-2": (("mozilla public", "mpl"), ("2 0", "2"), ("mpl 2 0",)),
    "epl-1": (("eclipse public", "epl"), ("1 0", "1"), ("epl 1 0",)),
    "epl-2": (("eclipse public", "epl"), ("2 0", "2"), ("epl 2 0",)),
    "eupl-1.2": (("european union public", "eupl"), ("1 2",), ("eupl 1 2",)),
    "cddl-1": (("common development and distribution", "cddl"), ("1 0", "1 1", "1"), ("cddl 1 0", "cddl 1 1")),
    "cpl-1": (("common public",), ("1 0", "1"), ("cpl 1 0",)),
    "artistic-1": (("artistic",), ("1 0", "1"), ("artistic 1 0",)),
    "artistic-2": (("artistic",), ("2 0", "2"), ("artistic 2 0",)),
    "boost-1": (("boost software", "boost"), (), ("bsl 1 0",)),
    "unlicense": (("unlicense",), (), ("unlicense",)),
    "wtfpl": (("do what the fuck you want to public", "wtfpl"), (), ("wtfpl",)),
    "psf-2": (("python software foundation", "psf"), (), ("psf 2 0", "python 2 0")),
    "postgresql": (("postgresql",), (), ("postgresql",)),
    "ncsa": (("university of illinois ncsa open source", "ncsa open source"), (), ("ncsa",)),
    "openssl": (("openssl",), (), ("openssl",)),
    "php-3": (("php",), ("3 01", "3 0"), ("php 3 01", "php 3 0")),
    "ms-pl": (("microsoft public",), (), ("ms pl",)),
    "ms-rl": (("microsoft reciprocal",), (), ("ms rl",)),
    "ofl-1.1": (("sil open font", "open font"), (), ("ofl 1 1",)),
    "afl-3": (("academic free",), ("3 0", "3"), ("afl 3 0",)),
    "osl-3": (("open software",), ("3 0", "3"), ("osl 3 0",)),
    "odbl": (("open database", "odbl"), (), ("odbl 1 0",)),
    "cc0": (("cc0", "creative commons zero", "cc zero"), (), ("cc0 1 0",)),
    "cc-by": (("cc by", "creative commons attribution"), (), ("cc by 4 0", "cc by 3 0")),
    "cc-by-sa": (("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"), (), ("cc by sa 4 0", "cc by sa 3 0")),
    "cc-by-nd": (("cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs"), (), ("cc by nd 4 0", "cc by nd 3 0")),
    "cc-by-nc": (("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"), (), ("cc by nc 4 0", "cc by nc 3 0")),
    "cc-by-nc-sa": (("cc by nc sa", "creative commons attribution noncommercial sharealike"), (), ("cc by nc sa 4 0", "cc by nc sa 3 0")),
    "cc-by-nc-nd": (("cc by nc nd", "creative commons attribution noncommercial noderivatives"), (), ("cc by nc nd 4 0", "cc by nc nd 3 0")),
    "public-domain": (("public domain",), (), ("public domain",)),
}


@dataclass(frozen=True)
class Signature:
    pattern: str
    keyword: str
    label: str
    priority: int
    weight: float
    base: bool = False


def seq(words: str) -> str:
    """The words one after another, as they stand in a spaced text."""
    return "".join(f" {w} " for w in words.split())


def one_of(*phrases: str) -> str:
    return "(?:" + "|".join(seq(p) for p in sorted(phrases, key=lambda p: (-len(p.split()), p))) + ")"


def maybe(*phrases: str) -> str:
    return one_of(*phrases) + "?"


_LICENSE = one_of("license", "licence")
_GRANT = one_of("licensed", "released", "distributed", "available", "published", "provided", "covered", "offered", "redistributed",
                "licenced", "dedicated", "placed")
_UNDER = one_of("under", "under the terms of", "subject to", "according to", "in accordance with", "to", "in", "into")
_ARTICLE = maybe("the", "a", "an", "version of the")
_SEE = one_of("see", "read", "refer to", "consult", "a copy of", "copy of")


# Words that point to a license without the word "license" beside them: each is
# a necessary part of the names that hold it, and rare in ordinary text.
TELLING = ("gpl", "apache", "cc by", "cc0", "cc zero", "creative commons", "public domain", "wtfpl", "unlicense", "eupl", "cddl")
OTHER = {"all rights reserved": "copyright", "copyright notice": "copyright",
         "without warranty of any kind": "no-warranty", "without any warranty": "no-warranty"}


def signatures() -> list[Signature]:
    """All rules, in order: the contract's phrases, then up to four sentence
    forms for each license name, its tags, and a few general notices. Names
    that are ordinary words need "license" beside them in every form."""
    out = [Signature(seq(p), seq(p), label, 2, 1.0, True) for p, label in BASE_PHRASES.items()]
    for label, (names, versions, tags) in LICENSES.items():
        for name in names:
            body, telling = seq(name), any(t in name for t in TELLING)
            word = maybe("license", "licence", "public license") if telling else _LICENSE
            number = one_of(*versions, *[f"v{v}" for v in versions]) if versions else maybe("4 0", "3 0", "2 5", "2 0", "1 0")
            named = body + word + maybe("version", "v", "agreement version") + number
            rules = [(_GRANT + _UNDER + _ARTICLE + named, 1, 1.0),
                     (body + _LICENSE + maybe("version", "v") + number, 2, 0.9),
                     (_SEE + _ARTICLE + named + one_of("for details", "for more details", "for the full text", "text", "file"), 2, 0.8)]
            if telling:
                rules.append((body + number, 3, 0.6))
            out += [Signature(p, body, label, prio, w) for p, prio, w in rules]
        out += [Signature(seq("spdx license identifier") + seq(tag), seq(tag), label, 1, 1.0) for tag in tags]
    return out + [Signature(seq(p), seq(p), label, 3, 0.3) for p, label in OTHER.items()]


# Any run of characters that are not in words.
_PART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def gate(text: Column) -> Column:
    """Necessary for any rule to match: every rule holds the word "license" (or
    its other spelling), one of the telling words, or a general notice."""
    hints = ["licen[sc]e", *[w.replace(" ", _PART) for w in (*TELLING, *OTHER, *BASE_PHRASES)]]
    return text.rlike("(?i)(?:" + "|".join(hints) + ")")


def spaced(text: Column) -> Column:
    """The text's words, lower-cased, each between two spaces."""
    words = F.regexp_replace(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  ")
    return F.regexp_replace(F.concat(F.lit("  "), words, F.lit("  ")), r"^ +| +$", " ")


def _n_words(c: Column) -> Column:
    """Half the spaces: words in a piece of spaced text."""
    return F.expr("0") + F.floor((F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))) / 2).cast("int")


def _places(norm: Column, rule: Column) -> Column:
    """The rule's detections: start and end in words, in order."""
    found = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    between = F.split(norm, rule["pattern"], -1)
    sizes = F.zip_with(F.slice(between, 1, F.size(found)), found,
                       lambda p, m: F.struct(_n_words(p).alias("gap"), _n_words(m).alias("size")))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(
        sizes, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"),
                                                  (acc["at"] + x["gap"] + x["size"]).alias("end")))).alias("out")),
        lambda acc: acc["out"])


def license_scan(docs: DataFrame, rules: list[Signature] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: words, base detections, labels, score, and the surviving detections."""
    rules = signatures() if rules is None else rules
    table = F.array(*[F.struct(F.lit(s.pattern).alias("pattern"), F.lit(s.keyword).alias("keyword"), F.lit(s.label).alias("label"),
                               F.lit(s.priority).alias("priority"), F.lit(s.weight).alias("weight"), F.lit(s.base).alias("base"),
                               F.lit(i).alias("rule")) for i, s in enumerate(rules)])
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    df = docs.select(docs[id_col].alias("doc_id"), text.alias("_text"))
    either = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the word pattern before lower-casing
    df = materialize(df.withColumn("n_words", F.regexp_count("_text", F.lit(either)).cast("long")),
                     {"_norm": F.when(gate(F.col("_text")), spaced(F.col("_text")))})
    norm = F.col("_norm")
    found = F.when(norm.isNotNull(), F.flatten(F.transform(
        F.filter(table, lambda r: F.contains(norm, r["keyword"])),
        lambda r: F.transform(_places(norm, r), lambda p: F.struct(
            p["start"].alias("start"), (-p["end"]).alias("back"), r["priority"].alias("priority"), r["rule"].alias("rule"),
            r["label"].alias("label"), r["weight"].alias("weight"), r["base"].alias("base"))))))
    df = materialize(df.select("doc_id", "n_words", "_norm"), {"_found": F.array_sort(found)})
    df = df.select("doc_id", "n_words", "_found")
    # In order of start, longest first: a detection is inside an earlier one iff
    # the furthest end so far, among equal or better priorities, reaches its end.
    f = F.col("_found")
    kept_type = "array<struct<start:int,end:int,label:string,weight:double>>"
    sweep = F.aggregate(
        F.filter(f, lambda d: ~d["base"]),
        F.struct(F.lit(-1).alias("e1"), F.lit(-1).alias("e2"), F.lit(-1).alias("e3"), F.array().cast("array<string>").alias("labels"),
                 F.lit(0.0).alias("weight"), F.lit(0).alias("kept")),
        lambda acc, d: _step(acc, d))
    df = materialize(df, {"_kept": sweep, "_base": F.filter(f, lambda d: d["base"])})
    b, k = F.col("_base"), F.col("_kept")
    base_labels = F.array_sort(F.array_distinct(F.transform(b, lambda d: d["label"])))
    none = F.array().cast("array<string>")
    base_labels, own = F.coalesce(base_labels, none), F.coalesce(k["labels"], none)
    n_base = F.coalesce(F.size(b), F.lit(0))
    n_base = F.when(n_base > 0, n_base).otherwise(0)
    return df.select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"),
        F.array_min(F.transform(b, lambda d: d["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(b, lambda d: d["start"])).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, own)), ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce(k["weight"], F.lit(0.0))).alias("score"),
        F.coalesce(k["kept"], F.lit(0)).cast("long").alias("n_detections"))


def _step(acc: Column, d: Column) -> Column:
    end, p = -d["back"], d["priority"]
    reach = F.when(p == 1, acc["e1"]).when(p == 2, F.greatest(acc["e1"], acc["e2"])).otherwise(F.greatest(acc["e1"], acc["e2"], acc["e3"]))
    stays = reach < end

    def far(level: int) -> Column:
        now = acc[f"e{level}"]
        return F.when(p == level, F.greatest(now, end)).otherwise(now).alias(f"e{level}")

    return F.struct(far(1), far(2), far(3),
                    F.when(stays, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"),
                    F.when(stays, F.greatest(acc["weight"], d["weight"])).otherwise(acc["weight"]).alias("weight"),
                    (acc["kept"] + F.when(stays, 1).otherwise(0)).alias("kept"))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same result as DuckDB SQL: rules by rules over whole texts, no gate,
    and containment by comparing the detections of a document with each other."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    values = ",\n".join(f"({i}, {q(s.pattern)}, {q(s.label)}, {s.priority}, {s.weight}, {str(s.base).lower()})" for i, s in enumerate(signatures()))
    return f"""
WITH rules(rule, pattern, label, priority, weight, base) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {q(ALNUM_WORD)}) AS w FROM documents),
n AS (SELECT k, doc_id, len(w) AS n_words, array_to_string(list_transform(w, lambda x: ' ' || x || ' '), '') AS norm FROM d),
hit AS (SELECT k, rule, label, priority, weight, base, regexp_extract_all(norm, pattern) AS m, string_split_regex(norm, pattern) AS p
        FROM n, rules WHERE regexp_matches(norm, pattern)),
place AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hit),
cnt AS (SELECT k, rule, label, priority, weight, base,
               (len(array_to_string(p[1:i], '')) - len(replace(array_to_string(p[1:i], ''), ' ', ''))
                + coalesce(len(array_to_string(m[1:i-1], '')) - len(replace(array_to_string(m[1:i-1], ''), ' ', '')), 0)) // 2 AS s,
               (len(m[i]) - len(replace(m[i], ' ', ''))) // 2 AS size FROM place),
det AS (SELECT *, s + size AS e FROM cnt),
kept AS (SELECT * FROM det a WHERE NOT base AND NOT EXISTS (
    SELECT 1 FROM det b WHERE b.k = a.k AND NOT b.base AND b.priority <= a.priority AND b.s <= a.s AND b.e >= a.e
      AND (b.s < a.s OR b.e > a.e OR b.priority < a.priority OR (b.priority = a.priority AND b.rule < a.rule)))),
bases AS (SELECT k, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, list(DISTINCT label) AS ls FROM det WHERE base GROUP BY k),
own AS (SELECT k, list(DISTINCT label) AS ls, max(weight) AS weight, count(*) AS c FROM kept GROUP BY k)
SELECT n.doc_id, n.n_words::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(bases.ls), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bases.ls, []), coalesce(own.ls, [])))), ','), '') AS labels,
       (CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(weight, 0.0) END)::DOUBLE AS score, coalesce(c, 0)::BIGINT AS n_detections
FROM n LEFT JOIN bases USING (k) LEFT JOIN own USING (k)"""


ORACLE_SQL = _sql()
