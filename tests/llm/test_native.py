"""License scan, quality rules, decontamination and chat formatting."""
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from pyspark.sql import functions as F
from revisio.llm import quality_rules as Q
from revisio.llm.chat import assemble, format_preferences, op10_preference_format, preference_pairs, turns_of
from revisio.llm.decontamination import contamination, decontaminate, item_windows, find_hits, remove_contaminated
from revisio.llm.licenses import gate, license_scan, signatures

LICENSES = [
    ("Released under the MIT License.", "mit", "mit", 1, 1),
    ("Licensed under the Apache License, Version 2.0.", "apache-2", "apache-2", 1, 3),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc", "cc-by-nc", 1, 2),
    ("cc by nc sa", "cc-by-nc", "cc-by-nc,cc-by-nc-sa", 1, 0),
    ("CC_BY...NC, cc\nby nc", "cc-by-nc", "cc-by-nc", 2, 0),
    ("This work is licensed under the GNU General Public License, version 3.", "", "gpl-3", 0, None),
    ("SPDX-License-Identifier: MPL-2.0", "", "mpl-2", 0, None),
    ("under the mit licensed", "", "", 0, None),
    ("sunder the mit license", "", "mit", 0, None),
    ("nothing here", "", "", 0, None), ("", "", "", 0, None), (None, "", "", 0, None), ("...", "", "", 0, None),
]


def test_licenses(spark):
    docs = spark.createDataFrame([(i, t, "clash", 1.0) for i, (t, *_) in enumerate(LICENSES)] * 2, "doc_id long, text string, labels string, score double")
    rows = license_scan(docs).collect()
    assert len(rows) == 2 * len(LICENSES)
    for r in rows:
        text, base, labels, n, first = LICENSES[r.doc_id]
        assert (r.base_labels, r.n_base, r.first_word) == (base, n, first), r
        assert r.n_words == len(brute.ALNUM_WORD.findall(brute.lower_ascii(text or "")))
        assert set(base.split(",")) - {""} <= set(r.labels.split(",")) and r.labels == labels, r
        assert 0 <= r.score <= 1
    assert license_scan(docs.limit(0)).count() == 0


def test_places_of_repeated_phrases(spark):
    text = "x " * 5000 + "under the mit license " * 300 + "Apache License Version 2"
    r = license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (6204, 301, 5000, 6200)


def test_every_rule_passes_the_gate(spark):
    from pyspark.sql import functions as F
    rules = signatures()
    assert len(rules) >= 200
    # The shortest text that a rule is meant for: first alternatives, no options.
    import re
    texts = []
    for s in rules:
        p = s.pattern
        while True:
            q = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\?", "", p)
            q = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(?!\?)", r"\1", q)
            if q == p:
                break
            p = q
        texts.append((s.label, " ".join(p.split())))
    df = spark.createDataFrame(texts, "label string, text string")
    assert [r.text for r in df.filter(~gate(F.col("text"))).collect()] == []
    found = license_scan(df.withColumnRenamed("label", "doc_id")).collect()
    assert [r for r in found if r.doc_id not in r.labels.split(",")] == []


WORDS = st.lists(st.sampled_from(["a", "b", "the", "#x", "é", "<|>", "\n", " ", "\t", "\x1c", "$$", "\n\n"]), max_size=60)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [None, "", " \n\t", "a", "a b c d e a b c d e", "x\n\nx\n \nx", "a b c d e " * 4000, "é\x1cé \xa0 z"]
    pool = ["a", "b", "the", "#x", "é", "<|>", "\n", "\t", "\x1c", "$$", "\n\n"]
    for _ in range(300):
        out.append(" ".join(rng.choice(pool) for _ in range(rng.randrange(60))))
    return out


def test_quality_statistics(spark, texts):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = Q.quality_rules(docs, labels).collect()
    assert len(rows) == len(texts)
    for r in rows:
        e = brute.quality_stats(texts[r.doc_id])
        assert {k: r[k] for k in e} == e, texts[r.doc_id]
        failed = e["n_words"] < 10 or 100 * e["n_repeat_words"] > 20 * e["n_words"]
        assert (r.base_failed, r.kept, r.rule) == (failed, not failed, None)


def _labelled(spark, n=600):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 60))]
        bad = i % 4 == 0
        if bad:
            words = [w + "!!" for w in words] if i % 8 else [w.upper() for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1, 9))
    labels += [(1, None, 1), (3, 7, 1), (10**6, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, n_words int")


def test_learned_rules(spark):
    docs, labels = _labelled(spark)
    stats = Q.with_stats(docs).drop("text").cache()
    rules = Q.learn_rules(stats, labels)
    assert 2 <= len(rules) <= Q.MAX_RULES
    rows = Q.quality_rules(docs, labels).collect()
    assert all(r.kept == (r.doc_id % 4 != 0) for r in rows if not r.base_failed)
    # The list means what its rules say, the first match first.
    values = {r.doc_id: r._stats for r in stats.collect()}
    for r in rows:
        hit = [i for i, rule in enumerate(rules, 1) if all((values[r.doc_id][c.stat] >= c.threshold) == c.at_least for c in rule)]
        assert r.rule == (hit[0] if hit else None)
    kept = Q.apply_rules(docs.selectExpr("text", "doc_id", "'k' as kept"), rules)
    assert kept.columns == ["text", "doc_id", "kept"] and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}
    assert Q.quality_rules(docs.limit(0), labels).count() == 0


def test_best_condition_by_hand():
    counts = [("upper_share", 0, False, 10), ("upper_share", 3, True, 6), *[(k, 0, low, n) for k in Q.GRID if k != "upper_share" for low, n in ((True, 6), (False, 10))]]
    best = Q._best_condition(counts, 5)
    assert (best.stat, best.at_least, best.threshold) == ("upper_share", True, Q.GRID["upper_share"][0])


def _contaminated(seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(8)] + ["Ünder", "Zulu"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 3, 5, 12, 13, 14, 30])))) for i in range(25)] + [(99, None), (98, "..")]
    items.append((50, items[3][1]))
    docs = []
    for i in range(60):
        words = [rng.choice(pool) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = (items[rng.randrange(25)][1] or "").upper().split()
        docs.append((i, "-, ".join(words)))
    docs += [(7, docs[7][1]), (7, "another " + (items[5][1] or "")), (None, items[9][1]), (200, None), (201, "")]
    return docs, items


@pytest.mark.parametrize("limit", [100_000, 0])
def test_contamination_by_brute_force(spark, limit):
    docs, items = _contaminated(limit + 1)
    d = spark.createDataFrame([(*r, "c", 1) for r in docs], "doc_id long, text string, item_id string, n_words int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    expect = sorted(((doc, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0 and 20 * hit >= n)
                     for doc, n, hit, ids in brute.contamination(docs, items)), key=str)
    if limit:
        assert sorted((tuple(r) for r in decontaminate(d, b).collect()), key=str) == expect
        kept = remove_contaminated(d, b)
        assert kept.columns == d.columns and sorted([r.doc_id for r in kept.collect()], key=str) == sorted([e[0] for e in expect if not e[5]], key=str)
    windows, _ = item_windows(b)
    hits = {tuple(r) for r in find_hits(d, windows, max_broadcast=limit).collect()}
    assert hits == {tuple(r) for r in find_hits(d, windows).collect()} and hits
    assert sorted([r.n_hit for r in contamination(d, b, limit).collect() if r.n_hit]) == sorted({(e[0], e[2], e[1], e[4]): e[2] for e in expect if e[2]}.values())


def test_no_benchmark_and_no_documents(spark):
    docs, items = _contaminated(1)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.n_hit, r.contaminated) for r in decontaminate(d, b.limit(0)).collect()} == {(0, False)}
    assert decontaminate(d.limit(0), b).count() == 0


def _turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")


def test_preference_format(spark):
    rows = [(1, 0, "user", "Hi", 0), (1, 1, "assistant", "Hello <|end|>", 0), (1, 2, "user", "More", 0), (1, 3, "assistant", "abcd", 0),
            (2, 0, "user", "Hi", 0), (2, 1, "assistant", "Hello <|end|>", 0), (2, 2, "user", "Other", 0), (2, 3, "assistant", "x", 0),
            (2, 3, "assistant", "x", 0), (3, 0, "user", None, 0), (4, 0, "assistant", "", 0), (4, 0, None, "tie", 0), (None, 0, "user", "q", 0)]
    turns = turns_of(_turns(spark, rows))
    got = {}
    for r in format_preferences(*preference_pairs(turns)).collect():
        got.setdefault((r.pair_id, r.part), []).append((r.turn, r.seq, r.text, r.loss_from, r.loss_to))
    assert sorted(got) == sorted([("1-2", "prompt"), ("1-2", "chosen"), ("1-2", "rejected"), ("1-cut", "prompt"), ("1-cut", "chosen"), ("1-cut", "rejected"),
                                  ("2-cut", "prompt"), ("2-cut", "chosen"), ("2-cut", "rejected"), ("4-cut", "prompt")])
    assert sorted(got["1-2", "prompt"]) == [(0, 0, "<|user|>\nHi\n<|end|>\n", 0, 0), (1, 0, "<|assistant|>\nHello < |end|>\n<|end|>\n", 0, 0)]
    assert sorted(got["1-2", "chosen"]) == [(2, 0, "<|user|>\nMore\n<|end|>\n", 0, 0), (3, 0, "<|assistant|>\nabcd\n<|end|>\n", 14, 26)]
    assert sorted(got["1-cut", "rejected"]) == [(3, 0, "<|assistant|>\nab\n<|end|>\n", 14, 24)]
    whole = {(r.pair_id, r.part): (r.text, [tuple(s) for s in r.loss]) for r in assemble(format_preferences(*preference_pairs(turns))).collect()}
    text, loss = whole["1-2", "chosen"]
    assert [text[a:b] for a, b in loss] == ["abcd\n<|end|>"]


def test_equal_and_prefix_conversations(spark):
    t = "pair_id string, turn long, seq int, role string, text string"
    a = spark.createDataFrame([("p", 0, 0, "user", "x"), ("p", 1, 0, "assistant", "y"), ("q", 0, 0, "user", "x")], t)
    b = spark.createDataFrame([("p", 0, 0, "user", "x"), ("q", 0, 0, "user", "x"), ("r", 0, 0, "user", "z")], t)
    assert sorted((r.pair_id, r.part, r.turn) for r in format_preferences(a, b).collect()) == [
        ("p", "chosen", 1), ("p", "prompt", 0), ("q", "prompt", 0), ("r", "rejected", 0)]
    assert format_preferences(a.limit(0), b.limit(0)).count() == 0


def test_hot_first_turn_is_dealt_out(spark):
    rows = [(i, t, "user" if t == 0 else "assistant", "same" if t == 0 else f"answer {i}", 0) for i in range(300) for t in (0, 1)]
    chosen, rejected = preference_pairs(turns_of(_turns(spark, rows)), group_rows=20)
    natural = [r.pair_id for r in chosen.select("pair_id").distinct().collect() if not r.pair_id.endswith("cut")]
    ends = [int(x) for p in natural for x in p.split("-")]
    assert len(set(ends)) == len(ends) and len(ends) >= 300 - 16


@pytest.mark.parametrize("n, group_rows", [(2, 1000), (3, 1000), (301, 1000), (301, 20), (300, 7), (301, 1)])
def test_no_conversation_is_lost_from_the_pairs(spark, n, group_rows):
    ids = [i * i for i in range(n)]  # not evenly spread
    rows = [(i, t, "user" if t == 0 else "assistant", "same" if t == 0 else "answer", 0) for i in ids for t in (0, 1)]
    chosen, rejected = preference_pairs(turns_of(_turns(spark, rows)), group_rows=group_rows)
    want = {f"{a}-{b}" for a, b in zip(ids[::2], ids[1::2])} | ({f"{ids[-2]}-{ids[-1]}"} if n % 2 else set())
    for side in (chosen, rejected):
        assert {r.pair_id for r in side.select("pair_id").collect() if not r.pair_id.endswith("cut")} == want


def test_conversations_without_an_assistant(spark):
    rows = [(1, 0, "user", "alone", 0), (2, 0, "user", "both", 0), (2, 1, "user", "more", 0), (3, 0, "user", "both", 0), (3, 1, "assistant", "yes", 0)]
    got = format_preferences(*preference_pairs(turns_of(_turns(spark, rows)))).collect()
    assert {r.pair_id for r in got} == {"3-2", "3-cut"}
    assert [(r.part, r.turn, r.loss_to) for r in got if r.pair_id == "3-2" and r.part == "rejected"] == [("rejected", 1, 0)]


def test_turns_without_conversation_or_number_are_dropped(spark):
    rows = [(1, 0, "user", "q", 0), (1, None, "user", "no place", 0), (1, 1, "assistant", "answer", 0),
            (2, None, "user", "q", 0), (2, None, "assistant", "answer", 0), (None, 0, "user", "q", 0), (None, 1, "assistant", "answer", 0)]
    turns = turns_of(_turns(spark, rows))
    assert sorted((r.conv, r.turn, r.text) for r in turns.collect()) == [(1, 0, "q"), (1, 1, "answer")]
    got = format_preferences(*preference_pairs(turns)).collect()
    assert {r.pair_id for r in got} == {"1-cut"} and not [r for r in got if "no place" in r.text]
    from revisio.llm import chat
    assert "without a turn number have no place and are dropped" in chat.__doc__


def test_word_count_makes_no_match_for_each_word(spark):
    """Counts as the words of the SQL, without a regular expression's matches (four times the time)."""
    from revisio.llm import decontamination as D
    texts = ["", " ", "a", "a b", ".a.", "é.É ü", "\x00a\x7fb", "퟿ x \U0001f600", "  A1-b2__C ", "\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", D._word_count(F.col("text")).alias("n"), F.size(D.words_of(F.col("text"))).alias("w"))
    assert all(r.n == r.w for r in rows.collect())
    plan = rows.select("n")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan.lower() and "regexp_count" not in plan.lower()
