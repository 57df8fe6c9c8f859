"""Porter's suffix-stripping stemmer as column expressions.

A word is rewritten in ordered steps; in each step the longest matching suffix
is replaced if the stem before it meets a condition on its *measure* (how many
vowel-consonant groups it has), its vowels or its ending. Conditions are
regular expressions over the stem, so every step is a CASE of replacements that
Spark evaluates without Python. The same steps as SQL text check the result.

The rules are the published ones (Porter, 1980), with the two later additions
of its author: ``logi`` and ``bli`` in step 2.
"""
from __future__ import annotations

import re
import sys
from typing import Callable, Optional, Sequence, Union

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Consonants and vowels; "y" is a vowel after a consonant.
_C, _V = "[^aeiou]", "[aeiouy]"
_CS, _VS = _C + "[^aeiouy]*", _V + "[aeiou]*"
M_POSITIVE = f"^({_CS})?{_VS}{_CS}"                         # measure above 0
M_ONE = f"^({_CS})?{_VS}{_CS}({_VS})?$"                     # measure 1
M_ABOVE_ONE = f"^({_CS})?{_VS}{_CS}{_VS}{_CS}"              # measure above 1
HAS_VOWEL = f"^({_CS})?{_V}"
SHORT_END = f"^{_CS}{_V}[^aeiouwxy]$"                       # consonant, vowel, consonant but w, x, y

# Fixed values: (suffix, replacement) of steps 2 and 3, under M_POSITIVE.
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
          ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
          ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
# Suffixes of step 4, dropped under M_ABOVE_ONE ("ion" only after s or t).
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


class _Spark:
    """How the steps are said to Spark."""
    lit = staticmethod(F.lit)

    @staticmethod
    def case(whens: Sequence[tuple], other: Column) -> Column:
        out: Optional[Column] = None
        for cond, value in whens:
            out = F.when(cond, value) if out is None else out.when(cond, value)
        return out.otherwise(other)

    ends = staticmethod(lambda w, s: F.endswith(w, F.lit(s)))
    cut = staticmethod(lambda w, n: F.substr(w, F.lit(1), F.length(w) - n))
    add = staticmethod(lambda w, s: F.concat(w, F.lit(s)) if s else w)
    like = staticmethod(lambda w, p: F.rlike(w, F.lit(p)))
    both = staticmethod(lambda a, b: a & b)
    rewrite = staticmethod(lambda w, p, r: F.regexp_replace(w, p, r.replace("\\", "$")))
    longer = staticmethod(lambda w, n: F.length(w) > n)


class Sql:
    """How the steps are said to DuckDB."""
    lit = staticmethod(lambda s: "'" + s + "'")

    @staticmethod
    def case(whens: Sequence[tuple], other: str) -> str:
        return "(CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in whens) + f" ELSE {other} END)"

    ends = staticmethod(lambda w, s: f"ends_with({w}, '{s}')")
    cut = staticmethod(lambda w, n: f"left({w}, length({w}) - {n})")
    add = staticmethod(lambda w, s: f"({w} || '{s}')" if s else w)
    like = staticmethod(lambda w, p: f"regexp_matches({w}, '{p}')")
    both = staticmethod(lambda a, b: f"({a} AND {b})")
    rewrite = staticmethod(lambda w, p, r: f"regexp_replace({w}, '{p}', '{r}')")
    longer = staticmethod(lambda w, n: f"length({w}) > {n}")


class Plain:
    """How the steps are said to Python: each expression is a function of the word
    that enters the step. Conditions on a word's end are found by its last letter."""
    @staticmethod
    def case(whens: Sequence[tuple], other: Callable) -> Callable:
        suffixes = [getattr(c, "suffix", None) for c, _ in whens]
        if not all(suffixes):
            return lambda t: next((v for c, v in whens if c(t)), other)(t)
        by_last: dict = {}
        for suffix, (_, value) in zip(suffixes, whens):
            by_last.setdefault(suffix[-1], []).append((suffix, value))

        def run(t: str) -> str:
            for suffix, value in by_last.get(t[-1:], ()):
                if t.endswith(suffix):
                    return value(t)
            return other(t)
        return run

    @staticmethod
    def ends(w: Callable, s: str) -> Callable:
        def run(t: str) -> bool:
            return w(t).endswith(s)
        if w is Plain.word:
            run.suffix = s
        return run

    @staticmethod
    def word(t: str) -> str:
        return t

    @staticmethod
    def like(w: Callable, p: str) -> Callable:
        search = re.compile(p).search
        return lambda t: search(w(t)) is not None

    @staticmethod
    def rewrite(w: Callable, p: str, r: str) -> Callable:
        sub = re.compile(p).sub
        return lambda t: sub(r, w(t))

    cut = staticmethod(lambda w, n: lambda t: w(t)[:max(0, len(w(t)) - n)])
    add = staticmethod(lambda w, s: lambda t: w(t) + s)
    both = staticmethod(lambda a, b: lambda t: a(t) and b(t))


Word = Union[Column, str, Callable]


def _suffixes(x, w: Word, rules: Sequence[tuple[str, str]], condition: str) -> Word:
    """Replace the longest matching suffix if the stem meets the condition; only the longest is tried."""
    whens = []
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        stem = x.cut(w, len(suffix))
        whens.append((x.ends(w, suffix), x.case([(x.like(stem, condition), x.add(stem, new))], w)))
    return x.case(whens, w)


def steps(x=_Spark) -> list:
    """The steps in order, each a function from a word to the rewritten word."""
    def plural(w):  # 1a
        return x.case([(x.ends(w, "sses"), x.cut(w, 2)), (x.ends(w, "ies"), x.cut(w, 2)), (x.ends(w, "ss"), w), (x.ends(w, "s"), x.cut(w, 1))], w)

    def past(w):  # 1b
        def after(stem):
            doubled = x.like(stem, "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$")
            return x.case([(x.like(stem, "(at|bl|iz)$"), x.add(stem, "e")), (doubled, x.cut(stem, 1)), (x.like(stem, SHORT_END), x.add(stem, "e"))], stem)

        eed, ed, ing = x.cut(w, 3), x.cut(w, 2), x.cut(w, 3)
        return x.case([(x.ends(w, "eed"), x.case([(x.like(eed, M_POSITIVE), x.cut(w, 1))], w)),
                       (x.ends(w, "ed"), x.case([(x.like(ed, HAS_VOWEL), after(ed))], w)),
                       (x.ends(w, "ing"), x.case([(x.like(ing, HAS_VOWEL), after(ing))], w))], w)

    def final_y(w):  # 1c
        stem = x.cut(w, 1)
        return x.case([(x.both(x.ends(w, "y"), x.like(stem, HAS_VOWEL)), x.add(stem, "i"))], w)

    def drop(w):  # 4
        whens = []
        for suffix in sorted((*STEP_4, "ion"), key=lambda s: -len(s)):
            stem = x.cut(w, len(suffix))
            ok = x.like(stem, M_ABOVE_ONE)
            if suffix == "ion":
                ok = x.both(ok, x.like(stem, "[st]$"))
            whens.append((x.ends(w, suffix), x.case([(ok, stem)], w)))
        return x.case(whens, w)

    def final_e(w):  # 5a
        stem = x.cut(w, 1)
        one = x.case([(x.like(stem, SHORT_END), w)], stem)
        return x.case([(x.ends(w, "e"), x.case([(x.like(stem, M_ABOVE_ONE), stem), (x.like(stem, M_ONE), one)], w))], w)

    def final_l(w):  # 5b
        return x.case([(x.both(x.ends(w, "ll"), x.like(w, M_ABOVE_ONE)), x.cut(w, 1))], w)

    # A leading y is a consonant: it stands as Y meanwhile.
    return [lambda w: x.rewrite(w, "^y", "Y"), plural, past, final_y, lambda w: _suffixes(x, w, STEP_2, M_POSITIVE),
            lambda w: _suffixes(x, w, STEP_3, M_POSITIVE), drop, final_e, final_l, lambda w: x.rewrite(w, "^Y", "y")]


#: Words whose stems are remembered by a Python worker.
MEMO = 1 << 17
_STEMS: dict = {}
_STEPS: list = []


def stemmed(words: Sequence[str], least: int = 4) -> list:
    """``stems`` of a list, in a Python worker; a word that comes again is not stemmed again."""
    if not _STEPS:
        _STEPS.extend(step(Plain.word) for step in steps(Plain))
    out = []
    for word in words:
        stem = _STEMS.get(word) if len(word) >= least else word
        if stem is None:
            stem = word
            for step in _STEPS:
                stem = step(stem)
            if len(_STEMS) < MEMO and len(word) < 64:
                _STEMS[word] = stem
        out.append(stem)
    return out


def _applied(step):
    return lambda e: F.struct(F.when(e["on"], step(e["w"])).otherwise(e["w"]).alias("w"), e["on"].alias("on"))


def stems(tokens: Column, least: int = 4) -> Column:
    """Lower-case ASCII words of an array stemmed, those below ``least`` letters as they are.

    Each step is a ``transform`` of its own, so that a step's result is computed
    once and not copied into every condition of the next."""
    run = F.transform(tokens, lambda w: F.struct(w.alias("w"), (F.length(w) >= least).alias("on")))
    for step in steps():
        run = F.transform(run, _applied(step))
    return F.transform(run, lambda e: e["w"])


def sql_stems(tokens: str, least: int = 4) -> str:
    """The same for DuckDB, over a list expression."""
    run = tokens
    for i, step in enumerate(steps(Sql)):
        # Words that are too short are marked by their upper case, which no step changes back.
        run = f"list_transform({run}, lambda w{i}: CASE WHEN starts_with(w{i}, '=') THEN w{i} ELSE {step(f'w{i}')} END)"
    marked = f"list_transform({tokens}, lambda w: CASE WHEN length(w) < {least} THEN '=' || w ELSE w END)"
    return f"list_transform({run.replace(tokens, marked, 1)}, lambda w: replace(w, '=', ''))"
