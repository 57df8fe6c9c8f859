"""Tokenizing whole texts through a bounded memo of independent units.

Both public tokenizers split a text before they merge, and never across a
space that stands between two non-space characters. A text can therefore be
cut at its white space into units whose ids do not depend on their neighbours;
the ids of a unit are looked up, and only units that were not seen yet go
through the library, many at a time. The memo is a cache with a bound on its
entries: a unit that was evicted is encoded again.

Texts whose cutting would need more care (a special string, or the control
characters on which Python and the tokenizer disagree) go whole to the
library. Equality with the library is tested on random texts.
"""
from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Units in one generation of a worker's memo, and pre-tokens likewise; two
#: generations of about 170 bytes an entry are held.
MEMO_LIMIT = 250_000
#: Characters of units that go to the library in one call.
CALL_CHARS = 200_000

# Python takes these for white space, the tokenizers' patterns do not.
_DISPUTED = "\x1c\x1d\x1e\x1f"
_RUNS = re.compile(r"(\s+)")
_OTHER_SPACES = [c for c in map(chr, range(0x10000)) if c.isspace() and c not in " \n" + _DISPUTED]


# The plain unit: Latin letters and then punctuation without apostrophes. It is
# exactly two pre-tokens (or one) in both tokenizers, which need no cutting by
# the library; everything else is cut by it.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
# The same for a key of ``ByteUnits`` with its first character, for Arrow.
_PLAIN_KEY = r"^(?P<lead>[\r\n]?)(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
_LATIN = [c for c in map(chr, range(0xC0, 0x100)) if c not in "×÷"]


def _bytes(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _strings(column: pa.Array) -> list[str]:
    """As ``to_pylist``, without a scalar object for each string."""
    return column.to_numpy(zero_copy_only=False).tolist()


class _Encoder:
    """Shared part: the memos, their bounds, and encoding of many units in a call.

    ``memo`` holds units, ``parts`` single pre-tokens: a word is merged once,
    whatever punctuation follows it. A full memo becomes the older generation,
    from which entries in use come back; the rest is forgotten with the next.
    """

    def __init__(self, path: str, limit: int = MEMO_LIMIT):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.limit = limit
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.memo, self.older = {}, {}
        self.parts, self.older_parts = {}, {}
        # Letters beyond ASCII in the tokenizer's byte alphabet.
        self.alphabet = {ord(c): self.tok.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in _LATIN}

    def whole(self, text: str) -> bytes:
        return _bytes(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _merge(self, part: str):
        """What is kept for a pre-token: here its ids."""
        return array("I", [t.id for t in self.tok.model.tokenize(part)]).tobytes()

    def _part(self, part: str):
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) >= self.limit:
                self.parts, self.older_parts = {}, self.parts
            found = self.older_parts.get(part)
            if found is None:
                found = self._merge(part)
            self.parts[part] = found
        return found

    def _plain(self, text: str, lead: str = ""):
        """The value of a plain unit's text, or None if it is not one."""
        m = _PLAIN.fullmatch(text)
        if m is None:
            return None
        word, marks = m.groups()
        found = self._part(lead + (word if word.isascii() else word.translate(self.alphabet)))
        return found + self._part(marks) if marks else found

    def _learn(self, keys: set[str]) -> None:
        new = keys.difference(self.memo)
        if len(self.memo) + len(new) > self.limit:
            self.memo, self.older = {}, self.memo
            new = keys
        rest, old = [], self.older.get
        for k in new:
            found = old(k)
            if found is None:
                found = self._quick(k)
            if found is None:
                rest.append(k)
            else:
                self.memo[k] = found
        at, size = 0, 0
        for i, k in enumerate(rest):
            size += len(k) + 16
            if size > CALL_CHARS or i == len(rest) - 1:
                self._encode_many(rest[at:i + 1])
                at, size = i + 1, 0

    def _joined(self, units: list[str], glue: str, glue_id: int) -> list[bytes]:
        """Ids of each unit from one call; ``glue`` becomes exactly ``glue_id``."""
        if not units:
            return []
        ids = np.asarray(self.tok.encode_batch_fast([glue.join(units)], add_special_tokens=False)[0].ids, dtype="<u4")
        cut = np.flatnonzero(ids == glue_id)
        if len(cut) != len(units) - 1:  # a unit that holds the glue itself
            return [self.whole(u) for u in units]
        raw, out, at = ids.tobytes(), [], 0
        for c in cut:
            out.append(raw[at:4 * c])
            at = 4 * c + 4
        out.append(raw[at:])
        return out

    def plans(self, texts: list[str | None]) -> list[list[str] | None]:
        """Each text's units, all of them in the memo afterwards; None: encode it whole."""
        plans, keys = [], set()
        for t in texts:
            plan = self._cut(t) if t else []
            plans.append(plan)
            if plan is not None:
                keys.update(plan)
        if not keys <= self.memo.keys():
            self._learn(keys)
        return plans

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; null is empty."""
        plans, get = self.plans(texts), self.memo.__getitem__
        return [self.whole(t) if p is None else b"".join(map(get, p)) for t, p in zip(texts, plans)]


class ByteUnits(_Encoder):
    """Byte-level BPE whose pattern gives a space to the word after it.

    Keys: a word stands for the word with one space before it; ``"\\n" + word``
    for a line feed and a word; ``"\\r" + x`` for x as it is (first words and
    runs of white space).
    """

    def __init__(self, path: str, limit: int = MEMO_LIMIT):
        super().__init__(path, limit)
        self.feed = int(self.tok.encode("\n", add_special_tokens=False).ids[0])
        self.space, self.line = (self.tok.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in " \n")

    def _cut(self, text: str) -> list[str] | None:
        if any(s in text for s in self.specials) or any(c in text for c in _DISPUTED):
            return None
        flat = text.replace("\n", " ")
        if text and "  " not in flat and flat[0] != " " != flat[-1] and not any(c in text for c in _OTHER_SPACES):
            # Single spaces and line feeds only, none at either end.
            units = text.replace("\n", " \n").split(" ")
            units[0] = "\r" + units[0]
            return units
        # General: of a run of white space, all but the last character are one
        # pre-token; the last is its own, or joins the word if it is a space.
        parts = _RUNS.split(text)
        out = ["\r" + parts[0]] if parts[0] else []
        for run, word in zip(parts[1::2], parts[2::2]):
            if not word:  # at the end of the text: one pre-token
                out.append("\r" + run)
                continue
            if len(run) > 1:
                out.append("\r" + run[:-1])
            if run[-1] == " ":
                out.append(word)
            elif run[-1] == "\n":
                out.append("\n" + word)
            else:
                out += ["\r" + run[-1], "\r" + word]
        return out

    def _quick(self, key: str):
        if key[0] == "\r":
            return self._plain(key[1:])
        if key[0] == "\n":
            found = self._plain(key[1:])
            return None if found is None else self._part(self.line) + found
        return self._plain(key, self.space)

    def _encode_many(self, keys: list[str]) -> None:
        spaced = [k for k in keys if k[0] not in "\r\n"]
        fed = [k for k in keys if k[0] == "\n"]
        plain = [k for k in keys if k[0] == "\r" and not k.isspace()]
        feed = _bytes([self.feed])
        for ks, texts, before in ((spaced, [" " + k for k in spaced], b""), (fed, [k[1:] for k in fed], feed),
                                  (plain, [k[1:] for k in plain], b"")):
            self.memo.update(zip(ks, (before + x for x in self._joined(texts, "\n", self.feed))))
        for k in keys:
            if k[0] == "\r" and k.isspace():
                self.memo[k] = self.whole(k[1:])


class ByteLists(ByteUnits):
    """The ids of a whole column at once, for plain units without a Python step for each.

    ``words`` is a third memo, of the words of plain units, by their keys.
    """

    def __init__(self, path: str, limit: int = MEMO_LIMIT):
        super().__init__(path, limit)
        self.words, self.older_words = {}, {}
        # Texts that hold more than single spaces and line feeds inside.
        self.uneven = "|".join([r"^$", r"^[ \n]", r"[ \n]$", r"[ \n][ \n]", "[" + "".join([*_DISPUTED, *_OTHER_SPACES]) + "]",
                                *map(re.escape, self.specials)])

    def _word_ids(self, keys: list[str]) -> list[bytes]:
        """The ids of plain units' words, each key given once."""
        found = list(map(self.words.get, keys))
        new = [i for i, x in enumerate(found) if x is None]
        if len(self.words) + len(new) > self.limit:
            self.words, self.older_words = {}, self.words
        old = self.older_words.get
        for i in new:
            key = keys[i]
            ids = old(key)
            if ids is None:
                word = key if key.isascii() else key.translate(self.alphabet)
                ids = self._merge(word[1:] if key[0] == "\r" else self.space + word)
            self.words[key] = found[i] = ids
        return found

    def _unit_ids(self, keys: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The number of ids of each key, and the ids of all, in order."""
        cut = pc.extract_regex(keys, _PLAIN_KEY)
        plain = cut.is_valid().to_numpy(zero_copy_only=False)
        odd = keys.filter(cut.is_null()).to_pylist()
        if not self.memo.keys() >= set(odd):
            self._learn(set(odd))
        lead, word, marks = cut.drop_null().flatten()
        bare = pc.equal(lead, pa.scalar("", lead.type))
        word = pc.if_else(bare, word, pc.binary_join_element_wise(pa.scalar("\r", word.type), word, pa.scalar("", word.type))).dictionary_encode()
        marks = marks.dictionary_encode()
        # Three parts a key: a line feed, the word (or all of a key that is not plain), the marks.
        values = [b"", self._part(self.line)]
        parts = np.zeros((len(keys), 3), dtype=np.int64)
        parts[plain, 0] = pc.equal(lead, pa.scalar("\n", lead.type)).to_numpy(zero_copy_only=False)
        parts[plain, 1] = word.indices.to_numpy() + len(values)
        values += self._word_ids(_strings(word.dictionary))
        parts[plain, 2] = marks.indices.to_numpy() + len(values)
        values += [self._part(m) if m else b"" for m in marks.dictionary.to_pylist()]
        parts[~plain, 1] = np.arange(len(odd)) + len(values)
        values += map(self.memo.__getitem__, odd)
        sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
        return sizes[parts].sum(axis=1), _lists(sizes, pa.array(np.frombuffer(b"".join(values), dtype="<i4"))).take(pa.array(parts.ravel())).flatten()

    def lists(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """For each text of a column its ids and then ``end_id``; null is empty.

        The same units as in ``encode``, but Arrow cuts evenly spaced texts and
        tells the units of all texts apart, so that each different one is
        looked up once for the column.
        """
        texts = pc.fill_null(texts, "")
        uneven = pc.match_substring_regex(texts, self.uneven)
        even, empty = pc.if_else(uneven, pa.scalar("", texts.type), texts), pa.scalar("", texts.type)
        cuts = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\r", texts.type), even, empty), "\n", " \n"), " ")
        whole = []
        rows = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
        if len(rows):
            plans = []
            for t in texts.take(pa.array(rows)).to_pylist():
                plan = self._cut(t) if t else []
                if plan is None:  # one unit without a key
                    whole.append(self.whole(t))
                    plan = [None]
                plans.append(plan)
            order = np.arange(len(texts))
            order[rows] = len(texts) + np.arange(len(rows))
            cuts = pa.concat_arrays([cuts, pa.array(plans, cuts.type)]).take(pa.array(order))
        units = cuts.flatten().dictionary_encode()
        sizes, ids = self._unit_ids(units.dictionary)
        codes = pc.fill_null(units.indices, -1).to_numpy().astype(np.int64)
        codes[codes < 0] = len(sizes) + np.arange(len(whole))
        sizes = np.concatenate([sizes, [len(x) // 4 for x in whole], [1]]).astype(np.int64)
        ids = pa.concat_arrays([ids, pa.array(np.frombuffer(b"".join(whole), dtype="<i4")), pa.array([end_id], pa.int32())])
        ends = np.cumsum(pc.list_value_length(cuts).to_numpy(), dtype=np.int64)
        codes = np.insert(codes, ends, len(sizes) - 1)
        stops = np.cumsum(sizes[codes])[ends + np.arange(len(ends))]
        return _lists(np.diff(stops, prepend=0), _lists(sizes, ids).take(pa.array(codes)).flatten())


class WordUnits(_Encoder):
    """BPE with word ends that drops white space and case: words are independent."""

    def __init__(self, path: str, limit: int = MEMO_LIMIT):
        super().__init__(path, limit)
        self.glue = self.specials[0]
        self.glue_id = int(self.tok.token_to_id(self.glue))

    def _cut(self, text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    def _quick(self, key: str):
        return self._plain(key.lower()) if key and "<" not in key else None

    def _encode_many(self, keys: list[str]) -> None:
        odd = [k for k in keys if not k or any(s in k for s in self.specials)]
        plain = [k for k in keys if k and not any(s in k for s in self.specials)]
        self.memo.update((k, self.whole(k) if k else b"") for k in odd)
        self.memo.update(zip(plain, self._joined(plain, self.glue, self.glue_id)))


_ENCODERS: dict[tuple, _Encoder] = {}


def encoder(kind: type, path: str) -> _Encoder:
    """One encoder for each worker process, so that its memo outlives a task."""
    key = (kind, path)
    if key not in _ENCODERS:
        _ENCODERS[key] = kind(path)
    return _ENCODERS[key]


def blocks(texts, rows: int = 256, chars: int = 2_000_000):
    """Index ranges of at most ``rows`` texts and about ``chars`` bytes of an Arrow column."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, size = 0, 0
    for i, n in enumerate(sizes):
        size += int(n)
        if size >= chars or i + 1 - at >= rows:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)
