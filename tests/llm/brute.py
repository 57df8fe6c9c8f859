"""Plain Python versions of what the operators compute, for small inputs."""
from __future__ import annotations

import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def quality_stats(text: str | None) -> dict[str, int]:
    text = text or ""
    words = SPACE_WORD.findall(text)
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def shingles(text: str | None, size: int) -> set[tuple]:
    words = SPACE_WORD.findall(lower_ascii(text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}


def jaccard_components(rows: list[tuple], size: int, percent: int) -> dict:
    """rows (id, text), ids distinct -> id: (set size, component id)."""
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders: dict[tuple, list] = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1:]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


ALNUM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contamination(docs: list[tuple], items: list[tuple], size: int = 13) -> list[tuple]:
    """(doc_id, n_words, n_hit, items) for each document, in order."""
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = ALNUM_WORD.findall(lower_ascii(text or ""))
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = ALNUM_WORD.findall(lower_ascii(text or ""))
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (items_here := windows.get(tuple(w[i:i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= items_here
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found)))
    return out
