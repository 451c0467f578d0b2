"""Plain Python versions of the text operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def private(text: str | None) -> list[tuple[int, int, str, int]]:
    """(start, kind number, kind, end) of the base spans, sorted."""

    def holds(kind: str, found: str) -> bool:
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            return 12 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    return sorted(
        (m.start(), n, kind, m.end())
        for n, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text or "")
        if holds(kind, m.group())
    )


def passages(texts: dict[int, str | None], window: int = 50) -> dict[int, tuple[int, int, str]]:
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    seen: set[tuple] = set()
    out = {}
    for i in sorted(texts):
        own = [tuple(words[i][j : j + window]) for j in range(len(words[i]) - window + 1)]
        gone = {j + k for j, w in enumerate(own) if w in seen for k in range(window)}
        seen |= set(own)
        kept = [w for j, w in enumerate(words[i]) if j not in gone]
        out[i] = (len(words[i]), len(gone), sha(b" ".join(kept)))
    return out


def byte_repeats(texts: dict[int, str | None], window: int = 100) -> dict[int, tuple[int, int, int, str]]:
    seen: set[bytes] = set()
    out = {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone = bytearray(len(data))
        for j in range(len(data) - window + 1):
            part = data[j : j + window]
            if part in seen:
                gone[j : j + window] = b"\1" * window
            seen.add(part)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def shingle_set(text: str | None, width: int = 5) -> frozenset:
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near_groups(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """id -> (shingles, smallest id reachable)."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    holders: dict[tuple, list[int]] = {}
    for i in sorted(sets):
        for gram in sets[i]:
            holders.setdefault(gram, []).append(i)
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, own in sets.items():
        for j, both in Counter(j for gram in own for j in holders[gram] if j < i).items():
            if 100 * both >= 80 * (len(own) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def slipped_words(texts: dict[int, str | None], slip: int = 31) -> Counter:
    """Occurrences of all runs of letters, with the contract's typing errors."""
    out: Counter = Counter()
    for i, text in texts.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % slip == 0 else run] += 1
    return out


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def spellings(counts: dict[str, int], length: int = 7, least: int = 2, factor: int = 10) -> dict[str, tuple]:
    """word -> (n, n_near, form, form_n, root)."""
    words = {w: n for w, n in counts.items() if len(w) >= length and n >= least}
    holders: dict[str, set[str]] = {}
    for w in words:  # words one edit apart share a word with one letter gone, or are one
        for part in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            holders.setdefault(part, set()).add(w)
    near = {w: {v for part in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in holders[part] if one_edit(w, v)} for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], words.get(form[w]), root)
    return out


def hard(rows: list[tuple], is_anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> list[tuple]:
    """(anchor, positive, rank, negative, positive score, negative score) of (id, label, whole vector) rows."""
    out = []
    for a, label, x in rows:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other == label) for i, other, y in rows if i != a)
        for s, p, _ in [r for r in scored if r[2]][:positives]:
            mined = [r for r in scored if not r[2] and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(a, p, k, i, -s, -t) for k, (t, i, _) in enumerate(mined, 1)]
    return sorted(out)
