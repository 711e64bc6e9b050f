"""Plain-Python forms of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _ok(kind: str, m: str) -> bool:
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def pii(text: str | None) -> dict[str, list[tuple[int, int]]]:
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if _ok(k, m[0])] for k, p in BASE.items()}


def pii_row(doc_id, text) -> tuple:
    found = pii(text)
    shown = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in found[k])
    return (doc_id, *(len(found[k]) for k in BASE), hashlib.sha256(shown.encode()).hexdigest())


def byte_repeats(texts: list[str | None], n: int = 200) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 of each text: every start of every n-byte string is counted."""
    from collections import Counter

    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def word_repeats(rows: list[tuple[int, str | None]], n: int = 13) -> dict[int, tuple[int, int, str]]:
    """n_words, n_removed, kept_sha256 by doc_id."""
    first: dict[tuple[str, ...], int] = {}
    ws = {d: words(t) for d, t in rows}
    for d, w in ws.items():
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            first[g] = min(first.get(g, d), d)
    out = {}
    for d, w in ws.items():
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def simhash(text: str | None) -> int:
    import xxhash

    w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(prints: list[tuple[int, int]], most: int = 2) -> dict[int, int]:
    """Smallest id reachable over links of at most `most` differing bits, by id."""
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, (a, f) in enumerate(prints):
        for b, g in prints[:i]:
            if (f ^ g).bit_count() <= most:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d, _ in prints}


def line_repeats(rows: list[tuple[int, str | None]], threshold: float = 0.8) -> set[tuple[int, int]]:
    """(doc_id, line_no) of lines with an earlier line of at least that Jaccard similarity of their words."""
    lines = [(d, i, set(words(x))) for d, t in sorted(rows, key=lambda r: r[0]) for i, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    return {(d, i) for k, (d, i, w) in enumerate(lines) if any(len(w & v) >= threshold * len(w | v) - 1e-12 for _, _, v in lines[:k])}


def line_links(rows: list[tuple[int, str | None]], threshold: float = 0.8) -> dict[tuple[int, int], tuple]:
    """By (doc_id, line_no) of each line with words: earliest similar line before it or None, earliest line of its class, number of different similar lines."""
    lines = [((d, i), x, frozenset(words(x))) for d, t in sorted(rows, key=lambda r: r[0]) for i, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    near = {p: [(q, y) for q, y, v in lines if q != p and len(w & v) >= threshold * len(w | v) - 1e-12] for p, _, w in lines}
    root = {}
    for p, _, _ in lines:  # in order, so the first to reach a line is the earliest
        todo = [p]
        while todo:
            q = todo.pop()
            if q not in root:
                root[q] = p
                todo += [r for r, _ in near[q]]
    equal = {p: next(q for q, y, _ in lines if y == x) for p, x, _ in lines}
    return {p: (equal[p] if equal[p] != p else min((q for q, _ in near[p] if q < p), default=None), root[p], len({y for _, y in near[p] if y != x})) for p, x, _ in lines}
