"""Array kernels that run inside Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from lattika.llm.common import by_value

by_value(__name__)

MIX1, MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX1)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    step, k = base % (1 << 64), 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(step)
        step, k = step * step % (1 << 64), k + m
    return out[:n]


#: An odd base and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which `between` takes the fingerprint of any run of values (random 64-bit words)."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=sums[1:])
    return sums


def between(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Fingerprints of the runs start:stop. Equal runs have equal ones; unlike runs may too, so bytes or words decide."""
    return mixed((sums[stop] - sums[start]) * powers(INVERSE, len(sums))[start] + (stop - start).astype(np.uint64))


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Mixed fingerprint of each run of n values (any unsigned integers, mapped to 64 bits by the caller)."""
    if len(values) < n:
        return np.empty(0, np.uint64)
    sums = prefix_sums(values)
    return mixed((sums[n:] - sums[:-n]) * powers(INVERSE, len(values) - n + 1))


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a[at:at+size] and b[bt:bt+size] are equal, byte for byte; sizes are over zero."""
    out = np.ones(len(size), bool)
    for lo, hi in _runs(size, 1 << 21):
        n = size[lo:hi]
        begin = np.cumsum(n) - n
        within = np.arange(n.sum()) - np.repeat(begin, n)
        equal = a[np.repeat(at[lo:hi], n) + within] == b[np.repeat(bt[lo:hi], n) + within]
        out[lo:hi] = np.logical_and.reduceat(equal, begin)
    return out


WINDOW_BITS = 26


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest of each run of w values, the leftmost of equal ones.

    Values are compared without their lowest 26 bits; long inputs are taken in
    slices, so that equal runs select alike wherever they stand.
    """
    most = 1 << (WINDOW_BITS - 1)
    if len(h) <= most + w:
        return _window_min(h, w)
    starts = range(0, len(h) - w + 1, most)
    return np.concatenate([lo + _window_min(h[lo : lo + most + w - 1], w) for lo in starts])


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minima run forward and backward within blocks of w, and a run spans two blocks at most; the lowest bits hold positions."""
    n = len(h) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    bits = np.uint64(WINDOW_BITS)
    rows = -(-len(h) // w)
    val = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    val[: len(h)] = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    val = val.reshape(rows, w)
    ahead = np.minimum.accumulate(val, axis=1).ravel()
    back = np.minimum.accumulate(val[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[w - 1 : w - 1 + n])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def word_hashes(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each word of documents joined by line breaks, words joined by one space; words in each document."""
    if not body:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    buf = np.frombuffer(body + bytes(8), np.uint8)
    text = buf[: len(body)]
    stop = np.flatnonzero((text == 32) | (text == 10))
    start = np.concatenate(([0], stop[:-1] + 1))
    real = stop > start
    last = np.flatnonzero(text[stop] == 10)
    counts = np.diff(np.concatenate(([0], np.cumsum(real)[last])))
    return xxh64(buf, start[real], (stop - start)[real], 7), counts


def spans(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbours."""
    n = len(columns[0])
    if not n:
        return []
    new = np.zeros(n, bool)
    new[0] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    cuts = [*np.flatnonzero(new).tolist(), n]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def find(parent: np.ndarray) -> np.ndarray:
    """Pointers to the roots themselves."""
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent (flat) after joining a[i] to b[i]; a root is the smallest member."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if len(a):
            parent = parent.copy()
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            parent = find(parent)
    return parent


# --- XXH64 of many byte ranges ---------------------------------------------------------------

#: The five constants of XXH64, fixed values.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * P2, 31) * P1


def xxh64(buf: np.ndarray, off: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buf[off:off+size]; buf has 8 spare bytes at the end."""
    u8 = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))
    u4 = np.ndarray((len(buf) - 3,), "<u4", buffer=buf, strides=(1,))
    add = lambda *xs: np.uint64(sum(int(x) for x in xs) % (1 << 64))
    h = np.full(len(off), add(seed, P5), np.uint64)
    long = np.flatnonzero(size >= 32)
    if len(long):
        p, left = off[long].copy(), size[long] // 32
        v = [np.full(len(long), x, np.uint64) for x in (add(seed, P1, P2), add(seed, P2), seed, add(seed, -int(P1)))]
        on = np.arange(len(long))
        while len(on):
            for k in range(4):
                v[k][on] = _round(v[k][on], u8[p[on] + 8 * k])
            p[on] += 32
            left[on] -= 1
            on = on[left[on] > 0]
        acc = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
        for x in v:
            acc = (acc ^ _round(np.zeros_like(x), x)) * P1 + P4
        h[long] = acc
    h += size.astype(np.uint64)
    p, rest = off + size // 32 * 32, size % 32
    for _ in range(3):
        on = np.flatnonzero(rest >= 8)
        if len(on):
            h[on] = _rot(h[on] ^ _round(np.zeros(len(on), np.uint64), u8[p[on]]), 27) * P1 + P4
            p[on] += 8
            rest[on] -= 8
    on = np.flatnonzero(rest >= 4)
    if len(on):
        h[on] = _rot(h[on] ^ (u4[p[on]].astype(np.uint64) * P1), 23) * P2 + P3
        p[on] += 4
        rest[on] -= 4
    for _ in range(3):
        on = np.flatnonzero(rest > 0)
        if len(on):
            h[on] = _rot(h[on] ^ (buf[p[on]].astype(np.uint64) * P5), 11) * P1
            p[on] += 1
            rest[on] -= 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def majority(h: np.ndarray, ns: np.ndarray) -> np.ndarray:
    """For each of len(ns) neighbouring groups of ns[i] words h: the bits set in over half of them; zero for none."""
    # Sums of bits: eight lanes of one byte, over at most 255 words of one group.
    begin = np.cumsum(ns) - ns
    parts = -(-ns // 255)
    owner = np.repeat(np.arange(len(ns)), parts)
    piece = begin[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    counts = np.zeros((len(ns), 64), np.int64)
    if len(h):
        for b in range(8):
            lanes = np.add.reduceat((h >> np.uint64(b)) & np.uint64(0x0101010101010101), piece)
            np.add.at(counts[:, b::8], owner, lanes.view(np.uint8).reshape(-1, 8).astype(np.int64))
    bits = (2 * counts > ns[:, None]).astype(np.uint64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def simhashes(texts: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text's word shingles; zero without words."""
    body = b"\n".join(b" ".join(t.lower().split()) for t in texts) + b"\n"
    buf = np.frombuffer(body + bytes(8), np.uint8)
    text = buf[: len(body)]
    stop = np.flatnonzero((text == 32) | (text == 10))
    start = np.concatenate(([0], stop[:-1] + 1))
    ends = np.flatnonzero(text[stop] == 10)
    first = np.concatenate(([0], ends[:-1] + 1))
    n_words = ends - first + 1
    n_words[stop[ends] == start[first]] = 0
    n = np.where(n_words > 0, np.maximum(1, n_words - shingle + 1), 0)
    out = np.zeros(len(texts), np.uint64)
    for lo, hi in _runs(n, 1 << 19):
        ns, at = n[lo:hi], np.flatnonzero(n[lo:hi])
        if not len(at):
            continue
        doc = np.repeat(np.arange(lo, hi), ns)
        i = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(ns) - ns, ns)
        last = np.minimum(i + shingle - 1, ends[doc])
        h = xxh64(buf, start[i], stop[last] - start[i], seed)
        out[lo:hi] = majority(h, ns)
    return out


def _runs(n: np.ndarray, most: int):
    """Ranges of documents with about `most` shingles each, one document at least."""
    total, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right"))
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi


#: Pairs of nodes that go down together at once.
FRONTIER = 1 << 16


def trie_links(prints: np.ndarray, home: np.ndarray, depth: int, most: int) -> np.ndarray:
    """Root (an index) of each fingerprint after linking those of `home` to all within `most` bits; prints: sorted, distinct."""
    parent = np.arange(len(prints))

    def link(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal parent
        parent = union(parent, x, y)

    trie_join(prints, home, depth, most, link)
    return parent


def trie_join(prints: np.ndarray, home: np.ndarray, depth: int, most: int, take: Callable[[np.ndarray, np.ndarray], None], width: int = 64) -> None:
    """Gives `take` the index pairs, a bounded number at a time, of `home` and any others within `most` of the first `width` bits.

    prints: sorted. The ranges of `prints` that share their first `depth` bits are
    nodes of the binary trie. Pairs of nodes go down together, a level at a time; a
    pair that differs in the next bit loses one of its budget and is pruned when none
    is left. Small pairs are compared directly. Pairs of a node with itself come in both orders.
    """
    n = len(prints)
    top = prints >> np.uint64(64 - depth) if depth else np.zeros(n, np.uint64)
    cuts = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1]))) if n else np.empty(0, np.int64)
    ends = np.concatenate((cuts[1:], [n]))
    own = home[cuts] if n else np.empty(0, bool)
    lo1, lo2 = (x.ravel() for x in np.meshgrid(np.flatnonzero(own), np.arange(len(cuts)), indexing="ij"))
    budget = most - np.bitwise_count(top[cuts[lo1]] ^ top[cuts[lo2]]).astype(np.int64)
    keep = (budget >= 0) & (~own[lo2] | (lo1 <= lo2))
    lo1, lo2, budget = lo1[keep], lo2[keep], budget[keep]
    lo1, hi1, lo2, hi2 = cuts[lo1], ends[lo1], cuts[lo2], ends[lo2]
    ones: dict[int, np.ndarray] = {}  # by depth: how many of the prints before an index have the next bit
    todo = [(depth, lo1, hi1, lo2, hi2, budget)]
    while todo:
        d, *pairs = todo.pop()
        if len(pairs[0]) > FRONTIER:  # one part after the other, so that the pairs under way stay bounded
            todo += [(d, *(x[at : at + FRONTIER] for x in pairs)) for at in range(0, len(pairs[0]), FRONTIER)]
            continue
        lo1, hi1, lo2, hi2, budget = pairs
        small = ((hi1 - lo1) * (hi2 - lo2) <= 48) | (d == width)
        _compare(prints, take, lo1[small], hi1[small], lo2[small], hi2[small], most)
        lo1, hi1, lo2, hi2, budget = (x[~small] for x in (lo1, hi1, lo2, hi2, budget))
        if not len(lo1) or d == width:
            continue
        if d not in ones:
            ones[d] = np.concatenate(([0], np.cumsum((prints >> np.uint64(63 - d)) & np.uint64(1)))).astype(np.int32)
        o = ones[d]
        mid1, mid2 = hi1 - (o[hi1] - o[lo1]), hi2 - (o[hi2] - o[lo2])
        same = lo1 == lo2  # a node with itself: the mixed pair counts once
        parts = [(lo1, mid1, lo2, mid2, budget), (mid1, hi1, mid2, hi2, budget), (lo1, mid1, mid2, hi2, budget - 1)]
        other = ~same
        parts.append((mid1[other], hi1[other], lo2[other], mid2[other], budget[other] - 1))
        lo1, hi1, lo2, hi2, budget = (np.concatenate(x) for x in zip(*parts, strict=True))
        live = (hi1 > lo1) & (hi2 > lo2) & (budget >= 0)
        todo.append((d + 1, *(x[live] for x in (lo1, hi1, lo2, hi2, budget))))


def _compare(prints, take, lo1, hi1, lo2, hi2, most, block: int = 1 << 18):
    """Pairs within small pairs of ranges, a bounded number of comparisons at a time; a large pair is cut."""
    n1, n2 = hi1 - lo1, hi2 - lo2
    wide = n1 * n2 > block
    for i in np.flatnonzero(wide):
        step = max(1, block // int(n2[i]))
        for at in range(int(lo1[i]), int(hi1[i]), step):
            to = min(at + step, int(hi1[i]))
            x = np.repeat(np.arange(at, to), n2[i])
            y = np.tile(np.arange(lo2[i], hi2[i]), to - at)
            near = (x != y) & (np.bitwise_count(prints[x] ^ prints[y]) <= most)
            take(x[near], y[near])
    lo1, lo2, n1, n2 = lo1[~wide], lo2[~wide], n1[~wide], n2[~wide]
    for a, b in _runs(n1 * n2, block) if len(n1) else ():
        size = (n1 * n2)[a:b]
        k = np.repeat(np.arange(a, b), size)
        j = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
        x, y = lo1[k] + j // n2[k], lo2[k] + j % n2[k]
        near = (x != y) & (np.bitwise_count(prints[x] ^ prints[y]) <= most)
        take(x[near], y[near])
