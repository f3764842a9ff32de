"""Set similarity joins by signature trees inside hash blocks.

A set of word hashes is summarised by a token bitmap of ``WORDS`` 64-bit words and by its size. Leaves of a signature
tree hold up to ``LEAF`` records, inner nodes the OR of their children's bitmaps and the range of their sizes. A dual
traversal walks pairs of nodes and drops a pair as soon as the largest overlap that its bitmaps and sizes allow is below
the overlap that the threshold needs. The bound never drops a pair that reaches the threshold:

    overlap(x, y) <= bits(x & y) + min(slack(x), slack(y)),   slack = size - bits set

A tree of all records would be compared with itself level by level, which grows as the square of the records. So the
uppermost level is hashed: records are sent to blocks by keys that similar sets share (a band of MinHash values, or a
fingerprint), and every block is joined by its own trees. A block of any size costs memory for one frontier chunk only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS, LEAF, FAN = 2, 16, 4
#: Node or record pairs looked at in one go.
CHUNK = 1 << 18


def bitmaps(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """OR of the bits of each set's (distinct) hashes."""
    n = len(offsets) - 1
    out = np.zeros((n, WORDS), np.uint64)
    text = np.repeat(np.arange(n), np.diff(offsets))
    bit = (flat >> np.uint64(7)) % np.uint64(64 * WORDS)
    for w in range(WORDS):
        own = bit // np.uint64(64) == w
        if own.any():
            t = text[own]
            starts = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            out[t[starts], w] = np.bitwise_or.reduceat(np.uint64(1) << (bit[own] % np.uint64(64)), starts)
    return out


def ones(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(-1).astype(np.int32)


class Records:
    """Columns of the records of some blocks; ``side`` is 0 or 1 for a join of two sides, all 0 for a self-join."""

    def __init__(self, ref: np.ndarray, bits: np.ndarray, size: np.ndarray, side: np.ndarray | None = None):
        self.ref, self.bits, self.size = ref, bits, size.astype(np.int32)
        self.slack = self.size - ones(bits)
        self.side = np.zeros(len(ref), np.int8) if side is None else side


def possible(r: Records, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
    """Mask of the record pairs that can reach Jaccard ``t``."""
    need = t / (1 + t) * (r.size[i] + r.size[j]) - 1e-9
    most = ones(r.bits[i] & r.bits[j]) + np.minimum(r.slack[i], r.slack[j])
    return (most >= need) & (np.minimum(r.size[i], r.size[j]) >= t * np.maximum(r.size[i], r.size[j]) - 1e-9)


def summary(r: Records, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nodes over consecutive records from each cut on: OR of the bitmaps, smallest and largest size, largest slack."""
    return np.bitwise_or.reduceat(r.bits, cuts, axis=0), np.minimum.reduceat(r.size, cuts), np.maximum.reduceat(r.size, cuts), np.maximum.reduceat(r.slack, cuts)


def reachable(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
    """Mask of the node pairs that may hold a similar pair."""
    (xb, xl, xh, xs), (yb, yl, yh, ys) = x, y
    need = t / (1 + t) * (xl[i] + yl[j]) - 1e-9
    most = ones(xb[i] & yb[j]) + np.minimum(xs[i], ys[j])
    return (most >= need) & (xh[i] >= t * yl[j] - 1e-9) & (yh[j] >= t * xl[i] - 1e-9)


class Tree:
    """Nodes of a signature tree over records ``at``, level by level; level 0 are the leaves."""

    def __init__(self, r: Records, at: np.ndarray):
        self.at = at = at[np.lexsort((*(r.bits[at].T), r.size[at]))]
        self.levels = []
        cuts = np.arange(0, len(at), LEAF)
        self.pack(r, len(cuts))
        bits = np.bitwise_or.reduceat(r.bits[at], cuts, axis=0)
        low, high = np.minimum.reduceat(r.size[at], cuts), np.maximum.reduceat(r.size[at], cuts)
        slack = np.maximum.reduceat(r.slack[at], cuts)
        self.levels.append((bits, low, high, slack))
        while len(bits) > 1:
            cuts = np.arange(0, len(bits), FAN)
            bits = np.bitwise_or.reduceat(bits, cuts, axis=0)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            slack = np.maximum.reduceat(slack, cuts)
            self.levels.append((bits, low, high, slack))


    def pack(self, r: Records, leaves: int) -> None:
        """Leaves as arrays of ``LEAF`` columns; places without a record have a slack that excludes them."""
        pad = leaves * LEAF - len(self.at)
        fill = lambda x, v: np.concatenate([x, np.full(pad, v, x.dtype)]).reshape(leaves, LEAF)
        self.bits = [fill(r.bits[self.at, w], 0) for w in range(WORDS)]
        self.size = fill(r.size[self.at].astype(np.float32), 0)
        self.slack = fill(r.slack[self.at].astype(np.float32), -1e9)


def dual(r: Records, a: Tree, b: Tree, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Record pairs of two trees (or of one tree with itself) that the traversal can't exclude."""
    own = a is b
    top = max(len(a.levels), len(b.levels)) - 1
    todo: list[tuple[int, np.ndarray, np.ndarray]] = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    for x in (a, b):
        while len(x.levels) <= top:
            x.levels.append(x.levels[-1])
    while todo:
        level, i, j = todo.pop()
        if len(i) > CHUNK:
            half = len(i) // 2
            todo += [(level, i[:half], j[:half]), (level, i[half:], j[half:])]
            continue
        keep = reachable(a.levels[level], b.levels[level], i, j, t)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if level == 0:
            step = max(1, CHUNK // (LEAF * LEAF))
            for k in range(0, len(i), step):
                yield _leaves(r, a, b, i[k : k + step], j[k : k + step], t, own)
            continue
        below_i, below_j = (_children(x, level, n) for x, n in ((a, i), (b, j)))
        ci = np.repeat(below_i, FAN, axis=1).reshape(-1)
        cj = np.tile(below_j, (1, FAN)).reshape(-1)
        ok = (ci >= 0) & (cj >= 0)
        if own:
            ok &= ci <= cj
        todo.append((level - 1, ci[ok], cj[ok]))


def _children(x: Tree, level: int, nodes: np.ndarray) -> np.ndarray:
    """Four children a node, -1 where there is none. A level repeated to make heights equal has itself as child."""
    n = len(x.levels[level - 1][1])
    if len(x.levels[level][1]) == n and n == 1 and x.levels[level] is x.levels[level - 1]:
        out = np.full((len(nodes), FAN), -1, np.int64)
        out[:, 0] = nodes
        return out
    out = nodes[:, None] * FAN + np.arange(FAN)
    return np.where(out < n, out, -1)


def _leaves(r: Records, a: Tree, b: Tree, i: np.ndarray, j: np.ndarray, t: float, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the records of pairs of leaves: a rough bound on whole leaves, then the exact one on what it leaves."""
    most = np.zeros((len(i), LEAF, LEAF), np.uint8)
    for x, y in zip(a.bits, b.bits, strict=True):
        most += np.bitwise_count(x[i][:, :, None] & y[j][:, None, :])
    need = np.float32(t / (1 + t) * (1 - 1e-5)) * (a.size[i][:, :, None] + b.size[j][:, None, :]) - np.float32(1e-3)
    need -= np.minimum(a.slack[i][:, :, None], b.slack[j][:, None, :])
    p, x, y = np.nonzero(most >= need)
    x, y = i[p] * LEAF + x, j[p] * LEAF + y
    if own:
        x, y = x[x < y], y[x < y]
    x, y = a.at[x], b.at[y]
    keep = possible(r, x, y, t)
    return x[keep], y[keep]


def block_pairs(key: np.ndarray, r: Records, t: float, two_sides: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of records (positions) of equal key that may reach ``t``, in pieces; a pair may come more than once.

    Blocks up to a leaf's size are done together, larger ones by their trees.
    """
    order = np.argsort(key, kind="stable")
    k = key[order]
    starts = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(k)))
    for n in range(2, LEAF + 1):
        own = starts[sizes == n]
        x, y = np.triu_indices(n, 1)
        step = max(1, CHUNK // len(x))
        for c in range(0, len(own), step):
            i, j = (order[(own[c : c + step, None] + z).reshape(-1)] for z in (x, y))
            if two_sides:
                ok = r.side[i] != r.side[j]
                i, j = i[ok], j[ok]
            keep = possible(r, i, j, t)
            yield i[keep], j[keep]
    for s, n in zip(starts[sizes > LEAF], sizes[sizes > LEAF], strict=True):
        at = order[s : s + n]
        if two_sides:
            one, two = at[r.side[at] == 0], at[r.side[at] == 1]
            if len(one) and len(two):
                yield from dual(r, Tree(r, one), Tree(r, two), t)
        else:
            tree = Tree(r, at)
            yield from dual(r, tree, tree, t)


def minhash(flat: np.ndarray, offsets: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """``count`` MinHash values (32 bits) of each set; sets must not be empty."""
    rng = np.random.default_rng(seed)
    a = (rng.integers(1, 1 << 32, count, np.uint64) | np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    b = rng.integers(0, 1 << 63, count, np.uint64)
    base = flat ^ (flat >> np.uint64(29))
    out = np.empty((len(offsets) - 1, count), np.uint32)
    for k in range(count):
        out[:, k] = np.minimum.reduceat(((base * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), offsets[:-1])
    return out


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` MinHash values; the band's number is part of it."""
    bands = values.shape[1] // rows
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (len(values), 1))
    for k in range(rows):
        out = (out ^ values[:, k : bands * rows : rows].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out
