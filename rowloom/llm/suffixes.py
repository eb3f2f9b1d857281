"""Suffix arrays by induced sorting and permuted common prefixes, on NumPy arrays of one shard."""

from __future__ import annotations

import numpy as np

from .minhash import mixed

_U = np.uint64
_BASE = 0x9E6D62D06F6A9A9B
_BYTES = mixed(np.arange(1001, 1257, dtype="u8") * _U(0x9E3779B97F4A7C15))
_held: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd number and of its inverse modulo 2 ** 64; the most asked for so far are held."""
    if not _held or len(_held[0][0]) < n:
        size = 1 << max(17, int(n).bit_length())
        both = [np.full(size, base, "u8") for base in (_BASE, pow(_BASE, -1, 1 << 64))]
        for column in both:
            column[0] = 1
        _held[:] = [tuple(np.cumprod(column) for column in both)]
    return _held[0]


def prefix_sums(a: np.ndarray) -> np.ndarray:
    """Sums from which span_hashes() tells the hash of any stretch of a."""
    sums = np.zeros(len(a) + 1, "u8")
    np.cumsum(_BYTES[a] * powers(len(a) + 1)[0][: len(a)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * powers(len(sums))[1][start]


def _smaller(a: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is larger than the empty one that follows it."""
    n = len(a)
    step = np.zeros(n, "i1")
    step[:-1] = np.sign(np.diff(a.astype("i2")))
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _deal(found: np.ndarray, keys: np.ndarray, place: np.ndarray, sa: np.ndarray, step: int) -> None:
    """Write found, in order, to its keys' next places, which move by step."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    counts = np.bincount(ranked, minlength=256)
    within = np.arange(len(ranked)) - (np.cumsum(counts) - counts)[ranked]
    sa[place[ranked] + step * within] = found[order]
    place += step * counts


def _induce(a: np.ndarray, smaller: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Suffix order induced from the order of the leftmost-smaller suffixes in seeds.

    Buckets are swept by first byte, up for larger suffixes and then down for smaller ones. Within one, suffixes that follow
    each other by a repeated byte come in waves; all others that a bucket induces are dealt at once.
    """
    n = len(a)
    sa = np.full(n, -1, "i4")
    tails = ends - 1
    _deal(seeds[::-1], a[seeds[::-1]], tails, sa, -1)
    heads = starts.copy()
    sa[heads[a[n - 1]]] = n - 1
    heads[a[n - 1]] += 1
    present = np.flatnonzero(ends > starts)
    for c in present:
        wave = sa[starts[c] : heads[c]]
        while len(wave):
            wave = wave[wave > 0] - 1
            wave = wave[(a[wave] == c) & ~smaller[wave]]
            sa[heads[c] : heads[c] + len(wave)] = wave
            heads[c] += len(wave)
        found = np.concatenate([sa[starts[c] : heads[c]], sa[tails[c] + 1 : ends[c]]])
        found = found[found > 0] - 1
        found = found[~smaller[found] & (a[found] > c)]
        if len(found):
            _deal(found, a[found], heads, sa, 1)
    tails = ends - 1
    for c in present[::-1]:
        wave = sa[tails[c] + 1 : ends[c]][::-1]
        while len(wave):
            wave = wave[wave > 0] - 1
            wave = wave[(a[wave] == c) & smaller[wave]]
            sa[tails[c] + 1 - len(wave) : tails[c] + 1] = wave[::-1]
            tails[c] -= len(wave)
        found = np.concatenate([sa[tails[c] + 1 : ends[c]][::-1], sa[starts[c] : heads[c]][::-1]])
        found = found[found > 0] - 1
        found = found[smaller[found] & (a[found] < c)]
        if len(found):
            _deal(found, a[found], tails, sa, -1)
    return sa


def _rank(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence of names, by ranks of doubled length among those that are not yet alone.

    Names make as many buckets as there are names, too many to sweep, so the recursion sorts them this way.
    """
    n = len(names)
    rank = names.astype("i8")
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        ranked = rank[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        alone = first & np.concatenate([first[1:], [True]])
        open_ = np.flatnonzero(~alone)
        # a rank is the place of the first that shares it
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        if not len(open_):
            return order
        at = order[open_]
        after = at + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        again = np.argsort(rank[at] * (n + 1) + second, kind="stable")
        keys = (rank[at] * (n + 1) + second)[again]
        order[open_] = at[again]
        # open_ holds whole runs of equal rank in place, so a run's new ranks are its places
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        fresh = rank.copy()
        fresh[order[open_]] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        rank, width = fresh, width * 2


def suffix_array(a: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Places of the suffixes of a (uint8) in order; sums: its prefix_sums()."""
    n = len(a)
    if n < 2:
        return np.arange(n, dtype="i4")
    smaller = _smaller(a)
    ends = np.cumsum(np.bincount(a, minlength=256))
    starts = ends - np.bincount(a, minlength=256)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype("i4") + 1
    if len(leftmost) < 2:
        return _induce(a, smaller, starts, ends, leftmost)
    # induced from any order, leftmost-smaller substrings come out sorted
    sa = _induce(a, smaller, starts, ends, leftmost)
    number = np.full(n, -1, "i4")
    number[leftmost] = np.arange(len(leftmost))
    ordered = number[sa]
    ordered = ordered[ordered >= 0]
    stop = np.append(leftmost[1:] + 1, n)  # a substring ends with the byte that begins the next; the last with the text
    own = mixed(span_hashes(sums, leftmost, stop) + (stop - leftmost).astype("u8"))
    own[-1] = ~own[-1]
    differs = own[ordered][1:] != own[ordered][:-1]
    names = np.empty(len(leftmost), "i8")
    names[ordered] = np.concatenate([[0], np.cumsum(differs)])
    return _induce(a, smaller, starts, ends, leftmost[_rank(names)])


def common_prefixes(a: np.ndarray, sa: np.ndarray, sums: np.ndarray, most: int) -> np.ndarray:
    """Length, up to most, that each suffix shares with the one before it in order, by place in the text.

    A suffix whose predecessor in order is preceded by the same byte shares one byte less than the suffix before it in the
    text. Only the others are compared, by halving on hashes. most must exceed the lengths asked for by the longest run.
    """
    n = len(a)
    before = np.full(n, -1, "i4")
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & (before[:-1] >= 0) & (a[:-1] == a[np.maximum(before[1:], 1) - 1])
    alone = np.flatnonzero(~follows & (before >= 0))
    low, high = np.zeros(len(alone), "i4"), np.minimum(np.minimum(n - alone, n - before[alone]), most).astype("i4")
    other = before[alone]
    while len(live := np.flatnonzero(low < high)):
        middle = (low[live] + high[live] + 1) // 2
        same = span_hashes(sums, alone[live], alone[live] + middle) == span_hashes(sums, other[live], other[live] + middle)
        low[live] = np.where(same, middle, low[live])
        high[live] = np.where(same, high[live], middle - 1)
    shared = np.zeros(n, "i4")
    shared[alone] = low
    last = np.maximum.accumulate(np.where(follows, 0, place))
    return np.maximum(shared[last] - (place - last), 0)
