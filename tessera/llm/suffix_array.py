"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are S-type if they are smaller than the next one, else L-type; an S-type suffix behind an L-type one is
leftmost-smaller (LMS). LMS substrings are sorted by one round of induction and named; if names repeat, the
suffixes of the string of names are sorted recursively; a second round of induction places all suffixes. On the
string of symbols a round goes bucket by bucket with whole arrays: what a bucket induces is dealt out by a stable
sort of symbols. The shorter strings of names, whose alphabet is as large as they are, go suffix by suffix.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True for S-type; the last suffix (the sentinel) is S-type."""
    n = len(s)
    differs = np.flatnonzero(s[1:] != s[:-1])
    smaller = s[differs] < s[differs + 1]
    out = np.ones(n, dtype=bool)
    if len(differs):
        nxt = np.searchsorted(differs, np.arange(n - 1))  # the next place where the symbol changes
        inside = nxt < len(differs)
        out[:-1][inside] = smaller[nxt[inside]]
    return out


def _induce(s: np.ndarray, stype: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes in order, from LMS suffixes that are in order within their buckets (all of them with the sentinel)."""
    by = s[lms]
    cut = np.searchsorted(by, np.arange(sigma + 1)) if len(by) and (by[1:] >= by[:-1]).all() else None
    if cut is None:
        lms = lms[np.argsort(by, kind="stable")]
        cut = np.searchsorted(s[lms], np.arange(sigma + 1))
    large: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    done_large: list[np.ndarray] = [lms[:0]] * sigma
    symbols = np.arange(sigma + 1)

    def deal(scanned: np.ndarray, want_s: bool, c: int, into: list[list[np.ndarray]]) -> np.ndarray:
        """Deals the predecessors of the type wanted to their buckets; returns those of bucket c."""
        before = scanned[scanned > 0] - 1
        before = before[stype[before] == want_s]
        if not len(before):
            return before
        symbol = s[before]
        same = symbol == c
        other = before[~same]
        if len(other):
            symbol = symbol[~same]
            order = np.argsort(symbol, kind="stable")
            other, symbol = other[order], symbol[order]
            at = np.searchsorted(symbol, symbols)
            for d in np.unique(symbol).tolist():
                into[d].append(other[at[d] : at[d + 1]])
        return before[same]

    for c in range(sigma):
        rounds = []
        now = np.concatenate(large[c]) if large[c] else lms[:0]
        large[c] = []
        while len(now):
            rounds.append(now)
            now = deal(now, False, c, large)
        done_large[c] = np.concatenate(rounds) if rounds else lms[:0]
        deal(lms[cut[c] : cut[c + 1]], False, c, large)
    small: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    small[s[-1]].append(np.array([len(s) - 1]))
    parts = []
    for c in range(sigma - 1, -1, -1):
        rounds = []
        now = np.concatenate(small[c]) if small[c] else lms[:0]
        small[c] = []
        while len(now):
            rounds.append(now)
            now = deal(now, True, c, small)
        deal(done_large[c][::-1], True, c, small)
        if rounds:
            parts.append(np.concatenate(rounds))
        parts.append(done_large[c][::-1])
    return np.concatenate(parts)[::-1]


def _names(s: np.ndarray, ordered: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings, by LMS place in order of text: equal substrings get equal names, in their order."""
    rank = np.full(len(s), -1, dtype=np.int64)
    rank[places] = np.arange(len(places))
    ends = np.append(places[1:], places[-1])
    start, end = ordered, ends[rank[ordered]]
    size = end - start
    new = np.ones(len(ordered), dtype=bool)
    open_ = np.flatnonzero(size[1:] == size[:-1]) + 1
    new[open_] = False
    offset = 0
    while len(open_):
        a, b = start[open_], start[open_ - 1]
        differ = s[a + offset] != s[b + offset]
        new[open_[differ]] = True
        offset += 1
        open_ = open_[~differ & (size[open_] >= offset)]
    names = np.zeros(len(places), dtype=np.int64)
    names[rank[ordered]] = np.cumsum(new) - 1
    return names, int(new.sum())


def _induce_by_suffix(s: np.ndarray, stype: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The same as _induce, suffix by suffix: for alphabets about as large as the string."""
    n = len(s)
    counts = np.bincount(s, minlength=sigma)
    tails = np.cumsum(counts)
    heads = (tails - counts).tolist()
    tails = tails.tolist()
    # the symbol of the suffix before, if that is of the type that a scan induces, else -1 (also at place -1)
    large, small = np.full(n + 1, -1, dtype=np.int64), np.full(n + 1, -1, dtype=np.int64)
    large[1:n] = np.where(stype[:-1], -1, s[:-1])
    small[1:n] = np.where(stype[:-1], s[:-1], -1)
    large, small = large.tolist(), small.tolist()
    sa = [-1] * n
    end = tails[:]
    for i, x in zip(lms[::-1].tolist(), s[lms[::-1]].tolist(), strict=True):
        end[x] -= 1
        sa[end[x]] = i
    at = heads
    for i in sa:  # grows ahead of where it is read
        x = large[i]
        if x >= 0:
            sa[at[x]] = i - 1
            at[x] += 1
    end = tails
    for k in range(n - 1, -1, -1):
        i = sa[k]
        x = small[i]
        if x >= 0:
            end[x] -= 1
            sa[end[x]] = i - 1
    return np.array(sa)


def _sort(s: np.ndarray, sigma: int, induce) -> np.ndarray:
    """The suffix array of a string that ends with its unique least symbol."""
    stype = _types(s)
    places = np.flatnonzero(stype[1:] & ~stype[:-1]) + 1
    if not len(places):
        return induce(s, stype, places, sigma)
    sa = induce(s, stype, places, sigma)
    mark = np.zeros(len(s), dtype=bool)
    mark[places] = True
    names, distinct = _names(s, sa[mark[sa]], places)
    order = _sort(names, distinct, _induce_by_suffix) if distinct < len(places) else np.argsort(names)
    return induce(s, stype, places[order], sigma)


def suffix_array(symbols: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array of symbols in [1, sigma); a sentinel 0 is put behind them and left out of the result."""
    s = np.append(symbols, 0).astype(np.uint16 if sigma <= 1 << 16 else np.int64)
    return _sort(s, sigma, _induce)[1:]


def permuted_common_prefixes(units: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """For each suffix, in order of text, the common prefix with the suffix before it in order, cap at most.

    Eight bytes at a time, for all suffixes at once that are still equal.
    """
    n = len(units)
    padded = np.concatenate([units, np.zeros(cap + 8, dtype=np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, dtype=np.int32)
    at = np.flatnonzero(before >= 0)
    other = before[at]
    offset = 0
    while len(at) and offset < cap:
        x = words[at + offset].view("<u8").ravel() ^ words[other + offset].view("<u8").ravel()
        equal = x == 0
        if not equal.all():
            first = x[~equal]
            low = (first & (~first + np.uint64(1))).astype(np.float64)  # the lowest bit that differs
            out[at[~equal]] = offset + (np.log2(low).astype(np.int64) >> 3)
        at, other = at[equal], other[equal]
        offset += 8
    out[at] = cap
    return np.minimum(np.minimum(out, cap), np.where(before >= 0, np.minimum(n - np.arange(n), n - before), 0))
