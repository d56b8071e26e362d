"""PartEnum signatures of sets for Jaccard joins (helpers for tasks).

Sets are put in size bands; those of a band, and those of the band below that
are large enough to match into it, share one *scheme*.  A scheme deals the
feature domain into first-level partitions of n2 sub-partitions each, and a
set's signatures are its contents in every choice of n2 - k2 sub-partitions of
one partition.  Two sets with Jaccard similarity t differ in at most
k = (1-t)/(1+t) * (|a|+|b|) features, so of any k//(k2+1) + 1 partitions one
has at most k2 differences, and n2 - k2 of its sub-partitions agree.

A set thus needs only the first partitions up to its (k//(k2+1) + 1)th *good*
one, where more than k2 sub-partitions hold features (what agrees then isn't
empty), with k bounded by its own size and the largest it can match.  A set
that runs out of good partitions is *short*.  Of a similar pair in which
either has enough, the guarantee holds; pairs of two short sets meet by single
features: each has one signature for each of its |a| - ceil(t|a|) + 1 smallest
feature hashes, of which such a pair has one in common.

Small sets, which differ in DELETED features at most, have the finest
partition: every feature is a sub-partition of its own in a single first-level
partition, and signatures are what is left without up to k of them.  Where k
is 0, similar sets are equal and have no signature.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

from modspec.llm._shingles import U, mix

#: Upper ends of the size bands, a factor of about 1.41 apart.
BANDS = np.unique(np.round(2.0 ** (np.arange(0, 80) / 2)).astype(np.int64))
#: (n2, k2) of the schemes up to a size: short texts need choosier signatures, long ones fewer of them.
WAYS = {64: (8, 1), 256: (5, 2), 724: (3, 1), int(BANDS[-1]): (2, 1)}
#: Schemes whose sets differ in no more features than this enumerate the features themselves.
DELETED = 2


def _way(scheme: np.ndarray) -> np.ndarray:
    return np.searchsorted(list(WAYS), BANDS[scheme])


def partitions(scheme: np.ndarray, percent: int) -> np.ndarray:
    """First-level partitions of each scheme: what its largest sets need, and an eighth."""
    top = BANDS[scheme]
    k2 = np.array([k2 for _, k2 in WAYS.values()])[_way(scheme)]
    need = (100 - percent) * 2 * top // (100 + percent) // (k2 + 1) + 1
    return need + need // 8


def signatures(flat: np.ndarray, bounds: np.ndarray, percent: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets ``flat[bounds[i]:bounds[i+1]]`` (each sorted): (index of the set, signature)."""
    size = np.diff(bounds)
    rows = np.flatnonzero(size)
    own = np.searchsorted(BANDS, size[rows])
    most = 100 * size[rows] // percent  # the largest size that it can match
    row, scheme = [rows], [own]
    step = own
    while len(rows):
        up = most > BANDS[step]
        rows, step, most = rows[up], step[up] + 1, most[up]
        row.append(rows)
        scheme.append(step)
    row, scheme = np.concatenate(row), np.concatenate(scheme)
    small = (100 - percent) * 2 * BANDS[scheme] // (100 + percent) <= DELETED
    way = _way(scheme)
    out = [_of_small(flat, bounds, row[small], scheme[small], percent)]
    out += [_of_scheme(flat, bounds, row[(way == i) & ~small], scheme[(way == i) & ~small], percent, *ways) for i, ways in enumerate(WAYS.values())]
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _differences(size: np.ndarray, scheme: np.ndarray, percent: int) -> np.ndarray:
    """The most features in which a set and one that it matches in the scheme can differ."""
    return (100 - percent) * (size + np.minimum(100 * size // percent, BANDS[scheme])) // (100 + percent)


def _of_small(flat: np.ndarray, bounds: np.ndarray, row: np.ndarray, scheme: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    out_row, out_sig = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    size = np.diff(bounds)[row]
    most = _differences(size, scheme, percent)
    with np.errstate(over="ignore"):
        for n, k in np.unique(np.stack([size, most], 1)[most > 0], axis=0):
            some = (size == n) & (most == k)
            h = mix(flat[bounds[row[some]][:, None] + np.arange(n)])
            whole = h.sum(1, dtype=U) + scheme[some].astype(U) * U(0x9E3779B97F4A7C15)
            for gone in range(min(int(k), int(n) - 1) + 1):
                for subset in combinations(range(n), gone):
                    out_row.append(row[some])
                    out_sig.append(mix(whole - h[:, subset].sum(1, dtype=U)))
    return np.concatenate(out_row), np.concatenate(out_sig)


def _of_short(flat: np.ndarray, bounds: np.ndarray, row: np.ndarray, scheme: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A signature for each of the first features of a set, by hash."""
    size = np.diff(bounds)[row]
    count = size + (-percent * size) // 100 + 1
    which = np.repeat(np.arange(len(row)), count)
    place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        return row[which], mix(flat[bounds[row[which]] + place] * U(0x9E3779B97F4A7C15) + scheme[which].astype(U) + U(1 << 20))


def _of_scheme(flat: np.ndarray, bounds: np.ndarray, row: np.ndarray, scheme: np.ndarray, percent: int, n2: int, k2: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, U)
    a = np.diff(bounds)[row]
    need = _differences(a, scheme, percent) // (k2 + 1) + 1
    parts = partitions(scheme, percent)
    base = np.concatenate([[0], np.cumsum(parts)])
    which = np.repeat(np.arange(len(row)), a)
    h = flat[np.arange(len(which)) - np.repeat(np.concatenate([[0], np.cumsum(a)])[:-1] - bounds[row], a)]
    with np.errstate(over="ignore"):
        part = ((h >> U(32)) * parts[which].astype(U)) >> U(32)
        cell = (base[which] + part.astype(np.int64)) * n2 + (h & U(0xFFFFFFFF)).astype(np.int64) % n2
        content = np.zeros(base[-1] * n2, U)
        np.add.at(content, cell, mix(h))
        full = np.bincount(cell, minlength=len(content)).reshape(-1, n2) > 0
        content = content.reshape(-1, n2)
        seen = np.concatenate([[0], np.cumsum(full.sum(1) > k2)])
        owner = np.repeat(np.arange(len(row)), parts)
        chosen = np.flatnonzero(seen[:-1] - seen[base[owner]] < need[owner])
        label = mix((chosen - base[owner[chosen]]).astype(U) * U(128) + scheme[owner[chosen]].astype(U) + U(1))
        out_row, out_sig = [], []
        for x, subset in enumerate(combinations(range(n2), n2 - k2)):
            some = full[chosen][:, subset].any(1)
            c, sig = chosen[some], label[some] + U(x)
            for s in subset:
                sig = mix(sig * U(0x9E3779B97F4A7C15) + content[c, s])
            out_row.append(row[owner[c]])
            out_sig.append(sig)
    short = np.flatnonzero(seen[base[1:]] - seen[base[:-1]] < need)
    short_row, short_sig = _of_short(flat, bounds, row[short], scheme[short], percent)
    return np.concatenate([*out_row, short_row]), np.concatenate([*out_sig, short_sig])
