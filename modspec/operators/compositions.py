"""Search of modification counts whose mass is that of a shift, by meeting in the middle.

The rules are split into two halves; for a profile (the places of each kind, and
what each rule may use of them) each half's count vectors are listed once, with
sums that can't reach any shift left out, and one half is sorted by sum.  A shift
then looks up, for each vector of the other half, the sums that complete it.  So
the work is about the square root of the number of all vectors, and rows are
only made for hits.

Rules are tried in their order: a vector that is a hit isn't extended, so a hit
beyond another hit (one that holds the same counts up to some rule and a part of
the next) doesn't count.  Masses may be negative.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspec.operators import enumerate as E

#: Pairs of a shift and a half's vector that are looked up in one step.
STEP = 1 << 20


def half(masses: np.ndarray, kinds: np.ndarray, most: np.ndarray, room: np.ndarray, own: slice, low: float, high: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, sums, places used by kind) of the vectors over the rules ``own`` from which a sum between ``low`` and ``high`` can be reached."""
    counts, sums, used = np.zeros((1, 0), np.int64), np.zeros(1), np.zeros((1, len(room)), np.int64)
    reach = most * masses
    up, down = np.maximum(reach, 0).sum(), np.minimum(reach, 0).sum()
    for i in range(len(masses))[own]:
        up, down = up - max(reach[i], 0), down - min(reach[i], 0)
        k = np.arange(most[i] + 1)
        counts = np.concatenate([np.repeat(counts, len(k), 0), np.tile(k, len(counts))[:, None]], 1)
        sums = (sums[:, None] + k * masses[i]).ravel()
        used = np.repeat(used, len(k), 0)
        used[:, kinds[i]] += np.tile(k, len(used) // len(k))
        # the other half's rules all are in ``up`` and ``down``
        fine = (used <= room).all(1) & (sums + up >= low) & (sums + down <= high)
        counts, sums, used = counts[fine], sums[fine], used[fine]
    return counts, sums, used


def first_hits(counts: np.ndarray, deltas: np.ndarray, masses: np.ndarray, tol: float) -> np.ndarray:
    """Which vectors have no hit on the way to them, rule by rule and one count at a time."""
    fine = np.ones(len(counts), bool)
    path = np.zeros(len(counts))
    for i, mass in enumerate(masses):
        later = counts[:, i + 1 :].sum(1) > 0
        for k in range(int(counts[:, i].max(initial=0)) + 1):
            on = (k < counts[:, i]) | ((k == counts[:, i]) & later)  # a part of the vector, not all of it
            fine &= ~(on & (np.abs(deltas - path - k * mass) < tol))
        path = path + counts[:, i] * mass
    return fine


def search(deltas: np.ndarray, masses: np.ndarray, kinds: np.ndarray, most: np.ndarray, room: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """(number of the shift, counts) of all hits within ``tol`` (exclusive) for shifts of one profile."""
    most = np.minimum(most, room[kinds]) if len(kinds) else most
    sizes = np.cumprod(most + 1.0)
    split = int(np.argmin(np.maximum(sizes, sizes[-1] / sizes))) + 1 if len(sizes) else 0
    low, high = deltas.min() - tol, deltas.max() + tol
    a, b = (half(masses, kinds, most, room, s, low, high) for s in (slice(0, split), slice(split, None)))
    order = np.argsort(b[1], kind="stable")
    ordered = b[1][order]
    found_at, found = [np.zeros(0, np.int64)], [np.zeros((0, len(masses)), np.int64)]
    for i in range(0, len(deltas), max(1, STEP // max(1, len(a[1])))):
        some = deltas[i : i + max(1, STEP // max(1, len(a[1])))]
        wanted = (some[:, None] - a[1][None, :]).ravel()
        first, last = np.searchsorted(ordered, wanted - tol - 1e-9), np.searchsorted(ordered, wanted + tol + 1e-9, "right")
        n = last - first
        pair = np.repeat(np.arange(len(wanted)), n)
        other = order[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        at, one = pair // max(1, len(a[1])), pair % max(1, len(a[1]))
        vectors = np.concatenate([a[0][one], b[0][other]], 1)
        fine = (np.abs(some[at] - vectors @ masses) < tol) & (a[2][one] + b[2][other] <= room).all(1)
        at, vectors = at[fine], vectors[fine]
        fine = first_hits(vectors, some[at], masses, tol)
        found_at.append(i + at[fine])
        found.append(vectors[fine])
    return np.concatenate(found_at), np.concatenate(found)


def n_placements(counts: np.ndarray, kinds: np.ndarray, room: np.ndarray) -> int:
    """Placements of a count vector: per kind the ways to deal its counts to the places."""
    ways = 1
    for kind, places in enumerate(room.tolist()):
        for k in counts[kinds == kind].tolist():
            ways *= comb(places, k)
            places -= k
    return ways


def find_compositions(targets: DataFrame, masses: list[float], kinds: list[int], tol: float, key: str, delta: str = "delta", most: str = "most", room: str = "room", cap: int = E.MAX_CANDIDATES, sites: int = E.MAX_SITES) -> DataFrame:
    """(key, counts, n_forms, too_many_sites) for each hit of each row of ``targets`` (key, shift, most, room).

    ``masses`` and ``kinds`` (numbers from 0) are the rules'; ``most`` is what a
    row's peptide allows of each rule at most, ``room`` its places of each kind.
    ``n_forms`` is the number of placements in closed form.  A row with more than
    ``cap`` forms, or with more than ``sites`` places of a kind that a rule may
    use, has one row with null counts, its number of forms, and whether the
    places were too many.  A row without hits or with a null has none.
    """
    own_masses, own_kinds = np.array(masses, float), np.array(kinds, np.int64)
    limit = 2**63 - 1

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            profiles = batch[most].map(tuple).astype(object) if len(batch) else batch[most]
            rooms = batch[room].map(tuple) if len(batch) else batch[room]
            for (m, r), group in batch.groupby([profiles, rooms], sort=False):
                top, places = np.array(m, np.int64), np.array(r, np.int64)
                at, counts = search(group[delta].to_numpy(float), own_masses, own_kinds, top, places, tol)
                wide = bool(any(p > sites for k, p in enumerate(places.tolist()) if (top[own_kinds == k] > 0).any()))
                ways = [n_placements(c, own_kinds, places) for c in counts]
                total = pd.Series(ways, dtype=object).groupby(at).sum() if len(at) else pd.Series(dtype=object)
                names = group[key].to_numpy()
                for i, n in total.items():
                    if wide or n > cap:
                        out.append((names[i], None, min(n, limit), wide))
                out += [(names[i], c.tolist(), n, False) for i, c, n in zip(at.tolist(), counts, ways) if not wide and total[i] <= cap]
            yield pd.DataFrame(out, columns=[key, "counts", "n_forms", "too_many_sites"])

    fields = [F.col(key), F.col(delta).cast("double").alias(delta), F.col(most).cast("array<int>").alias(most), F.col(room).cast("array<int>").alias(room)]
    rows = targets.select(*fields).where(F.col(delta).isNotNull() & ~F.isnan(delta) & F.col(most).isNotNull() & F.col(room).isNotNull())
    return rows.mapInPandas(find, f"{key} {dict(targets.dtypes)[key]}, counts array<int>, n_forms long, too_many_sites boolean")
