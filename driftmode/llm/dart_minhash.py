"""Weighted MinHash signatures by hashed darts.

An element of weight ``w`` owns the region [0, w) x [0, inf) of height and time. Darts fall on every
element's region by a Poisson process of unit rate that depends on the element alone: the heights are cut into slabs
[0, 1), [1, 2), [2, 4), [4, 8), ..., so an element has about log2(w) of them; in a slab hashed exponential gaps, as short as
it is high, give the times of its darts, further hashes give a dart's height, coordinate and name. Darts above the
weight don't count (at most half of those in the top slab). A signature keeps, for each of ``k`` coordinates, the name of the earliest dart
below the weights. Two weighted sets agree in a coordinate with the probability of their weighted
Jaccard similarity.

Only darts up to a horizon are thrown, at which a signature is complete with high probability:
``k (ln k + 4)`` darts a set whatever its size. Sets with an empty coordinate get a doubled horizon.
"""

from __future__ import annotations

import numpy as np

from ._text import mix, uniform

_GAP, _NAME, _HEIGHT, _CELL, _PLACE = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F))
#: Gaps drawn at once for elements that have had a first dart.
_AHEAD = 8


def _throw(cells: np.ndarray, horizon: np.ndarray):
    """(index of the cell, time, dart hash) of all darts up to each cell's horizon."""
    first = uniform(mix(cells + _GAP))
    live = np.flatnonzero(first >= np.exp(-horizon))
    t = -np.log(first[live])
    yield live, t, mix(cells[live] + _NAME)
    n = 1
    while len(live):
        steps = np.arange(n, n + _AHEAD, dtype=np.uint64) * _CELL
        gaps = -np.log(uniform(mix(cells[live, None] + (_GAP + steps)[None, :])))
        times = t[:, None] + np.cumsum(gaps, axis=1)
        row, col = np.nonzero(times <= horizon[live, None])
        if len(row):
            yield live[row], times[row, col], mix(cells[live[row]] + (_NAME + steps)[col])
        on = times[:, -1] <= horizon[live]
        live, t = live[on], times[on, -1]
        n += _AHEAD


def signatures(elements: np.ndarray, off: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Signatures (rows of ``k`` dart names) of the sets ``elements[off[i]:off[i + 1]]``.

    Without weights every element counts once, however often it stands there. An empty set (or one of
    zero weight) gets zeros.
    """
    sets = len(off) - 1
    out = np.zeros((sets, k), np.uint64)
    row = np.repeat(np.arange(sets), np.diff(off))
    cell_of = np.arange(len(elements))
    cells, top = mix(elements), None
    rate = None
    if weights is not None:
        total = np.bincount(row, np.maximum(weights, 0), minlength=sets)
        slabs = np.where(weights > 1, 1 + np.ceil(np.log2(np.maximum(weights, 1))), weights > 0).astype(np.int64)
        cell_of = np.repeat(cell_of, slabs)
        slab = np.arange(len(cell_of)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
        low = np.where(slab, 2.0 ** (slab - 1), 0.0)
        rate = np.maximum(low, 1.0)
        cells, row = cells[cell_of], row[cell_of]
        cells = np.where(slab, mix(cells + slab.astype(np.uint64) * _HEIGHT), cells)
        top = (weights[cell_of] - low) / rate
    else:
        total = np.diff(off).astype(np.float64)
    todo = total > 0
    reach = np.zeros(sets)
    reach[todo] = k * (np.log(k) + 4) / total[todo]
    while todo.any():
        at = np.arange(len(cells)) if todo.all() else np.flatnonzero(todo[row])
        best = np.full(sets * k, np.inf)
        found = []
        for who, t, name in _throw(cells[at], reach[row[at]] if rate is None else reach[row[at]] * rate[at]):
            who = at[who]
            if top is not None:
                t = t / rate[who]
                below = uniform(mix(name + _HEIGHT)) <= top[who]
                who, t, name = who[below], t[below], name[below]
            slot = row[who] * k + (mix(name + _PLACE) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, slot, t)
            found.append((slot, t, name))
        flat = out.reshape(-1)
        for slot, t, name in found:
            win = t == best[slot]
            flat[slot[win]] = name[win]
        todo &= np.isinf(best.reshape(sets, k)).any(axis=1)
        reach[todo] *= 2
    return out


def band_keys(sigs: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of equally many coordinates."""
    rows = sigs.shape[1] // bands
    out = np.empty((len(sigs), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sigs), mix(np.array([b + 1], np.uint64))[0])
        for c in range(b * rows, (b + 1) * rows):
            h = mix(h + sigs[:, c])
        out[:, b] = h
    return out
