"""The largest complete block of a table, found on its distinct masks."""

from __future__ import annotations

import numpy as np

#: Up to so many columns that have gaps, all sets of them are tried.
EXHAUST = 16


def largest(missing: np.ndarray, rows: np.ndarray, width: np.ndarray, min_rows: int = 0) -> np.ndarray:
    """Which columns to keep, for the largest complete block of rows x columns.

    ``missing`` [masks, columns] weighs ``rows`` rows each, and a column counts
    ``width`` encoded columns.  The largest block with at least ``min_rows``
    rows wins, or the largest of all if none has them; ties go to more rows,
    then to earlier columns.  Columns with the same gaps go together, and those
    without gaps are always kept.  With up to ``EXHAUST`` others this is exact;
    beyond, only sets of the least-missing columns are tried.
    """
    missing, rows, width = np.asarray(missing, dtype=bool), np.asarray(rows), np.asarray(width, dtype=float)
    kind, first = kinds(missing)
    lacks = rows @ missing[:, first]
    gaps = np.flatnonzero(lacks > 0)
    sizes = np.array([width[kind == k].sum() for k in gaps])
    free = float(width[lacks[kind] == 0].sum())
    holes = missing[:, first[gaps]]
    if len(gaps) <= EXHAUST:
        chosen = all_sets(np.bincount(holes @ bits(len(gaps)), weights=rows, minlength=1 << len(gaps)), sizes, free, min_rows)
    else:
        order = np.argsort(lacks[gaps], kind="stable")
        chosen = np.zeros(len(gaps), dtype=bool)
        chosen[order[: best_prefix(np.bincount(depth(holes[:, order]), weights=rows, minlength=len(gaps) + 1), sizes[order], free, min_rows)]] = True
    if not free and not chosen.any():
        return np.zeros(missing.shape[1], dtype=bool)
    return (lacks[kind] == 0) | np.isin(kind, gaps[chosen])


def kinds(missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each column which kind it is, by its gaps; of each kind its first column, in column order."""
    packed = np.ascontiguousarray(np.packbits(missing, axis=0).T)
    seen: dict[bytes, int] = {}
    kind = np.array([seen.setdefault(row.tobytes(), len(seen)) for row in packed], dtype=int)
    first = np.full(len(seen), len(kind), dtype=int)
    np.minimum.at(first, kind, np.arange(len(kind)))
    return kind, first


def bits(n: int) -> np.ndarray:
    """The bit of each of n columns; the first has the highest."""
    return 1 << np.arange(n - 1, -1, -1, dtype=np.int64)


def all_sets(within: np.ndarray, width: np.ndarray, free: float, min_rows: int) -> np.ndarray:
    """The best column set, from the rows of every mask: sums over all masks outside each set."""
    n = len(width)
    area = np.full(1 << n, free)
    complete = within.astype(float)
    for b, w in zip(bits(n).tolist(), width.tolist(), strict=True):
        complete.reshape(-1, 2, b)[:, 1] += complete.reshape(-1, 2, b)[:, 0]
        area.reshape(-1, 2, b)[:, 1] += w
    complete = complete[::-1]  # by the set whose complement holds the mask
    area = area * complete
    best = np.lexsort((np.arange(1 << n), complete, area, (complete >= min_rows) & (area > 0)))[-1]
    return (best & bits(n)) > 0 if area[best] > 0 else np.zeros(n, dtype=bool)


def depth(holes: np.ndarray) -> np.ndarray:
    """How many columns each row has before its first gap."""
    return np.where(holes.any(axis=1), holes.argmax(axis=1), holes.shape[1]) if holes.shape[1] else np.zeros(len(holes), int)


def best_prefix(depths: np.ndarray, width: np.ndarray, free: float, min_rows: int) -> int:
    """How many of the ranked columns to keep, from the rows of each depth."""
    complete = depths[::-1].cumsum()[::-1]
    area = complete * (free + np.concatenate(([0.0], np.cumsum(width))))
    return int(np.lexsort((np.arange(len(area)), complete, area, (complete >= min_rows) & (area > 0)))[-1]) if area.max() > 0 else 0
