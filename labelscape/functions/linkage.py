"""Agglomerative clustering of one bounded label matrix, and cophenetic distances.

Rows of the matrix are observation vectors. The pair with the smallest distance merges next;
ties go to the lower slot pair, a merged cluster keeps the lower slot. New cluster ids count up
from the number of leaves, the smaller id is the left child.
"""

from __future__ import annotations

import numpy as np

METHODS = ("average", "single", "complete", "weighted", "ward", "centroid", "median")
METRICS = ("euclidean", "sqeuclidean", "cityblock", "chebyshev", "cosine", "correlation")


def row_distances(rows: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Square matrix of distances between the rows."""
    rows = np.asarray(rows, dtype=float)
    if metric == "correlation":
        rows = rows - rows.mean(axis=1, keepdims=True)
    if metric in {"cosine", "correlation"}:
        norms = np.sqrt((rows * rows).sum(axis=1))
        out = 1.0 - rows @ rows.T / np.outer(norms, norms)
    else:
        out = np.zeros((len(rows), len(rows)))
        for i in range(len(rows)):
            gap = np.abs(rows - rows[i])
            if metric == "euclidean":
                out[i] = np.sqrt((gap * gap).sum(axis=1))
            elif metric == "sqeuclidean":
                out[i] = (gap * gap).sum(axis=1)
            elif metric == "cityblock":
                out[i] = gap.sum(axis=1)
            elif metric == "chebyshev":
                out[i] = gap.max(axis=1)
            else:
                raise ValueError(f"metric {metric!r} is not known: {', '.join(METRICS)}")
    np.fill_diagonal(out, 0.0)
    return out


def _joined(method, to_i, to_j, between, n_i, n_j, n_k):
    """Distance from a merged cluster (i, j) to every other cluster k."""
    if method == "single":
        return np.minimum(to_i, to_j)
    if method == "complete":
        return np.maximum(to_i, to_j)
    if method == "average":
        return (n_i * to_i + n_j * to_j) / (n_i + n_j)
    if method == "weighted":
        return 0.5 * (to_i + to_j)
    n = n_i + n_j
    if method == "centroid":
        square = (n_i * to_i**2 + n_j * to_j**2) / n - n_i * n_j * between**2 / n**2
    elif method == "median":
        square = 0.5 * (to_i**2 + to_j**2) - 0.25 * between**2
    elif method == "ward":
        square = ((n_k + n_i) * to_i**2 + (n_k + n_j) * to_j**2 - n_k * between**2) / (n + n_k)
    else:
        raise ValueError(f"clustering method {method!r} is not known: {', '.join(METHODS)}")
    return np.sqrt(np.maximum(square, 0.0))


def linkage(distances: np.ndarray, method: str = "average") -> np.ndarray:
    """Merge table (left id, right id, height, leaves) from a square distance matrix."""
    if method not in METHODS:
        raise ValueError(f"clustering method {method!r} is not known: {', '.join(METHODS)}")
    n = len(distances)
    if n < 2:
        raise ValueError("clustering needs at least two labels")
    if not np.isfinite(distances).all():
        raise ValueError("the distance matrix has missing or non-finite values")
    work = distances.astype(float).copy()
    np.fill_diagonal(work, np.inf)
    size, name = np.ones(n), np.arange(n)
    nearest = work.min(axis=1)
    merges = np.zeros((n - 1, 4))
    for step in range(n - 1):
        i = int(nearest.argmin())
        j = int(work[i].argmin())
        i, j = min(i, j), max(i, j)
        height = work[i, j]
        merges[step] = (min(name[i], name[j]), max(name[i], name[j]), height, size[i] + size[j])
        # slots that are merged away are at infinity from everything, and stay there
        to_i, to_j = work[i].copy(), work[j].copy()
        to_i[j] = to_j[i] = np.inf
        fresh = _joined(method, to_i, to_j, height, size[i], size[j], size)
        stale = (nearest >= np.minimum(to_i, to_j)) & (nearest < np.inf)
        stale[i] = stale[j] = False
        size[i] += size[j]
        name[i] = n + step
        work[j, :] = work[:, j] = np.inf
        work[i, :] = work[:, i] = fresh
        nearest[j] = np.inf
        nearest[i] = fresh.min()
        np.minimum(nearest, fresh, out=nearest)
        again = np.flatnonzero(stale)
        if len(again):
            nearest[again] = work[again].min(axis=1)
    return merges


def cophenetic(merges: np.ndarray) -> np.ndarray:
    """Square matrix: height at which two leaves first share a cluster."""
    n = len(merges) + 1
    members = {i: [i] for i in range(n)}
    out = np.zeros((n, n))
    for step, (left, right, height, _) in enumerate(merges):
        a, b = members.pop(int(left)), members.pop(int(right))
        out[np.ix_(a, b)] = out[np.ix_(b, a)] = height
        members[n + step] = a + b
    return out


def cophenetic_row(merges: np.ndarray, leaf: int) -> np.ndarray:
    """One leaf's row of ``cophenetic``: a cluster that joins the leaf's own is as far away as it joins high."""
    n = len(merges) + 1
    members = {i: [i] for i in range(n)}
    out, own = np.zeros(n), leaf
    for step, (left, right, height, _) in enumerate(merges):
        a, b = int(left), int(right)
        if own in (a, b):
            out[members[b if own == a else a]] = height
            own = n + step
        members[n + step] = members.pop(a) + members.pop(b)
    return out


def with_one_more(squares: np.ndarray, rows: np.ndarray, out: np.ndarray, back: np.ndarray, at: int) -> np.ndarray:
    """Row distances of a matrix that gets one more row (``out``) and column (``back``) at ``at``, from the squared row distances it has.

    Every old pair gains the square of its difference in the new column; only the new row is computed over all columns.
    """
    n = len(rows)
    old = np.subtract.outer(back, back)
    old *= old
    old += squares
    np.sqrt(old, out=old)
    grown = np.zeros((n + 1, n + 1))
    grown[:at, :at], grown[:at, at + 1:] = old[:at, :at], old[:at, at:]
    grown[at + 1:, :at], grown[at + 1:, at + 1:] = old[at:, :at], old[at:, at:]
    gap = rows - out
    new = np.sqrt(np.einsum("ij,ij->i", gap, gap) + back * back)
    grown[at, :at], grown[at, at + 1:] = new[:at], new[at:]
    grown[:at, at], grown[at + 1:, at] = new[:at], new[at:]
    return grown


def cophenetic_correlation(distances: np.ndarray, heights: np.ndarray) -> float:
    upper = np.triu_indices(len(distances), 1)
    return float(np.corrcoef(distances[upper], heights[upper])[0, 1])


def unit_scaled(square: np.ndarray) -> np.ndarray:
    """Scale all entries, zero diagonal included, to [0, 1]; a constant matrix stays as it is."""
    low, high = square.min(), square.max()
    return square if low == high else (square - low) / (high - low)


def structure_map(rows: np.ndarray, method: str = "average") -> np.ndarray:
    return unit_scaled(cophenetic(linkage(row_distances(rows), method)))


def leaf_order(merges: np.ndarray) -> list[int]:
    """Leaves from left to right in the drawn tree."""
    n = len(merges) + 1
    order, stack = [], [2 * n - 2]
    while stack:
        node = stack.pop()
        if node < n:
            order.append(node)
        else:
            stack += [int(merges[node - n, 1]), int(merges[node - n, 0])]
    return order


def newick(merges: np.ndarray, names: list[str]) -> str:
    """Tree as text with six-decimal branch lengths."""
    n = len(names)
    text = {i: names[i] for i in range(n)}
    height = {i: 0.0 for i in range(n)}
    for step, (left, right, level, _) in enumerate(merges):
        parts = [f"{text[int(c)]}:{level - height[int(c)]:.6f}" for c in (left, right)]
        text[n + step], height[n + step] = f"({','.join(parts)})", level
    return f"{text[2 * n - 2]}:{0.0:.6f};"
