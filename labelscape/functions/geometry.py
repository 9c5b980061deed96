"""Small vectorised geometry helpers used inside Spark tasks.

Everything here works on one bounded chunk of coordinates at a time; Spark decides which
chunks meet (see ``labelscape.operators.nearest``).
"""

from __future__ import annotations

import numpy as np

SOURCE_CHUNK = 128
TARGET_CHUNK = 16
FEW_TARGETS = 512
PAIRS_AT_ONCE = 20_000
#: Targets that a run of source rows meets at once in the search for k; a run in a wider box is halved first.
MOST_TARGETS = 2048
SLACK = 1.0 + 1e-9


def scale_of(coords: np.ndarray) -> tuple[np.ndarray, float]:
    """Lower corner and common span of all axes, so that runs of the order fill compact boxes."""
    low = coords.min(axis=0)
    return low, float((coords.max(axis=0) - low).max()) or 1.0


def morton_codes(coords: np.ndarray, scale: tuple[np.ndarray, float]) -> np.ndarray:
    """Position along a Z-order curve; rows outside the scale's box count as on its border."""
    low, span = scale
    dims = coords.shape[1]
    bits = 62 // dims
    cells = np.clip((coords - low) / span * (2.0**bits - 1), 0, 2.0**bits - 1).astype(np.uint64)
    code = np.zeros(len(coords), dtype=np.uint64)
    for axis in range(dims):
        part, width = cells[:, axis], 32
        while width >= 1 and dims > 1:  # leave dims - 1 zero bits between neighbouring bits
            shift = width * (dims - 1)
            if shift < 63:
                mask = sum(((1 << width) - 1) << start for start in range(0, 63, width * dims)) & ((1 << 63) - 1)
                part = (part | (part << np.uint64(shift))) & np.uint64(mask)
            width //= 2
        code |= part << np.uint64(axis)
    return code


def morton_order(coords: np.ndarray) -> np.ndarray:
    """Row order that keeps neighbours in space close together."""
    if len(coords) == 0:
        return np.empty(0, dtype=np.int64)
    return np.argsort(morton_codes(coords, scale_of(coords)), kind="stable")


def chunk_starts(n: int, size: int) -> np.ndarray:
    return np.arange(0, n, size, dtype=np.int64)


def chunk_bounds(coords: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounding box of every chunk that begins at ``starts``."""
    return np.minimum.reduceat(coords, starts, axis=0), np.maximum.reduceat(coords, starts, axis=0)


class TargetCloud:
    """Target points of one label, cut into chunks with bounding boxes.

    ``factor`` optionally scales every distance to a target point (expression weighting).
    """

    def __init__(self, coords, starts=None, ids=None, factor=None):
        coords = np.ascontiguousarray(coords, dtype=float)
        if starts is None:
            order = morton_order(coords)
            coords = coords[order]
            ids = ids[order] if ids is not None else None
            factor = factor[order] if factor is not None else None
            starts = chunk_starts(len(coords), TARGET_CHUNK)
        self.coords, self.starts, self.ids, self.factor = coords, starts, ids, factor
        self.stops = np.append(starts[1:], len(coords))
        self.sizes = self.stops - starts
        self.low, self.high = chunk_bounds(coords, starts)
        self.min_factor = None if factor is None else np.minimum.reduceat(factor, starts)
        self.scale = scale_of(coords)
        self.first_codes = morton_codes(coords[starts], self.scale)

    def likely_chunk(self, source: np.ndarray) -> np.ndarray:
        """The chunk each source row would fall into along the curve."""
        at = np.searchsorted(self.first_codes, morton_codes(source, self.scale), side="right") - 1
        return np.maximum(at, 0)

    def bounds_to(self, low: np.ndarray, high: np.ndarray, chunks: slice | np.ndarray = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest possible (scaled) distance from a source box to each chunk, or to some."""
        own_low, own_high = self.low[chunks], self.high[chunks]
        near = np.maximum(0.0, np.maximum(own_low - high, low - own_high))
        far = np.maximum(np.abs(own_high - low), np.abs(high - own_low))
        near, far = np.sqrt((near * near).sum(axis=1)), np.sqrt((far * far).sum(axis=1))
        if self.min_factor is not None:
            near, far = near * self.min_factor[chunks], far * self.min_factor[chunks]
        return near, far

    def gather(self, chunks: np.ndarray) -> np.ndarray:
        """Row positions of all points in the given chunks."""
        sizes = self.sizes[chunks]
        offsets = np.repeat(self.starts[chunks] - np.append(0, np.cumsum(sizes)[:-1]), sizes)
        return np.arange(sizes.sum()) + offsets


def pairwise(source: np.ndarray, target: np.ndarray, factor=None) -> np.ndarray:
    """Euclidean distances from every source row to every target row."""
    total = np.subtract.outer(source[:, 0], target[:, 0])
    total *= total
    for axis in range(1, source.shape[1]):
        step = np.subtract.outer(source[:, axis], target[:, axis])
        step *= step
        total += step
    np.sqrt(total, out=total)
    if factor is not None:
        total *= factor
    return total


def _meet(source: np.ndarray, rows: np.ndarray, chunks: np.ndarray, cloud: TargetCloud, best: np.ndarray) -> None:
    """Lower ``best`` of the given source rows (ascending) by one target chunk each."""
    for at in range(0, len(rows), PAIRS_AT_ONCE):
        r, c = rows[at:at + PAIRS_AT_ONCE], chunks[at:at + PAIRS_AT_ONCE]
        sizes = cloud.sizes[c]
        hit = cloud.gather(c)
        gap = np.repeat(source[r], sizes, axis=0)
        gap -= cloud.coords[hit]
        gap *= gap
        dist = np.sqrt(gap.sum(axis=1))
        if cloud.factor is not None:
            dist *= cloud.factor[hit]
        firsts = np.append(0, np.cumsum(sizes)[:-1])
        new_row = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        found = np.minimum.reduceat(dist, firsts[new_row])
        best[r[new_row]] = np.minimum(best[r[new_row]], found)


def lower_to_likely(source: np.ndarray, cloud: TargetCloud, best: np.ndarray) -> None:
    """Let every row meet the one chunk at its own place along the curve."""
    _meet(source, np.arange(len(source)), cloud.likely_chunk(source), cloud, best)


def lower_to_nearest(source: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray,
                     cloud: TargetCloud, best: np.ndarray) -> None:
    """Fold one target cloud into ``best``, the running smallest distance per source row.

    Every row first meets the chunk at its own place along the curve, which gives a good bound. Then
    chunks are ruled out by their boxes, for a whole source chunk at once and after that row by row.
    """
    stops = np.append(starts[1:], len(source))
    if len(cloud.coords) > 4 * FEW_TARGETS:
        lower_to_likely(source, cloud, best)
    for i in range(len(starts)):
        a, b = starts[i], stops[i]
        part, own = source[a:b], best[a:b]
        near, far = cloud.bounds_to(low[i], high[i])
        chosen = np.flatnonzero(near <= min(far.min(), own.max()) * SLACK)
        if not len(chosen):
            continue
        if cloud.sizes[chosen].sum() <= FEW_TARGETS:
            hit = cloud.gather(chosen)
            scale = None if cloud.factor is None else cloud.factor[hit]
            np.minimum(own, pairwise(part, cloud.coords[hit], scale).min(axis=1), out=own)
            continue
        square = np.zeros((b - a, len(chosen)))
        for axis in range(part.shape[1]):
            x = part[:, axis, None]
            gap = np.maximum(cloud.low[chosen, axis] - x, x - cloud.high[chosen, axis])
            np.maximum(gap, 0.0, out=gap)
            gap *= gap
            square += gap
        np.sqrt(square, out=square)
        if cloud.min_factor is not None:
            square *= cloud.min_factor[chosen]
        rows, more = np.nonzero(square <= own[:, None] * SLACK)
        if len(rows):
            _meet(part, rows, chosen[more], cloud, own)


def merge_k_nearest(source: np.ndarray, own: np.ndarray, starts: np.ndarray, low: np.ndarray,
                    high: np.ndarray, cloud: TargetCloud, best: np.ndarray,
                    best_ids: np.ndarray) -> None:
    """Fold one target cloud into the running ``k`` nearest other points per source row.

    Order is (distance, target id); a target whose id equals the source's own id is skipped.
    ``best`` has shape (rows, k) and holds ``inf`` where fewer than k are known.
    """
    stops = np.append(starts[1:], len(source))
    for i in range(len(starts)):
        _merge_run(source, own, starts[i], stops[i], low[i], high[i], cloud, np.arange(len(cloud.sizes)), best, best_ids)


def _merge_run(source, own, a: int, b: int, low, high, cloud: TargetCloud, among: np.ndarray, best, best_ids) -> None:
    """Rows a to b meet those of the given chunks that may matter, nearest first, a bounded number of targets at a time.

    A run whose box is so wide that many chunks may matter (at a jump of the curve, say) is halved; the halves look at its chunks only.
    """
    k = best.shape[1]
    near, far = cloud.bounds_to(low, high, among)
    sizes = cloud.sizes[among]
    cutoff = best[a:b, -1].max()
    by_far = np.argsort(far, kind="stable")
    reached = np.searchsorted(np.cumsum(sizes[by_far]), k + 1)
    if reached < len(by_far):
        cutoff = min(cutoff, far[by_far[reached]])
    keep = np.flatnonzero(near <= cutoff * SLACK)
    if b - a > 1 and sizes[keep].sum() > MOST_TARGETS and (low < high).any():
        middle = (a + b) // 2
        for i, j in ((a, middle), (middle, b)):
            _merge_run(source, own, i, j, source[i:j].min(axis=0), source[i:j].max(axis=0), cloud, among[keep], best, best_ids)
        return
    keep = keep[np.argsort(near[keep], kind="stable")]
    slab = np.cumsum(sizes[keep]) // MOST_TARGETS
    for part in np.split(keep, np.flatnonzero(np.diff(slab)) + 1):
        if not len(part) or near[part[0]] > best[a:b, -1].max() * SLACK:
            return
        rows = cloud.gather(among[part])
        best[a:b], best_ids[a:b] = _merged(source[a:b], own[a:b], cloud.coords[rows], cloud.ids[rows], best[a:b], best_ids[a:b], k)


def _merged(source, own, coords, ids, best, best_ids, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest among those known so far and some more targets."""
    dist = pairwise(source, coords)
    dist[own[:, None] == ids[None, :]] = np.inf
    dist = np.concatenate([best, dist], axis=1)
    all_ids = np.concatenate([best_ids, np.broadcast_to(ids, (len(source), len(ids)))], axis=1)
    kth = np.partition(dist, k - 1, axis=1)[:, k - 1]
    row, col = np.nonzero((dist <= kth[:, None]) & np.isfinite(dist))
    d, t = dist[row, col], all_ids[row, col]
    order = np.lexsort((t, d, row))
    row, d, t = row[order], d[order], t[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    keep = rank < k
    fresh = np.full((len(source), k), np.inf)
    fresh_ids = np.zeros((len(source), k), dtype=best_ids.dtype)
    fresh[row[keep], rank[keep]] = d[keep]
    fresh_ids[row[keep], rank[keep]] = t[keep]
    return fresh, fresh_ids
