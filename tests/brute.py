"""Brute-force answers on small arrays, written apart from the library."""

import numpy as np


def nearest(sources, targets, labels):
    """{(row, label): distance} over all pairs."""
    d = np.sqrt(((sources[:, None, :] - targets[None, :, :]) ** 2).sum(-1))
    return {(i, l): d[i, labels == l].min() for l in np.unique(labels) for i in range(len(sources))}


def label_matrix(coords, labels, weights=None):
    weights = np.ones(len(coords)) if weights is None else weights
    d = np.sqrt(((coords[:, None, :] - coords[None, :, :]) ** 2).sum(-1))
    names = np.unique(labels)
    near = np.stack([d[:, labels == t].min(axis=1) for t in names], axis=1)
    return names, np.stack([np.average(near[labels == s], axis=0, weights=weights[labels == s]) for s in names])


def average_map(rows):
    """Average-linkage cophenetic map by comparing all member pairs at each step."""
    d = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(-1))
    clusters, out = [[i] for i in range(len(rows))], np.zeros_like(d)
    while len(clusters) > 1:
        h, a, b = min((d[np.ix_(x, y)].mean(), i, j) for i, x in enumerate(clusters)
                      for j, y in enumerate(clusters) if i < j)
        out[np.ix_(clusters[a], clusters[b])] = out[np.ix_(clusters[b], clusters[a])] = h
        clusters[a] = clusters[a] + clusters[b]
        del clusters[b]
    return out / out.max() if out.max() > 0 else out
