"""Mixtures of regressions and Gaussian mixtures by seeded EM, with k chosen by BIC (numpy, one group of rows)."""

from __future__ import annotations

import math

import numpy as np

from shiftscope.functions.numerics import kmeans, silhouette


def _log_normal(r2: np.ndarray, var: np.ndarray) -> np.ndarray:
    return -0.5 * (math.log(2 * math.pi) + np.log(var) + r2 / var)


def regression_mixture(x: np.ndarray, y: np.ndarray, k_max: int = 5, power: int = 1, seed: int = 42, starts: int = 4) -> tuple[np.ndarray, np.ndarray, float]:
    """Labels, posteriors and BIC of the best mixture of regressions (of a Gaussian mixture without columns in x)."""
    x = np.asarray(x, dtype=float).reshape(len(y), -1)
    f = np.hstack([np.ones((len(y), 1)), *(x**p for p in range(1, power + 1))])
    n, best = len(y), None
    rng = np.random.default_rng(seed)
    for k in range(1, k_max + 1):
        for _ in range(starts if k > 1 else 1):
            post = rng.dirichlet(np.ones(k) * 0.5, n)
            last = -math.inf
            for _ in range(200):
                share = post.mean(0) + 1e-9
                w = np.stack([np.linalg.lstsq(f.T @ (f * post[:, [j]]) + 1e-8 * np.eye(f.shape[1]), f.T @ (post[:, j] * y), rcond=None)[0] for j in range(k)], axis=1)
                r2 = (y[:, None] - f @ w) ** 2
                var = np.maximum(1e-4 * np.var(y) + 1e-12, (post * r2).sum(0) / np.maximum(1e-9, post.sum(0)))
                logs = np.log(share / share.sum()) + _log_normal(r2, var)
                top = logs.max(1, keepdims=True)
                whole = top + np.log(np.exp(logs - top).sum(1, keepdims=True))
                post, value = np.exp(logs - whole), float(whole.sum())
                if value - last < 1e-6 * abs(value):
                    break
                last = value
            bic = -2 * value + (k * (f.shape[1] + 2) - 1) * math.log(n)
            if best is None or bic < best[2]:
                best = (post.argmax(1), post, bic)
    return best


def gaussian_mixture(x: np.ndarray, k_max: int = 5, seed: int = 42, starts: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """Labels, posteriors and BIC of the best full-covariance Gaussian mixture."""
    n, d = x.shape
    best = None
    for k in range(1, k_max + 1):
        for s in range(starts if k > 1 else 1):
            post = np.eye(k)[kmeans(x, k, seed + s, 1)[0]] * 0.9 + 0.1 / k
            last = -math.inf
            for _ in range(200):
                weight = post.sum(0) + 1e-9
                mean = post.T @ x / weight[:, None]
                logs = np.empty((n, k))
                for j in range(k):
                    c = x - mean[j]
                    cov = (c * post[:, [j]]).T @ c / weight[j] + 1e-6 * np.eye(d) * max(1e-6, float(x.var()))
                    low = np.linalg.cholesky(cov)
                    a = np.linalg.solve(low, c.T)
                    logs[:, j] = math.log(weight[j] / n) - 0.5 * (a * a).sum(0) - np.log(np.diag(low)).sum() - d / 2 * math.log(2 * math.pi)
                top = logs.max(1, keepdims=True)
                whole = top + np.log(np.exp(logs - top).sum(1, keepdims=True))
                post, value = np.exp(logs - whole), float(whole.sum())
                if value - last < 1e-6 * abs(value):
                    break
                last = value
            bic = -2 * value + (k * (d + d * (d + 1) / 2) + k - 1) * math.log(n)
            if best is None or bic < best[2]:
                best = (post.argmax(1), post, bic)
    return best


def kmeans_or_one(x: np.ndarray, k_max: int = 5, floor: float = 0.5, seed: int = 42) -> np.ndarray:
    """k-means labels with k by silhouette; one cluster if none reaches the floor."""
    keep = np.sort(np.random.default_rng(seed).choice(len(x), min(len(x), 600), replace=False))
    best = (floor, np.zeros(len(x), dtype=int))
    for k in range(2, k_max + 1):
        labels = kmeans(x, k, seed, 3)[0]
        if (value := silhouette(x[keep], labels[keep])) > best[0]:
            best = (value, labels)
    return best[1]


def dbscan(x: np.ndarray, radius: float, least: int) -> np.ndarray:
    """Density clusters; -1 is noise."""
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= radius * radius
    core = near.sum(1) >= least
    labels, name = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if labels[i] >= 0:
            continue
        stack = [i]
        labels[i] = name
        while stack:
            j = stack.pop()
            if core[j]:
                for m in np.flatnonzero(near[j] & (labels < 0)):
                    labels[m] = name
                    stack.append(m)
        name += 1
    return labels


def spectral(affinity: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Clusters of a small affinity matrix by its normalised leading eigenvectors."""
    degree = np.sqrt(np.maximum(1e-12, affinity.sum(1)))
    _, v = np.linalg.eigh(affinity / degree[:, None] / degree[None])
    u = v[:, -k:]
    return kmeans(u / np.maximum(1e-12, np.linalg.norm(u, axis=1, keepdims=True)), k, seed)[0]


def complete_linkage(distance: np.ndarray, k: int) -> np.ndarray:
    """Agglomerative clusters of a small distance matrix."""
    groups = [[i] for i in range(len(distance))]
    while len(groups) > k:
        _, a, b = min((distance[np.ix_(g, h)].max(), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        groups[a] += groups.pop(b)
    out = np.empty(len(distance), dtype=int)
    for c, g in enumerate(sorted(groups, key=min)):
        out[g] = c
    return out


def class_regressions(x: np.ndarray, y: np.ndarray, labels: np.ndarray) -> dict[int, tuple[np.ndarray, float]]:
    """Per label the regression through the origin and the root mean squared residual."""
    out = {}
    x = np.asarray(x, dtype=float).reshape(len(y), -1)
    for name in np.unique(labels):
        own = labels == name
        w = np.linalg.lstsq(x[own], y[own], rcond=None)[0]
        out[int(name)] = (w, float(np.sqrt(((y[own] - x[own] @ w) ** 2).mean())))
    return out


def known_labels_bic(x: np.ndarray, y: np.ndarray, labels: np.ndarray) -> float:
    """BIC of one linear Gaussian mechanism per known label, with the labels' shares."""
    x = np.asarray(x, dtype=float).reshape(len(y), -1)
    f = np.hstack([np.ones((len(y), 1)), x])
    total, names = 0.0, np.unique(labels)
    for name in names:
        own = labels == name
        r = y[own] - f[own] @ np.linalg.lstsq(f[own], y[own], rcond=None)[0]
        total += float(_log_normal(r**2, np.full(own.sum(), max(1e-12, r.var()))).sum()) + own.sum() * math.log(own.mean())
    return -2 * total + (len(names) * (f.shape[1] + 2) - 1) * math.log(len(y))


def latent_score(x: np.ndarray, y: np.ndarray, k_max: int = 5, seed: int = 42) -> tuple[float, np.ndarray]:
    """The best mixture's BIC (higher is better, so that searches can use it) and its labels."""
    labels, _, bic = regression_mixture(x, y, k_max, seed=seed) if np.asarray(x).size else gaussian_mixture(np.asarray(y, dtype=float).reshape(-1, 1), k_max, seed)
    return -bic / 2, labels


def best_for_truth(x: np.ndarray, y: np.ndarray, true: np.ndarray, k_max: int = 5, seed: int = 42) -> tuple[np.ndarray, float]:
    """Among mixtures with 1, 2, ... components the labels that agree most with the true ones, by adjusted mutual information."""
    from shiftscope.functions.numerics import information_scores

    best = (np.zeros(len(y), dtype=int), -math.inf)
    for k in range(1, k_max + 1):
        labels = _exactly(x, y, k, seed)
        score = information_scores(true, labels)["ami"]
        if score > best[1]:
            best = (labels, score)
    return best


def _exactly(x: np.ndarray, y: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Labels of a regression mixture with k components, started from k-means of the target and its parents."""
    x = np.asarray(x, dtype=float).reshape(len(y), -1)
    f = np.hstack([np.ones((len(y), 1)), x])
    best = (-math.inf, np.zeros(len(y), dtype=int))
    rng = np.random.default_rng(seed)
    for _ in range(4):
        post = rng.dirichlet(np.ones(k) * 0.5, len(y)) if k > 1 else np.ones((len(y), 1))
        last = -math.inf
        for _ in range(200):
            w = np.stack([np.linalg.lstsq(f.T @ (f * post[:, [j]]) + 1e-8 * np.eye(f.shape[1]), f.T @ (post[:, j] * y), rcond=None)[0] for j in range(k)], axis=1)
            r2 = (y[:, None] - f @ w) ** 2
            var = np.maximum(1e-4 * np.var(y) + 1e-12, (post * r2).sum(0) / np.maximum(1e-9, post.sum(0)))
            logs = np.log(post.mean(0) + 1e-12) + _log_normal(r2, var)
            top = logs.max(1, keepdims=True)
            whole = top + np.log(np.exp(logs - top).sum(1, keepdims=True))
            post, value = np.exp(logs - whole), float(whole.sum())
            if value - last < 1e-6 * abs(value):
                break
            last = value
        if value > best[0]:
            best = (value, post.argmax(1))
    return best[1]


def matched_components(true: list[tuple[np.ndarray, np.ndarray]], found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[tuple[int, int]], float]:
    """The assignment of found components (mean, covariance) to true ones with the least summed absolute error, and that error."""
    from shiftscope.functions.numerics import assign

    cost = np.array([[np.abs(m - a).sum() + np.abs(c - b).sum() for a, b in found] for m, c in true])
    pairs = assign(-cost)
    return pairs, float(sum(cost[i, j] for i, j in pairs))


def component_moments(x: np.ndarray, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance of every label's rows."""
    return [(x[labels == c].mean(0), np.cov(x[labels == c].T, bias=True).reshape(x.shape[1], -1)) for c in np.unique(labels)]


def hierarchical_density(x: np.ndarray, least: int = 5) -> np.ndarray:
    """Clusters that persist longest as the density falls, -1 for noise: a spanning tree of mutual reachability, condensed at ``least`` rows."""
    x = np.asarray(x, dtype=float)
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(least, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    # Prim's tree, then single linkage in order of its edges
    inside, best, via, edges = np.zeros(n, dtype=bool), np.full(n, np.inf), np.zeros(n, dtype=int), []
    v = 0
    for _ in range(n - 1):
        inside[v] = True
        closer = ~inside & (reach[v] < best)
        best[closer], via[closer] = reach[v][closer], v
        v = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[v], int(via[v]), v))
    parent, members, root = {}, {i: [i] for i in range(n)}, list(range(n))

    def top(i: int) -> int:
        while i in parent:
            i = parent[i]
        return i

    children: dict[int, tuple[int, int, float]] = {}
    name = n
    for w, a, b in sorted(edges):
        a, b = top(root[a]), top(root[b])
        children[name] = (a, b, 1 / max(w, 1e-12))
        members[name] = members[a] + members[b]
        parent[a] = parent[b] = name
        name += 1

    def choose(node: int, birth: float) -> tuple[float, list[list[int]]]:
        """Stability of the best clusters under a node that became a cluster at this density."""
        own, at = 0.0, node
        while True:
            if at < n:
                return own, [members[node]]
            a, b, density = children[at]
            big = [c for c in (a, b) if len(members[c]) >= least]
            own += (density - birth) * (len(members[at]) - sum(len(members[c]) for c in big))
            if len(big) == 2:
                own += (density - birth) * len(members[at])
                (va, ca), (vb, cb) = choose(a, density), choose(b, density)
                return (va + vb, ca + cb) if va + vb > own else (own, [members[node]])
            if not big:
                return own, [members[node]]
            at = big[0]

    labels = np.full(n, -1)
    if n > 1:
        a, b, density = children[name - 1]
        parts = choose(name - 1, 0.0)[1]
        for k, part in enumerate(parts):
            labels[part] = k
    return labels


def cluster(x: np.ndarray, method: str, k_max: int = 5, seed: int = 42) -> np.ndarray:
    """Labels by name: gmm, kmeans, spectral, dbscan, hdbscan or random."""
    x = np.asarray(x, dtype=float).reshape(len(x), -1)
    if method == "gmm":
        return gaussian_mixture(x, k_max, seed)[0]
    if method == "kmeans":
        return kmeans_or_one(x, k_max, seed=seed)
    if method == "hdbscan":
        return hierarchical_density(x, max(5, len(x) // 20))
    if method == "random":
        return np.random.default_rng(seed).integers(0, k_max, len(x))
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    if method == "dbscan":
        near = np.sort(np.sqrt(d2), axis=1)[:, min(5, len(x) - 1)]
        return dbscan(x, float(np.quantile(near, 0.9)), 5)
    if method == "spectral":
        affinity = np.exp(-d2 / (2 * np.median(d2[d2 > 0])))
        options = [spectral(affinity, k, seed) for k in range(2, k_max + 1)]
        return max(options, key=lambda labels: silhouette(x, labels))
    raise ValueError(f"unknown method {method}")


def pruned_parents(x: np.ndarray, y: np.ndarray, labels: np.ndarray) -> list[int]:
    """Parents (columns of x) that still lower the BIC once the hidden labels are known."""
    held = list(range(x.shape[1]))
    for p in list(held):
        rest = [q for q in held if q != p]
        if known_labels_bic(x[:, rest], y, labels) <= known_labels_bic(x[:, held], y, labels):
            held = rest
    return held
