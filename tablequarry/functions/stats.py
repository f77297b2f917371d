"""Small numeric routines: distributions, assignment, LSH tuning, size partitions."""

from __future__ import annotations

import math

import numpy as np


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: Stirling's series from 10 on, the recurrence below."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    for _ in range(10):
        small = x < 10
        shift -= np.where(small, np.log(np.where(small, x, 1)), 0)
        x = np.where(small, x + 1, x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)


def hypergeometric_cdf(t: int, population: int, marked: int, drawn: int) -> float:
    """P(X <= t) for X marked ones among `drawn` of `population`."""
    low = max(0, drawn - (population - marked))
    if t < low:
        return 0.0
    choose = lambda n, k: log_gamma(np.asarray(n + 1.0)) - log_gamma(np.asarray(k + 1.0)) - log_gamma(np.asarray(n - k + 1.0))
    k = np.arange(low, min(t, marked, drawn) + 1, dtype=float)
    return min(1.0, float(np.exp(choose(marked, k) + choose(population - marked, drawn - k) - choose(population, drawn)).sum()))


def hypergeometric_cdfs(t: np.ndarray, population: np.ndarray, marked: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """hypergeometric_cdf of many rows at once, some two million terms at a time."""
    t, population, marked, drawn = (np.asarray(x, dtype=np.int64) for x in (t, population, marked, drawn))
    low = np.maximum(0, drawn - (population - marked))
    terms = np.maximum(0, np.minimum(np.minimum(t, marked), drawn) - low + 1)
    logs = lambda n, k: log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)
    all_ = logs(population, drawn)
    out, first = np.zeros(len(t)), 0
    while first < len(t):
        end = max(first + 1, first + int(np.searchsorted(np.cumsum(terms[first:]), 2_000_000, side="right")))
        row = np.repeat(np.arange(first, end), terms[first:end])
        k = np.arange(len(row)) - np.repeat(np.cumsum(terms[first:end]) - terms[first:end], terms[first:end]) + low[row]
        np.add.at(out, row, np.exp(logs(marked[row], k) + logs(population[row] - marked[row], drawn[row] - k) - all_[row]))
        first = end
    return np.minimum(out, 1.0)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    f = 1.0
    for m in range(400):
        k = m // 2
        if m == 0:
            term = 1.0
        elif m % 2 == 0:
            term = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        else:
            term = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 / max(abs(1 + term * d), tiny) * (1 if 1 + term * d >= 0 else -1)
        c = 1 + term / (c if abs(c) > tiny else tiny)
        f *= c * d
        if m and abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1)


def f_cdf(x: float, dfn: float, dfd: float) -> float:
    return 0.0 if x <= 0 else incomplete_beta(dfn / 2, dfd / 2, dfn * x / (dfn * x + dfd))


def hotelling_score(a: np.ndarray, b: np.ndarray) -> float:
    """1 - P(F <= T2 scaled) for two samples of vectors: high where their means agree; -1 where it is undefined."""
    n, m, d = len(a), len(b), a.shape[1]
    if n + m - 2 <= d or min(n, m) < 2:
        return -1.0
    pooled = ((n - 1) * np.cov(a.T) + (m - 1) * np.cov(b.T)).reshape(d, d) / (n + m - 2)
    gap = a.mean(axis=0) - b.mean(axis=0)
    try:
        t2 = n * m / (n + m) * float(gap @ np.linalg.solve(pooled, gap))
    except np.linalg.LinAlgError:
        return -1.0
    dfd = n + m - d - 1
    return 1 - f_cdf(t2 * dfd / (d * (n + m - 2)), d, dfd)


def assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """The matching of rows and columns with the greatest total weight; pairs of weight 0 or less are left out.

    The Hungarian method with potentials on costs -weight, O(n * n * m).
    """
    w = np.maximum(np.asarray(weights, dtype=float), 0)
    turned = w.shape[0] > w.shape[1]
    cost = -(w.T if turned else w)
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0], col = row, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while owner[col]:
            used[col] = True
            free = ~used[1:]
            reduced = cost[owner[col] - 1] - u[owner[col]] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], col
            step = np.where(free, least[1:], np.inf)
            nxt = int(np.argmin(step)) + 1
            delta = step[nxt - 1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            col = nxt
        while col:
            owner[col], col = owner[way[col]], way[col]
    pairs = [(int(owner[c]) - 1, c - 1) for c in range(1, m + 1) if owner[c]]
    return sorted((c, r) if turned else (r, c) for r, c in pairs if w[(c, r) if turned else (r, c)] > 0)


def greedy(weights: np.ndarray, listed: np.ndarray | None = None) -> list[tuple[int, int]]:
    """One-to-one pairs by falling weight; ties by row, then column. listed: the pairs that take part, by default those over 0."""
    w = np.asarray(weights, dtype=float)
    listed = w > 0 if listed is None else listed
    rows, cols, out = set(), set(), []
    for r, c in sorted(np.ndindex(*w.shape), key=lambda p: (-w[p], p)):
        if listed[r, c] and r not in rows and c not in cols:
            rows.add(r)
            cols.add(c)
            out.append((r, c))
    return out


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Rounds as SQL engines do: the scaled number to the nearest whole one, halves upwards; x is not negative."""
    y = np.asarray(x, dtype=float) * 10.0**digits
    low = np.floor(y)
    return (low + (y - low >= 0.5)) / 10.0**digits


def band_errors(threshold: float, bands: int, rows: int, steps: int = 200) -> tuple[float, float]:
    """Areas of false positives below, and false negatives above, a Jaccard threshold."""
    hit = lambda s: 1 - (1 - s**rows) ** bands
    low = (np.arange(steps) + 0.5) / steps * threshold
    high = threshold + (np.arange(steps) + 0.5) / steps * (1 - threshold)
    return float(hit(low).mean() * threshold), float((1 - hit(high)).mean() * (1 - threshold))


def best_bands(threshold: float, num_perm: int, weights: tuple[float, float] = (0.5, 0.5)) -> tuple[int, int]:
    """(bands, rows) with bands * rows <= num_perm and the least weighted error."""
    options = [(b, r) for b in range(1, num_perm + 1) for r in range(1, num_perm // b + 1)]
    return min(options, key=lambda o: (sum(w * e for w, e in zip(weights, band_errors(threshold, *o), strict=True)), o))


def containment_bands(threshold: float, ratio: float, num_perm: int, most_rows: int, steps: int = 100, most_misses: float = 1.0) -> tuple[int, int] | None:
    """(bands, rows), bands * rows <= num_perm, for containment >= threshold when the indexed set is at most `ratio` times the query's size.

    The least expected errors decide, among choices that miss at most a share most_misses of the
    pairs at the threshold; None if there is none.
    """
    t = (np.arange(steps) + 0.5) / steps
    jaccard = np.clip(t / (1 + ratio - t), 0, 1)
    at = min(1.0, threshold / (1 + ratio - threshold)) if 1 + ratio > threshold else 1.0
    ok = t <= max(1.0, ratio)

    def error(b: int, r: int) -> float:
        p = 1 - (1 - jaccard**r) ** b
        return float(np.where(t < threshold, p, 1 - p)[ok].sum())

    options = [(b, r) for r in range(1, most_rows + 1) for b in range(1, num_perm // r + 1) if (1 - at**r) ** b <= most_misses]
    return min(options, key=lambda o: (error(*o), o), default=None)


def size_partitions(sizes: dict[int, int], parts: int) -> list[tuple[int, int]]:
    """Splits set sizes into ranges so that the expected false positives, sum of count * (upper - size) / upper, are least.

    Dynamic programming over the distinct sizes; at most a few thousand reach the driver.
    """
    keys = sorted(sizes)
    n = len(keys)
    count = np.array([sizes[k] for k in keys], dtype=float)
    c0, c1 = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * keys)])
    cost = lambda i, j: (c0[j + 1] - c0[i]) - (c1[j + 1] - c1[i]) / keys[j]
    best = [[cost(0, j) for j in range(n)]]
    back = [[0] * n]
    for _ in range(1, min(parts, n)):
        row, frm = [], []
        for j in range(n):
            options = [(best[-1][i - 1] + cost(i, j), i) for i in range(1, j + 1)] or [(best[-1][j], 0)]
            value, i = min(options)
            row.append(min(value, best[-1][j]))
            frm.append(i if value < best[-1][j] else -1)
        best.append(row)
        back.append(frm)
    out, j, p = [], n - 1, len(best) - 1
    while j >= 0:
        while p and back[p][j] == -1:
            p -= 1
        i = back[p][j] if p else 0
        out.append((keys[i], keys[j]))
        j, p = i - 1, max(0, p - 1)
    return out[::-1]


def hotelling_from_moments(a: dict, b: dict, d: int) -> float:
    """hotelling_score from counts, sums and sums of products."""
    n, m = a["n"], b["n"]
    if n + m - 2 <= d or min(n, m) < 2:
        return -1.0
    means = [np.array(x["sums"]) / x["n"] for x in (a, b)]
    spread = [np.array(x["products"]).reshape(d, d) - x["n"] * np.outer(u, u) for x, u in zip((a, b), means, strict=True)]
    pooled, gap = (spread[0] + spread[1]) / (n + m - 2), means[0] - means[1]
    try:
        t2 = n * m / (n + m) * float(gap @ np.linalg.solve(pooled, gap))
    except np.linalg.LinAlgError:
        return -1.0
    dfd = n + m - d - 1
    return 1 - f_cdf(t2 * dfd / (d * (n + m - 2)), d, dfd)
