"""Numeric kernels that have no relational form: numpy only, called per group through Arrow or on small tables."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np



def histogram_bootstrap(values: np.ndarray, counts: np.ndarray, draws: int = 10_000, seed: int = 1, level: float = 0.95) -> tuple[float, float, float]:
    """Mean and percentile interval of values that occur ``counts`` times.  Drawing n of n values with replacement changes only how often
    each occurs, so one draw is one multinomial over the distinct values, whatever their order and number."""
    values, counts = np.asarray(values, float), np.asarray(counts, np.int64)
    n = int(counts.sum())
    if not n:
        return math.nan, math.nan, math.nan
    means = np.random.default_rng(seed).multinomial(n, counts / n, size=draws) @ (values / n)
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return float(values @ counts / n), float(low), float(high)


def cluster_weights(cluster_seed: int, draws: int) -> np.ndarray:
    """How often a cluster is drawn in each resample: independent Poisson weights, so clusters of different tasks need not meet."""
    return np.random.default_rng(cluster_seed).poisson(1.0, draws)


def bisect(f, low: float, high: float, steps: int = 200) -> float:
    """A root between two points of opposite sign."""
    sign = f(low) > 0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if (f(middle) > 0) == sign else (low, middle)
    return (low + high) / 2


def paired_score(b: np.ndarray, c: np.ndarray, n: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """Score statistics of the hypotheses that the shares of two paired outcomes differ by ``delta``, for arrays of tables with ``b`` and ``c``
    discordant cases of ``n``.

    Under the hypothesis the second discordant share ``q`` is the positive root of ``2 n q^2 - h q - c delta (1 - delta) = 0`` with
    ``h = b + c - (2 n - b + c) delta``; of the two forms of a root the one without cancellation is taken.
    """
    b, c, n, delta = np.broadcast_arrays(*(np.asarray(x, float) for x in (b, c, n, delta)))
    h, product = b + c - (2 * n - b + c) * delta, c * delta * (1 - delta)
    spread = np.hypot(h, np.sqrt(np.maximum(8 * n * product, 0.0)))
    spread = np.where(product < 0, np.sqrt(np.maximum(h * h + 8 * n * product, 0.0)), spread)
    with np.errstate(divide="ignore", invalid="ignore"):
        q = np.where(h >= 0, (h + spread) / (4 * n), 2 * product / (spread - h))
        z = (b - c - n * delta) / np.sqrt(n * np.maximum(2 * np.nan_to_num(q) + delta * (1 - delta), 0.0))
    return np.nan_to_num(z, nan=0.0, posinf=np.inf, neginf=-np.inf)


def paired_score_interval(b: np.ndarray, c: np.ndarray, n: np.ndarray, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Differences that the score test does not reject, for arrays of tables.  The search runs over ``atanh`` of the difference, where the ends
    -1 and 1 are infinitely far: a statistic that never reaches the quantile leads there by itself."""
    b, c, n = (np.asarray(x, float) for x in (b, c, n))
    z = NormalDist().inv_cdf((1 + level) / 2)
    middle = np.arctanh(np.clip((b - c) / n, -1 + 1e-15, 1 - 1e-15))

    def edge(side: float) -> np.ndarray:
        near, far = middle.copy(), np.full(middle.shape, side * 19.0)
        for _ in range(90):
            half = (near + far) / 2
            inside = np.abs(paired_score(b, c, n, np.tanh(half))) < z
            near, far = np.where(inside, half, near), np.where(inside, far, half)
        return np.tanh(near)

    return edge(-1.0), edge(1.0)


def equivalence_p(b: np.ndarray, c: np.ndarray, n: np.ndarray, margin: float) -> np.ndarray:
    """Whether a paired difference lies within the margin: the larger p value of the two one-sided score tests."""
    normal = np.vectorize(NormalDist().cdf, otypes=[float])
    return np.maximum(normal(-paired_score(b, c, n, -margin)), normal(paired_score(b, c, n, margin)))


def student_quantile(p: float, df: int) -> float:
    """Quantile of Student's t by bisection on a Simpson integral of its density."""
    if p < 0.5:
        return -student_quantile(1 - p, df)
    log_c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)

    def upper(t: float) -> float:
        u = np.linspace(0, math.atan(t / math.sqrt(df)), 2001)  # t = sqrt(df) tan u
        y = math.exp(log_c) * math.sqrt(df) * np.cos(u) ** (df - 1)
        h = u[1] - u[0]
        return float(h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()))

    return bisect(lambda t: upper(t) - (p - 0.5), 0.0, 1e6)


def t_interval(values: np.ndarray, level: float = 0.95) -> tuple[float, float, float]:
    v = np.asarray(values, float)
    half = student_quantile((1 + level) / 2, len(v) - 1) * v.std(ddof=1) / math.sqrt(len(v))
    return float(v.mean()), float(v.mean() - half), float(v.mean() + half)


def pearson(x: np.ndarray, y: np.ndarray) -> float | None:
    """Correlation; none for fewer than three pairs or without spread."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(x) < 3 or x.std() == 0 or y.std() == 0:
        return None
    return float(np.corrcoef(x, y)[0, 1])


def gee_logit(y: np.ndarray, x: np.ndarray, clusters: np.ndarray, rounds: int = 50, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression with exchangeable correlation within clusters: coefficients and robust standard errors, corrected
    for the leverage of clusters (bias-reduced sandwich)."""
    y, x = np.asarray(y, float), np.asarray(x, float)
    groups = [np.flatnonzero(clusters == c) for c in np.unique(clusters)]
    beta = np.zeros(x.shape[1])
    rho, bread = 0.0, np.eye(x.shape[1])
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-x @ beta))
        s = np.sqrt(np.clip(mu * (1 - mu), 1e-12, None))
        r = (y - mu) / s
        pairs = sum(len(g) * (len(g) - 1) / 2 for g in groups) - x.shape[1]
        phi = (r**2).sum() / max(1, len(y) - x.shape[1])
        cross = sum((r[g].sum() ** 2 - (r[g] ** 2).sum()) / 2 for g in groups)
        rho = float(np.clip(cross / max(1.0, pairs) / max(phi, 1e-12), -0.9, 0.95))
        bread, push = np.zeros((x.shape[1], x.shape[1])), np.zeros(x.shape[1])
        for g in groups:
            d = x[g] * (s[g] ** 2)[:, None]
            w = np.linalg.pinv(np.outer(s[g], s[g]) * (rho + (1 - rho) * np.eye(len(g))))
            bread += d.T @ w @ d
            push += d.T @ w @ (y[g] - mu[g])
        step = np.linalg.solve(bread + 1e-12 * np.eye(len(beta)), push)
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    inverse, meat = np.linalg.pinv(bread), np.zeros_like(bread)
    mu = 1 / (1 + np.exp(-x @ beta))
    s = np.sqrt(np.clip(mu * (1 - mu), 1e-12, None))
    for g in groups:
        d = x[g] * (s[g] ** 2)[:, None]
        w = np.linalg.pinv(np.outer(s[g], s[g]) * (rho + (1 - rho) * np.eye(len(g))))
        fair = np.linalg.pinv(np.eye(len(g)) - d @ inverse @ d.T @ w)
        u = d.T @ w @ fair @ (y[g] - mu[g])
        meat += np.outer(u, u)
    return beta, np.sqrt(np.diag(inverse @ meat @ inverse))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost: shortest augmenting paths with potentials."""
    cost = np.asarray(cost, float)
    if not cost.size:
        return []
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j, way = i, 0, np.zeros(m + 1, int)
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while owner[j]:
            used[j] = True
            free = np.flatnonzero(~used[1:]) + 1
            slack = c[owner[j] - 1, free - 1] - u[owner[j]] - v[free]
            better = slack < least[free]
            least[free[better]], way[free[better]] = slack[better], j
            k = free[np.argmin(least[free])]
            delta = least[k]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = k
        while j:
            owner[j], j = owner[way[j]], way[j]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def oriented_box(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, half sizes and axes (rows) of the box along the principal directions."""
    p = np.asarray(points, float)
    axes = np.linalg.eigh(np.cov((p - p.mean(axis=0)).T))[1].T if len(p) > 2 else np.eye(3)
    own = p @ axes.T
    low, high = own.min(axis=0), own.max(axis=0)
    return ((low + high) / 2) @ axes, (high - low) / 2, axes


def box_iou(a: tuple, b: tuple, side: int = 24) -> float:
    """Overlap of two oriented boxes as share of their union, on a lattice of one box's points; equal boxes give 1."""
    (ca, ha, xa), (cb, hb, xb) = a, b
    grid = (np.indices((side,) * 3).reshape(3, -1).T + 0.5) / side * 2 - 1

    def share(c1, h1, x1, c2, h2, x2) -> float:
        world = (grid * h1) @ x1 + c1
        return float((np.abs((world - c2) @ x2.T) <= h2 + 1e-9).all(axis=1).mean())

    va, vb = float(np.prod(2 * ha)), float(np.prod(2 * hb))
    if va == 0 or vb == 0:
        return 0.0
    both = (share(ca, ha, xa, cb, hb, xb) * va + share(cb, hb, xb, ca, ha, xa) * vb) / 2
    return both / (va + vb - both)


def surface_sample(vertices: np.ndarray, faces: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Points spread over triangles in proportion to area."""
    t = np.asarray(vertices, float)[np.asarray(faces, int)]
    area = np.linalg.norm(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]), axis=1) / 2
    rng = np.random.default_rng(seed)
    pick = rng.choice(len(t), n, p=area / area.sum())
    a, b = np.sqrt(rng.random(n)), rng.random(n)
    return (1 - a)[:, None] * t[pick, 0] + (a * (1 - b))[:, None] * t[pick, 1] + (a * b)[:, None] * t[pick, 2]


def chamfer(a: np.ndarray, b: np.ndarray, how: str = "median", block: int = 512) -> float:
    """Distance to the nearest point of the other cloud, both ways together, by blocks so that memory stays bounded."""
    a, b = np.asarray(a, float), np.asarray(b, float)

    def nearest(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.concatenate([np.sqrt(((p[i : i + block, None] - q[None]) ** 2).sum(-1).min(axis=1)) for i in range(0, len(p), block)])

    d = np.concatenate([nearest(a, b), nearest(b, a)])
    return float(np.median(d) if how == "median" else d.mean())


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the plan hull, anticlockwise from the lowest x (monotone chain)."""
    p = sorted({(float(x), float(y)) for x, y in np.asarray(points)[:, :2]})
    if len(p) < 3:
        return np.array(p)

    def chain(seq: list) -> list:
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def hull_span(points: np.ndarray, direction: np.ndarray) -> tuple[float, float]:
    along = np.asarray(points, float)[:, :2] @ (np.asarray(direction, float) / np.linalg.norm(direction))
    return float(along.min()), float(along.max())


def water_fill(caps: list[float], budget: float) -> list[float]:
    """Equal shares of a budget with caps: what a capped group cannot take goes to the others."""
    left, share = budget, [0.0] * len(caps)
    open_ = sorted(range(len(caps)), key=lambda i: (caps[i], i))
    for k, i in enumerate(open_):
        share[i] = min(caps[i], left / (len(open_) - k))
        left -= share[i]
    return share


def capped_quota(sizes: list[int], caps: list[int], n: int) -> list[int]:
    """Largest-remainder quotas in proportion to sizes, none above its cap; what is cut off is shared out again."""
    out, open_ = [0] * len(sizes), [i for i in range(len(sizes)) if sizes[i] > 0 and caps[i] > 0]
    left = min(n, sum(caps[i] for i in open_))
    while left and open_:
        total = sum(sizes[i] for i in open_)
        exact = {i: sizes[i] * left / total for i in open_}
        give = {i: min(caps[i] - out[i], int(exact[i])) for i in open_}
        rest = left - sum(give.values())
        for i in sorted(open_, key=lambda i: (-(exact[i] - int(exact[i])), i)):
            if rest and give[i] < caps[i] - out[i]:
                give[i] += 1
                rest -= 1
        for i, g in give.items():
            out[i] += g
        left -= sum(give.values())
        open_ = [i for i in open_ if out[i] < caps[i]]
    return out


def least_loaded(weights: list[float], bins: int) -> list[int]:
    """Bin of each item: the heaviest first, each into the lightest bin."""
    load, out = [0.0] * bins, [0] * len(weights)
    for i in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
        out[i] = min(range(bins), key=lambda b: (load[b], b))
        load[out[i]] += weights[i]
    return out


def greedy_cover(tags: list[set[str]], want: dict[str, int]) -> list[int]:
    """Items taken one by one, each covering most of what tags still lack; ties to the first."""
    need, left, out = dict(want), set(range(len(tags))), []
    while left and any(v > 0 for v in need.values()):
        best = max(left, key=lambda i: (sum(need.get(t, 0) > 0 for t in tags[i]), -i))
        if not any(need.get(t, 0) > 0 for t in tags[best]):
            break
        left.remove(best)
        out.append(best)
        for t in tags[best]:
            if t in need:
                need[t] -= 1
    return out


def greedy_match(pairs: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """One-to-one pairs by descending score; ties by the first, then the second id."""
    left, right, out = set(), set(), []
    for _, a, b in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if a not in left and b not in right:
            left.add(a), right.add(b)
            out.append((a, b))
    return out
