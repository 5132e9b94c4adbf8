"""numpy algebra of time-lagged ridge regression on additive block statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = 1e-12


def lagged(x: np.ndarray, delays: np.ndarray) -> np.ndarray:
    """Rows x (features * delays), feature-major: x[t - d], 0 outside the series."""
    x = x[:, None] if x.ndim == 1 else x
    n, f = x.shape
    out = np.zeros((n, f, len(delays)))
    for k, d in enumerate(int(v) for v in delays):
        if abs(d) < n:
            out[max(d, 0) : n + min(d, 0), :, k] = x[max(-d, 0) : n - max(d, 0)]
    return out.reshape(n, f * len(delays))


def fold_of(n: int, k: int) -> np.ndarray:
    """Contiguous folds; the first n mod k have one row more."""
    return np.repeat(np.arange(k), [n // k + (i < n % k) for i in range(k)])


@dataclass
class Block:
    """Sums over some rows, about a common pilot; blocks add."""

    n: int
    sx: np.ndarray
    sy: np.ndarray
    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray
    x_lo: np.ndarray
    x_hi: np.ndarray
    y_lo: np.ndarray
    y_hi: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Block:
        far = lambda a, f, v: f(a, axis=0, initial=v)
        return cls(len(x), x.sum(0), y.sum(0), x.T @ x, x.T @ y, (y * y).sum(0), far(x, np.min, np.inf), far(x, np.max, -np.inf), far(y, np.min, np.inf), far(y, np.max, -np.inf))

    def __add__(self, o: Block) -> Block:
        low, high = np.minimum, np.maximum
        return Block(self.n + o.n, self.sx + o.sx, self.sy + o.sy, self.xx + o.xx, self.xy + o.xy, self.yy + o.yy, low(self.x_lo, o.x_lo), high(self.x_hi, o.x_hi), low(self.y_lo, o.y_lo), high(self.y_hi, o.y_hi))


def scaling(b: Block, kind: str, of: str) -> tuple[np.ndarray, np.ndarray]:
    """Offset and divisor fitted on a training block: Standarize, Normalize or None."""
    s, lo, hi = (b.sx, b.x_lo, b.x_hi) if of == "x" else (b.sy, b.y_lo, b.y_hi)
    if kind == "Standarize":
        mean = s / b.n
        square = np.diag(b.xx) if of == "x" else b.yy
        var = square / b.n - mean**2
        var = np.where(var <= EPS * np.maximum(square / b.n, 0), 0, var)
        return mean, np.sqrt(var) + EPS
    if kind == "Normalize":
        return lo, (hi - lo) + EPS
    if kind in ("None", None):
        return np.zeros_like(s), np.ones_like(s)
    raise ValueError(f"unknown scaling {kind!r}")


def scaled(b: Block, x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> Block:
    """The block of (x - offset) / divisor, by algebra alone."""
    (ox, dx), (oy, dy) = x, y
    xx = (b.xx - np.outer(ox, b.sx) - np.outer(b.sx, ox) + b.n * np.outer(ox, ox)) / np.outer(dx, dx)
    xy = (b.xy - np.outer(ox, b.sy) - np.outer(b.sx, oy) + b.n * np.outer(ox, oy)) / np.outer(dx, dy)
    yy = (b.yy - 2 * oy * b.sy + b.n * oy**2) / dy**2
    return Block(b.n, (b.sx - b.n * ox) / dx, (b.sy - b.n * oy) / dy, xx, xy, yy, (b.x_lo - ox) / dx, (b.x_hi - ox) / dx, (b.y_lo - oy) / dy, (b.y_hi - oy) / dy)


def penalty(p: int, solver: str) -> np.ndarray:
    if solver == "ridge":
        return np.eye(p)
    if solver == "ridge-laplacian":
        m = 2 * np.eye(p) - np.eye(p, k=1) - np.eye(p, k=-1)
        m[0, 0] = m[-1, -1] = 1
        return m
    raise NotImplementedError(f"solver {solver!r}")


def solve(b: Block, alpha: float, solver: str = "ridge") -> np.ndarray:
    return np.linalg.solve(b.xx + alpha * penalty(len(b.xx), solver), b.xy)


def score(b: Block, w: np.ndarray) -> np.ndarray:
    """Correlation of prediction and response times (n-1)/n, a value a channel; NaN if either is constant."""
    if b.n < 2:
        return np.full(w.shape[1], np.nan)
    cxx = b.xx - np.outer(b.sx, b.sx) / b.n
    cxy = b.xy - np.outer(b.sx, b.sy) / b.n
    cyy = b.yy - b.sy**2 / b.n
    top, pred = (w * cxy).sum(0), np.einsum("pc,pq,qc->c", w, cxx, w)
    ok = (pred > EPS * np.maximum(np.einsum("pc,pq,qc->c", w, b.xx, w), 1e-300)) & (cyy > EPS * np.maximum(b.yy, 1e-300))
    with np.errstate(all="ignore"):
        return np.where(ok, top / np.sqrt(pred * cyy) * (b.n - 1) / b.n, np.nan)


@dataclass
class Options:
    delays: tuple[int, ...]
    folds: int = 5
    x_scale: str = "Standarize"
    y_scale: str = "Standarize"
    solver: str = "ridge"
    cutoff: str = "all"  # or "live": the inner cutoff counts unmasked or masked rows


def _pilot(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:50].mean(0) if len(x) else x.sum(0), y[:50].mean(0) if len(y) else y.sum(0)


def _fit(train: Block, o: Options) -> tuple:
    sx, sy = scaling(train, o.x_scale, "x"), scaling(train, o.y_scale, "y")
    return sx, sy, scaled(train, sx, sy)


def _blocks(x: np.ndarray, y: np.ndarray, o: Options) -> tuple:
    d = lagged(x, np.array(o.delays))
    live = (d != 0).any(1)
    px, py = _pilot(d[live], y)
    # Unscaled data are fitted as they are; else sums about a pilot keep their digits.
    px, py = px * (o.x_scale not in ("None", None)), py * (o.y_scale not in ("None", None))
    return d - px, y - py, live, fold_of(len(d), o.folds), (px, py)


def fit(x: np.ndarray, y: np.ndarray, alpha: float, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """Weights (folds, p, channels) and scores (folds, channels); one pass over the rows."""
    d, yc, live, fold, _ = _blocks(x, y, o)
    train = [Block.of(d[(fold == k) & live], yc[(fold == k) & live]) for k in range(o.folds)]
    test = [Block.of(d[fold == k], yc[fold == k]) for k in range(o.folds)]
    ws, rs = [], []
    for k in range(o.folds):
        own = [b for j, b in enumerate(train) if j != k]
        sx, sy, b = _fit(sum(own[1:], own[0]), o)
        w = solve(b, alpha, o.solver)
        ws.append(w)
        rs.append(score(scaled(test[k], sx, sy), w))
    return np.array(ws), np.array(rs)


def sweep(x: np.ndarray, y: np.ndarray, alphas: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Validation and training scores (folds, alphas), and the mean weights (folds, alphas, delays):
    the first four fifths of each fold's training rows against the rest."""
    d, yc, live, fold, _ = _blocks(x, y, o)
    val, tra, mean = (np.full((o.folds, len(alphas), *more), np.nan) for more in ((), (), (len(o.delays),)))
    for k in range(o.folds):
        rows = np.flatnonzero((fold != k) & live)
        cut = int(0.8 * (len(rows) if o.cutoff == "live" else int((fold != k).sum())))
        if not len(rows[:cut]):
            continue
        a, b = Block.of(d[rows[:cut]], yc[rows[:cut]]), Block.of(d[rows[cut:]], yc[rows[cut:]])
        sx, sy, a = _fit(a, o)
        b = scaled(b, sx, sy) if b.n else b
        for i, alpha in enumerate(alphas):
            w = solve(a, alpha, o.solver)
            tra[k, i], val[k, i] = score(a, w).mean(), score(b, w).mean() if b.n else np.nan
            mean[k, i] = w.reshape(-1, len(o.delays), w.shape[1]).mean(axis=(0, 2))
    return val, tra, mean


def permuted_scores(x: np.ndarray, y: np.ndarray, alpha: float, o: Options, times: int, seed: int) -> np.ndarray:
    """Null scores (times, folds, channels): rows of the design permuted, the response kept."""
    rng = np.random.default_rng(seed)
    d, yc, live, fold, _ = _blocks(x, y, o)
    out = []
    for _ in range(times):
        row = []
        for k in range(o.folds):
            at = np.flatnonzero((fold != k) & live)
            sx, sy, b = _fit(Block.of(d[rng.permutation(at)], yc[at]), o)
            row.append(score(scaled(Block.of(d[fold == k], yc[fold == k]), sx, sy), solve(b, alpha, o.solver)))
        out.append(row)
    return np.array(out)


def leaf_order(data: np.ndarray) -> list[int]:
    """Order of the rows by single linkage on 1 - correlation; all-zero rows are left out.

    Original indices. Rows join along the edges of a minimum spanning tree, shortest first (on
    ties, as the tree found them from the first row on); each join makes a cluster numbered
    after all before it, and the lower-numbered side comes first."""
    keep = np.flatnonzero((data != 0).any(1))
    n = len(keep)
    if n < 2:
        return keep.tolist()
    with np.errstate(all="ignore"):
        dist = 1 - np.corrcoef(data[keep])
    dist = np.nan_to_num((dist + dist.T) / 2, nan=1.0)
    near, origin, free = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    edges, at = [], 0
    for _ in range(n - 1):
        free[at] = False
        closer = free & (dist[at] < near)
        near[closer], origin[closer] = dist[at][closer], at
        at = int(np.argmin(np.where(free, near, np.inf)))
        edges.append((near[at], int(origin[at]), at))
    cluster, leaves = list(range(n)), {i: [i] for i in range(n)}
    for number, (_, i, j) in enumerate(sorted(edges, key=lambda e: e[0]), n):
        low, high = sorted((cluster[i], cluster[j]))
        leaves[number] = leaves.pop(low) + leaves.pop(high)
        for k in leaves[number]:
            cluster[k] = number
    return keep[leaves[2 * n - 2]].tolist()


def edges(x: np.ndarray) -> tuple[int, float, int, float]:
    """Length of the run of equal values that a part begins with and the value after it, length of
    the run that it ends with and the value before it; NaN where the part has none, NaNs aren't equal."""
    s = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    one = len(s) == 1
    return (len(x), np.nan, len(x), np.nan) if one else (int(s[1]), float(x[s[1]]), len(x) - int(s[-1]), float(x[s[-1] - 1]))


def crests(x: np.ndarray, least: float, first: int, start: int, before: float, end: int, after: float, flat: bool = True) -> np.ndarray:
    """Places in a part of a series of its local maxima of at least ``least``; a flat top counts at its
    middle, or not at all. ``first`` is the part's place in the series, ``start`` that of its first run
    of equal values and ``before`` the value there; ``end`` and ``after`` are those of its last run."""
    s = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    top, far, to = x[s], s + first, np.r_[s[1:], len(x)] - 1 + first
    far[0], to[-1] = start, end
    middle = (far + to) // 2 - first
    found = (top > np.r_[before, top[:-1]]) & (top > np.r_[top[1:], after]) & (top >= least) & (middle >= 0) & (middle < len(x))
    return middle[found & (flat | (far == to))]


def thinned(at: np.ndarray, x: np.ndarray, least_gap: int, lo: float = -np.inf, hi: float = np.inf, stays: np.ndarray | None = None) -> np.ndarray:
    """1 for a peak that stays, -1 for one nearer than ``least_gap`` to a higher one that stays (on ties,
    an earlier one), 0 where that hangs on peaks outside [lo, hi). ``at`` ascends; ``stays``: known to stay."""
    far = (at - lo >= least_gap) & (hi - at >= least_gap)
    sure = np.zeros(len(at), bool) if stays is None else stays
    state, hangs, sure, places = [0] * len(at), (~far).tolist(), sure.tolist(), at.tolist()
    for j in np.lexsort((at, -x)).tolist():
        if state[j]:
            continue
        state[j] = int(sure[j] or not hangs[j])
        for step in (-1, 1):
            k = j + step
            while 0 <= k < len(places) and abs(places[k] - places[j]) < least_gap:
                if state[j]:
                    state[k] = -1
                else:
                    hangs[k] = True
                k += step
    return np.array(state, int)


def peaks(x: np.ndarray, least_gap: int, share: float = 0.1) -> np.ndarray:
    """Local maxima of at least ``share`` of the maximum; of two nearer than ``least_gap`` the
    higher stays, on ties the earlier. A flat top counts at its middle."""
    if not len(x):
        return np.array([], int)
    at = crests(x, share * x.max(), 0, 0, np.nan, len(x) - 1, np.nan)
    return at[thinned(at, x[at], least_gap) > 0]
