"""The block algebra against direct computation, and the kernels' properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.config import Config
from tideline.functions import signal, trf
from tideline.functions.trf import Options


def direct(x, y, alpha, o):
    d = np.zeros((len(x), x.shape[1] * len(o.delays)))
    for f in range(x.shape[1]):
        for k, lag in enumerate(o.delays):
            for t in range(len(x)):
                if 0 <= t - lag < len(x):
                    d[t, f * len(o.delays) + k] = x[t - lag, f]
    fold = np.concatenate([[i] * len(p) for i, p in enumerate(np.array_split(np.arange(len(x)), o.folds))])
    ws, rs = [], []
    for k in range(o.folds):
        tr = (fold != k) & (d != 0).any(1)
        a, b, ta, tb = d[tr], y[tr], d[fold == k], y[fold == k]
        if o.x_scale == "Standarize":
            m, s = a.mean(0), a.std(0) + 1e-12
            a, ta = (a - m) / s, (ta - m) / s
        elif o.x_scale == "Normalize":
            m, s = a.min(0), np.ptp(a, axis=0) + 1e-12
            a, ta = (a - m) / s, (ta - m) / s
        if o.y_scale == "Standarize":
            m, s = b.mean(0), b.std(0) + 1e-12
            b, tb = (b - m) / s, (tb - m) / s
        pen = np.eye(a.shape[1]) if o.solver == "ridge" else None
        if pen is None:
            pen = np.diag([1.0] + [2.0] * (a.shape[1] - 2) + [1.0]) - np.eye(a.shape[1], k=1) - np.eye(a.shape[1], k=-1)
        w = np.linalg.solve(a.T @ a + alpha * pen, a.T @ b)
        p = ta @ w
        n = len(p)
        r = ((p - p.mean(0)) * (tb - tb.mean(0))).mean(0) / (p.std(0, ddof=1) * tb.std(0, ddof=1))
        assert np.allclose(r, [np.corrcoef(p[:, c], tb[:, c])[0, 1] * (n - 1) / n for c in range(y.shape[1])])
        ws.append(w)
        rs.append(r)
    return np.array(ws), np.array(rs)


@pytest.mark.parametrize("solver", ["ridge", "ridge-laplacian"])
@pytest.mark.parametrize(("xs", "ys"), [("Standarize", "Standarize"), ("Normalize", "Standarize"), ("None", "None")])
@pytest.mark.parametrize("mean", [0.0, 1e3])
def test_fit_is_the_direct_fit(solver, xs, ys, mean):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(203, 2)) + mean, rng.normal(size=(203, 3)) + mean
    x[40:80] = 0
    o = Options((-2, 0, 3), x_scale=xs, y_scale=ys, solver=solver)
    for got, want in zip(trf.fit(x, y, 2.0, o), direct(x, y, 2.0, o), strict=True):
        assert np.allclose(got, want, atol=1e-7, rtol=1e-6)


def test_zero_columns_give_nan_not_an_error():
    o = Options((0, 1))
    w, r = trf.fit(np.zeros((50, 1)) + 1, np.ones((50, 2)), 1.0, o)
    assert np.isfinite(w).all() and np.isnan(r).all()


def test_inner_part_can_be_empty():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(100, 1)), rng.normal(size=(100, 2))
    x[:60] = 0
    val, tra, _ = trf.sweep(x, y, np.array([1.0]), Options((0,)))
    assert np.isnan(val[4]).all() and np.isfinite(tra[4]).all()
    assert np.isfinite(trf.sweep(x, y, np.array([1.0]), Options((0,), cutoff="live"))[0]).all()


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 30), st.lists(st.integers(-40, 40), min_size=1, max_size=4, unique=True))
def test_lags(n, delays):
    x = np.arange(1.0, n + 1)[:, None] * [1, 10]
    got = trf.lagged(x, np.array(delays)).reshape(n, 2, len(delays))
    for t in range(n):
        for k, d in enumerate(delays):
            assert (got[t, :, k] == (x[t - d] if 0 <= t - d < n else 0)).all()


def test_blocks_add():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(30, 3)), rng.normal(size=(30, 2))
    a = trf.Block.of(x[:11], y[:11]) + trf.Block.of(x[11:], y[11:])
    b = trf.Block.of(x, y)
    assert all(np.allclose(getattr(a, f), getattr(b, f)) for f in vars(b))


def test_penalty_grows_weights_vanish():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(80, 1)), rng.normal(size=(80, 1))
    assert np.abs(trf.fit(x, y, 1e12, Options((0, 1)))[0]).max() < 1e-6


def test_folds():
    assert np.bincount(trf.fold_of(503, 5)).tolist() == [101, 101, 101, 100, 100]


def test_unknown_solver():
    with pytest.raises(NotImplementedError):
        trf.penalty(3, "fourier-ridge")


def test_peaks():
    x = np.array([0, 3, 0, 0, 5, 5, 0, 4, 0, 0.1, 0])
    assert trf.peaks(x, 1).tolist() == [1, 4, 7]
    assert trf.peaks(x, 4).tolist() == [4]


def test_leaf_order_leaves_zero_rows_out():
    a = np.sin(np.arange(20.0))
    rows = np.stack([a, np.zeros(20), np.cos(np.arange(20.0) * 3), a + 0.01 * np.arange(20)])
    assert trf.leaf_order(rows) == [2, 0, 3]


def test_leaf_order_numbers_clusters_as_they_form():
    rng = np.random.default_rng(5)
    for n in (2, 3, 5, 12, 22):
        rows = rng.normal(size=(n, 30)) + rng.normal(size=(1, 30))
        dist, groups, number = 1 - np.corrcoef(rows), {i: [i] for i in range(n)}, n
        while len(groups) > 1:
            _, p, q = min((min(dist[i, j] for i in groups[p] for j in groups[q]), p, q) for p in groups for q in groups if p < q)
            groups[number] = groups.pop(p) + groups.pop(q)
            number += 1
        assert trf.leaf_order(rows) == groups[number - 1]
    assert trf.leaf_order(rows[:1]) == [0] and trf.leaf_order(np.zeros((2, 3))) == []


def test_config():
    c = Config.from_args(["--n_folds", "3", "--sides", "left,mono", "--t_max", "0.3"])
    assert (c.n_folds, c.sides, c.delays[-1]) == (3, ("left", "mono"), 38)
    assert (len(Config().delays), Config().delays[0], Config().delays[-1], len(Config().alphas)) == (104, -26, 77, 48)


def test_filters_keep_and_stop():
    t = np.arange(2000) / 128
    inside, outside = np.sin(2 * np.pi * 6 * t), np.sin(2 * np.pi * 25 * t)
    keep, stop = (signal.fir_filter(s, 128, 4.0, 8.0)[0][500:1500] for s in (inside, outside))
    assert np.abs(keep - inside[500:1500]).max() < 0.05 and np.abs(stop).max() < 0.02
    assert signal.fir_filter(inside, 128, 4.0, 8.0, "forward")[1] > 0
    with pytest.raises(ValueError):
        signal.fir_filter(inside, 128, 4.0, 8.0, "none")


def test_resampling_keeps_slow_waves():
    t = np.arange(1280) / 128
    for target in (64, 48, 256):
        y = signal.resample(np.sin(2 * np.pi * 2 * t) + t, 128, target)
        s = np.arange(len(y)) / target
        assert np.abs(y - np.sin(2 * np.pi * 2 * s) - s)[target : -target].max() < 0.03


def test_envelope_and_fourier():
    t = np.arange(1000) / 1000
    assert np.allclose(signal.envelope(3 * np.cos(2 * np.pi * 50 * t)), 3)
    assert np.allclose(signal.fourier_resample(np.sin(2 * np.pi * 3 * t), 500), np.sin(2 * np.pi * 3 * t[::2]))


def test_spectrogram():
    t = np.arange(16000) / 16000
    s = signal.spectrogram(np.sin(2 * np.pi * 1000 * t), 16000, 128)
    assert s.shape[1] == 21 and s.max() == pytest.approx(0) and s.min() >= -80
    assert signal.spectrogram(np.zeros(10), 16000, 128).shape == (0, 21)
