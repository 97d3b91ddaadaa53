"""Image operators on a full-size frame against numpy."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import images as IM

W, H, KEYS = 512, 256, ["frame"]


@pytest.fixture(scope="module")
def pixels():
    rng = np.random.RandomState(11)
    y, x = np.mgrid[:H, :W]
    v = 100 + 0.05 * x - 0.02 * y + 1e-4 * x * x + 2e-4 * x * y - 60 * np.exp(-((x - 300) ** 2 + (y - 140) ** 2) / 800.0) + rng.normal(0, 1, (H, W))
    v[20:30, 40:60] = 0.0
    return v


@pytest.fixture(scope="module")
def frames(spark, pixels):
    return spark.createDataFrame([(1, [float(v) for v in pixels.ravel()])], "frame int, data array<double>").cache()


def timed(df):
    start = time.time()
    row = df.first()
    assert time.time() - start < 60
    return row


def test_otsu_barycentre(frames, pixels):
    v = pixels[pixels > 0]
    slot = np.minimum(np.floor((v.max() - v) / (v.max() - v.min()) * 64), 63)
    p = np.bincount(slot.astype(int), minlength=64) / len(v)
    w, m = np.cumsum(p), np.cumsum(p * np.arange(64))
    k = int(np.argmax(np.round((m[-1] * w - m) ** 2 / (w * (1 - w) + 1e-12), 10)))
    thr = v.max() - k * (v.max() - v.min()) / 64
    mask = (pixels > 0) & (pixels <= thr)
    weight = np.where(mask, thr - pixels + 1e-6, 0)
    r = timed(IM.otsu_barycentre(frames, W, KEYS))
    assert r["k"] == k and r["n"] == mask.sum()
    assert np.isclose(r["cx"], (weight * np.arange(W)).sum() / weight.sum()) and np.isclose(r["cy"], (weight * np.arange(H)[:, None]).sum() / weight.sum())


def test_longitude_scan(frames, pixels):
    valid = pixels > 0
    row = np.where(valid, pixels, 0).sum(0) / valid.sum(0)
    r = timed(IM.longitude_scan(frames, W, KEYS))
    padded = np.pad(row, 1)
    assert r["i0"] == int(np.argmin(np.round((padded[:-2] + padded[1:-1] + padded[2:]) / 3, 9)))


def test_histogram_mode(frames, pixels):
    thr = np.quantile(pixels[pixels > 0], 0.15)
    n = ((pixels > 0) & (pixels <= thr)).reshape(H // 4, 4, W // 4, 4).sum((1, 3)).astype(float)
    around = np.pad(n, 1)
    votes = 0.5 * n + 0.5 * sum(around[a : a + H // 4, b : b + W // 4] for a in range(3) for b in range(3))
    best = np.unravel_index(np.argmax(votes), votes.shape)
    r = timed(IM.histogram_mode(frames, W, KEYS, cell=4))
    assert (r["votes"], r["cx"], r["cy"]) == (votes.max(), (best[1] + 0.5) * 4 - 0.5, (best[0] + 0.5) * 4 - 0.5)


def test_laplacian_variance(frames, pixels):
    lap = pixels[2:, 1:-1] + pixels[:-2, 1:-1] + pixels[1:-1, 2:] + pixels[1:-1, :-2] - 4 * pixels[1:-1, 1:-1]
    lap = lap[pixels[1:-1, 1:-1] >= np.quantile(pixels, 0.7)]
    r = timed(IM.laplacian_variance(frames, W, H, KEYS))
    assert r["n"] == lap.size and np.isclose(r["sharp"], lap.var())


@pytest.mark.parametrize("fit, terms", [
    (IM.border_plane, lambda x, y: [1 + 0 * x, x, y]),
    (IM.border_quadratic, lambda x, y: [1 + 0 * x, x, y, x * x, x * y, y * y]),
])
def test_border_surface_and_blank_pixels(frames, pixels, fit, terms):
    y, x = np.mgrid[:H, :W].astype(float)
    border = (y < H * 0.05) | (y > H * 0.95) | (x < W * 0.05) | (x > W * 0.95)
    blank = frames.select("frame", F.transform("data", lambda v, i: F.when(i % 97 != 0, v)).alias("data"))
    flat = np.arange(W * H).reshape(H, W)
    for df, keep in ((frames, border), (blank, border & (flat % 97 != 0))):
        want = np.linalg.lstsq(np.stack(terms(x[keep], y[keep]), 1), pixels[keep], rcond=None)[0]
        r = timed(fit(df, W, H, KEYS))
        assert np.allclose([r[k] for k in "abcdef"[: len(want)]], want, rtol=1e-5, atol=1e-9)


def test_small_and_empty_frames(spark):
    tiny = spark.createDataFrame([(1, []), (2, [0.0, 0.0]), (3, [2.0, 1.0])], "frame int, data array<double>")
    assert IM.histogram_mode(tiny, 2, KEYS).count() == 3
    assert [r["n"] for r in IM.laplacian_variance(tiny, 2, 1, KEYS).orderBy("frame").collect()] == [0, 0, 0]
    assert IM.otsu_barycentre(tiny, 2, KEYS).count() == 3 and IM.longitude_scan(tiny, 2, KEYS).count() == 3
