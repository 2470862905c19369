"""The segmenter, which compares each colour once, against the plain form, which compares each pixel."""

import time

import numpy as np

from verdigris import catalog
from verdigris.kernels import image as K
from verdigris.kernels import preprocess as C

RNG = np.random.default_rng(11)


def rasters(n, side=8):
    """Images like those of preprocess_raster, as its segmenter gets them."""
    for _ in range(n):
        cells = np.clip(np.floor(128 + 50 * RNG.normal(size=(side, side, 3))), 0, 255).astype(np.uint8)
        yield C.denoise(C.letterbox(np.kron(cells, np.ones((8, 8, 1), dtype=np.uint8)), (8 * side, 8 * side)), "gaussian")


def plain_clusters(px, k, seed):
    x = px if len(px) <= 4000 else px[np.random.default_rng(seed).choice(len(px), 4000, replace=False)]
    centres, _ = K.kmeans(x, min(k, len(x)), seed, 10)
    own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    parts = [x[own == i] for i in range(len(centres)) if (own == i).sum() > 0]
    covs = [np.cov(p.T, bias=True).reshape(3, 3) + 4 * np.eye(3) if len(p) > 1 else 100 * np.eye(3) for p in parts]
    return np.array([len(p) / len(x) for p in parts]), np.array([p.mean(axis=0) for p in parts]), np.array(covs)


def plain_cost(px, model):
    out = np.zeros(len(px))
    for w, m, c in zip(*model, strict=True):
        d = px - m
        out += w / np.sqrt(np.linalg.det(c)) * np.exp(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(c), d))
    return -np.log(out + 1e-300)


def plain_pair(monkeypatch):
    """grabcut_like with the plain form."""
    monkeypatch.setattr(C, "_clusters", lambda colours, place, k, seed: plain_clusters(colours[place], k, seed))
    monkeypatch.setattr(C, "_cost", plain_cost)


def test_colour_clusters_are_those_of_pixels():
    few, grey = RNG.integers(0, 3, (300, 3)), np.repeat(RNG.integers(0, 256, (500, 1)), 3, axis=1)
    grid = np.stack(np.meshgrid(*[np.arange(0, 256, 51)] * 3), axis=-1).reshape(-1, 3)  # many points as far from two centres
    for px in (RNG.integers(0, 256, (900, 3)), few, grey, grid, np.full((40, 3), 7), RNG.integers(0, 256, (5, 3)), np.tile(grid, (9, 1))):
        px = px.astype(np.float64)
        colours, place = np.unique(px, axis=0, return_inverse=True)
        place = place.ravel()
        for seed in range(6):
            for steps in (1, 10, 50):
                k = min(5, len(px))
                want, _ = K.kmeans(px, k, seed, steps)
                got, members = K.kmeans_colours(colours, place, k, seed, steps)
                assert (want == got).all()
                own = ((px[:, None] - got[None]) ** 2).sum(axis=2).argmin(axis=1)
                assert (members.sum(axis=0) == 1).all() and (members.argmax(axis=0)[place] == own).all()
            a, b = C._clusters(colours, place, 5, seed), plain_clusters(px, 5, seed)
            assert all(np.allclose(x, y, rtol=1e-9, atol=1e-9) for x, y in zip(a, b, strict=True))
            assert np.allclose(C._cost(colours, a)[place], plain_cost(px, b), rtol=1e-9, atol=1e-9)


def test_segmenter_gives_the_plain_masks_in_less_time(monkeypatch):
    """The finding: by pixel, an image of 64 x 64 took several times as long."""
    images = [*rasters(6), next(rasters(1, 12)), np.full((64, 64, 3), 90, np.uint8)]
    C.grabcut_like(images[0])
    t = time.thread_time()
    got = [C.grabcut_like(x) for x in images]
    took = time.thread_time() - t
    with monkeypatch.context() as m:
        plain_pair(m)
        t = time.thread_time()
        want = [C.grabcut_like(x) for x in images]
        plain = time.thread_time() - t
    assert all((x == y).all() for x, y in zip(got, want, strict=True))
    assert took < plain / 2


def test_kernels_beside_the_segmenter():
    """The blur of three channels at once, histograms of all tiles at once, and labels painted by runs."""
    rgb = RNG.integers(0, 256, (37, 50, 3)).astype(np.uint8)
    assert (K.gaussian(rgb, 21) == np.stack([K.gaussian(rgb[..., c], 21) for c in range(3)], axis=-1)).all()
    assert (K.gaussian(rgb[:6, :6, 0], 21).shape) == (6, 6)
    assert len(np.unique(K.colour_codes(rgb))) == len(np.unique(rgb.reshape(-1, 3), axis=0))
    on = RNG.random((40, 30)) < 0.5
    label, size = K.components(on)
    assert ((label > 0) == on).all() and (np.bincount(label.ravel())[1:] == size).all()
    x = rgb[..., 0]
    th, tw, clip = 5, 7, 1
    y = np.pad(x, ((0, 3), (0, 6)), mode="reflect")
    n = np.bincount(y[:th, :tw].ravel(), minlength=256)
    over = np.maximum(n - clip, 0).sum()
    n = np.minimum(n, clip) + over // 256
    n[: over % 256] += 1
    assert K.clahe(x)[0, 0] == int(np.floor(np.cumsum(n) * 255 / (th * tw) + 0.5)[x[0, 0]])  # a corner knows its own tile only


def test_images_are_dealt_by_number(spark):
    """The 500 images of a small table were one task."""
    df = catalog._images(spark, "/root/testdata/sf0.01")
    held = [k for k in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if k]
    assert sum(held) == 500 and len(held) > 16 and max(held) < 50
    assert catalog._images(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == 32
