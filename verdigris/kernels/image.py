"""Pixel kernels on numpy arrays: images are (H, W, 3) uint8, masks (H, W) uint8 of 0 and 255."""

from __future__ import annotations

import numpy as np


def as_u8(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def gray(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., i].astype(np.int64) for i in range(3))
    return ((299 * r + 587 * g + 114 * b + 500) // 1000).astype(np.uint8)


def hsv(rgb: np.ndarray) -> np.ndarray:
    """8-bit hue (0..179), saturation and value."""
    r, g, b = (rgb[..., i].astype(np.float64) for i in range(3))
    v = np.maximum(np.maximum(r, g), b)
    d = v - np.minimum(np.minimum(r, g), b)
    safe = np.where(d == 0, 1, d)
    deg = np.where(v == r, 60 * (g - b) / safe, np.where(v == g, 120 + 60 * (b - r) / safe, 240 + 60 * (r - g) / safe))
    deg = np.where(d == 0, 0, np.where(deg < 0, deg + 360, deg))
    s = np.where(v == 0, 0, np.floor((510 * d + v) / np.where(v == 0, 1, 2 * v)))
    return np.stack([np.floor(deg / 2 + 0.5) % 180, s, v], axis=-1).astype(np.uint8)


# sRGB primaries and the D65 white of CIE Lab.
_TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def to_lab(rgb: np.ndarray) -> np.ndarray:
    """CIE Lab as float: L 0..100."""
    c = rgb.astype(np.float64) / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    t = c @ _TO_XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    fy = (lab[..., 0] + 16) / 116
    f = np.stack([fy + lab[..., 1] / 500, fy, fy - lab[..., 2] / 200], axis=-1)
    t = np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787)
    c = (t * _WHITE) @ np.linalg.inv(_TO_XYZ).T
    c = np.where(c > 0.0031308, 1.055 * np.maximum(c, 0) ** (1 / 2.4) - 0.055, 12.92 * c)
    return as_u8(c * 255)


def _spread(n: int, m: int) -> np.ndarray:
    """(m, n) weights: box averages when shrinking, linear interpolation when enlarging."""
    w = np.zeros((m, n))
    scale = n / m
    for i in range(m):
        if m <= n:
            a, b = i * scale, (i + 1) * scale
            for j in range(int(a), min(n, int(np.ceil(b)))):
                w[i, j] = max(0.0, min(b, j + 1) - max(a, j))
        else:
            x = min(max((i + 0.5) * scale - 0.5, 0), n - 1)
            j = min(int(x), n - 1)
            w[i, j] += 1 - (x - j)
            w[i, min(j + 1, n - 1)] += x - j
    return w / w.sum(axis=1, keepdims=True)


def resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    if img.shape[:2] == (height, width):
        return img.copy()
    x = img.astype(np.float64)
    out = np.tensordot(_spread(img.shape[0], height), x, axes=(1, 0))
    out = np.moveaxis(np.tensordot(_spread(img.shape[1], width), out, axes=(1, 1)), 0, 1)
    return as_u8(out)


def resize_nearest(img: np.ndarray, width: int, height: int) -> np.ndarray:
    r = np.minimum(np.arange(height) * img.shape[0] // height, img.shape[0] - 1)
    c = np.minimum(np.arange(width) * img.shape[1] // width, img.shape[1] - 1)
    return img[r][:, c]


def _along(x: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    k, n = len(weights) // 2, x.shape[axis]
    y = np.take(x, np.pad(np.arange(n), k, mode="reflect" if n > k else "edge"), axis=axis)
    out = np.zeros(x.shape)
    for i, w in enumerate(weights):
        out += w * y[(slice(None),) * axis + (slice(i, i + n),)]
    return out


def gaussian(x: np.ndarray, k: int, sigma: float | None = None) -> np.ndarray:
    """Separable blur (float); 5 taps without sigma are binomial."""
    if sigma is None and k == 5:
        w = np.array([1, 4, 6, 4, 1]) / 16
    else:
        s = sigma or 0.3 * ((k - 1) / 2 - 1) + 0.8
        w = np.exp(-((np.arange(k) - k // 2) ** 2) / (2 * s * s))
        w /= w.sum()
    return _along(_along(x.astype(np.float64), w, 0), w, 1)


def box(x: np.ndarray, k: int) -> np.ndarray:
    w = np.full(k, 1 / k)
    return _along(_along(x.astype(np.float64), w, 0), w, 1)


def sobel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(np.float64)
    smooth, diff = np.array([1.0, 2, 1]), np.array([-1.0, 0, 1])
    return _along(_along(x, diff, 1), smooth, 0), _along(_along(x, diff, 0), smooth, 1)


def otsu(x: np.ndarray) -> int:
    """Threshold t of Otsu (1979): foreground is above t; the first maximum."""
    n = np.bincount(x.ravel(), minlength=256).astype(np.float64)
    n0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    n1 = n0[-1] - n0
    ok = (n0 > 0) & (n1 > 0)
    between = np.zeros(256)
    between[ok] = n0[ok] * n1[ok] * (s0[ok] / n0[ok] - (s0[-1] - s0[ok]) / n1[ok]) ** 2
    return int(between.argmax())


def ellipse(n: int) -> np.ndarray:
    r = n // 2
    out = np.zeros((n, n), dtype=bool)
    for i, dy in enumerate(range(-r, r + 1)):
        half = int(round(r * np.sqrt(max(0.0, 1 - (dy / r) ** 2)))) if r else 0
        out[i, r - half : r + half + 1] = True
    return out


def dilate(mask: np.ndarray, element: np.ndarray, times: int = 1) -> np.ndarray:
    on, r = mask > 0, element.shape[0] // 2
    for _ in range(times):
        y = np.pad(on, r)
        out = np.zeros_like(on)
        for i, j in zip(*np.nonzero(element), strict=True):
            out |= y[i : i + on.shape[0], j : j + on.shape[1]]
        on = out
    return on.astype(np.uint8) * 255


def erode(mask: np.ndarray, element: np.ndarray, times: int = 1) -> np.ndarray:
    """Outside pixels never decide."""
    return 255 - dilate(255 - (mask > 0).astype(np.uint8) * 255, element, times)


def closing(mask: np.ndarray, n: int, times: int = 1) -> np.ndarray:
    return erode(dilate(mask, ellipse(n), times), ellipse(n), times)


def opening(mask: np.ndarray, n: int, times: int = 1) -> np.ndarray:
    return dilate(erode(mask, ellipse(n), times), ellipse(n), times)


def components(on: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Labels (0 is off, components from 1 in scan order) and their sizes: runs of each row, joined by union-find."""
    h, w = on.shape
    edge = np.diff(np.pad(on.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rr, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    up = list(range(len(rr)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first, begin, end = np.searchsorted(rr, np.arange(h + 1)).tolist(), start.tolist(), stop.tolist()
    reach = 1 if diagonal else 0
    for r in range(1, h):
        i, j = first[r - 1], first[r]
        while i < first[r] and j < first[r + 1]:
            if begin[i] < end[j] + reach and begin[j] < end[i] + reach:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    root = np.array([find(i) for i in range(len(rr))], dtype=np.int64)
    names, label = np.unique(root, return_inverse=True)
    out = np.zeros((h, w), dtype=np.int64)
    out[on.astype(bool)] = np.repeat(label + 1, stop - start)  # runs and pixels are both in scan order
    return out, np.bincount(label, stop - start, len(names)).astype(np.int64)


def largest_component(mask: np.ndarray) -> np.ndarray:
    label, size = components(mask > 0)
    return mask.copy() if not len(size) else (label == size.argmax() + 1).astype(np.uint8) * 255


# The eight steps around a pixel, clockwise from the left.
_STEPS = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def contours(mask: np.ndarray) -> list[np.ndarray]:
    """Outer border of each 8-connected component, as (x, y) pixel centres in the order of Moore tracing."""
    label, size = components(mask > 0)
    out = []
    for k in range(1, len(size) + 1):
        rows, cols = np.nonzero(label == k)
        r0, c0 = int(rows[0]), int(cols[0])
        own = np.pad(label == k, 1)
        r, c, back = r0 + 1, c0 + 1, 0
        path, start = [], None
        while True:
            path.append((c - 1, r - 1))
            for i in range(1, 9):
                d = (back + i) % 8
                dr, dc = _STEPS[d]
                if own[r + dr, c + dc]:
                    break
            else:
                break
            state = (r, c, d)
            if start is None:
                start = state
            elif state == start:
                path.pop()
                break
            r, c, back = r + dr, c + dc, (d + 4) % 8
        out.append(np.array(path, dtype=np.float64))
    return out


def area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2


def perimeter(p: np.ndarray) -> float:
    return float(np.sqrt(((p - np.roll(p, -1, axis=0)) ** 2).sum(axis=1)).sum())


def hull(p: np.ndarray) -> np.ndarray:
    """Convex hull by monotone chains."""
    pts = sorted(set(map(tuple, p.tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def half(seq):
        out = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def hu_moments(p: np.ndarray) -> list[float]:
    """The first four invariants of Hu (1962) of a polygon, its moments by Green's theorem over triangles from its mean."""
    x, y = p[:, 0] - p[:, 0].mean(), p[:, 1] - p[:, 1].mean()
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    cross = x * y2 - x2 * y
    total = cross.sum() / 2
    if total == 0:
        return [0.0] * 4
    # exact for polynomials up to degree 3: four-point rule on each triangle (origin, p, next)
    points = [(1 / 3, 1 / 3, 1 / 3, -27 / 48), (0.6, 0.2, 0.2, 25 / 48), (0.2, 0.6, 0.2, 25 / 48), (0.2, 0.2, 0.6, 25 / 48)]

    def moment(f):
        return float(sum(w * (cross / 2 * f(b * x + c * x2, b * y + c * y2)).sum() for _, b, c, w in points))

    sign = 1 if total > 0 else -1
    m00 = sign * total
    cx, cy = moment(lambda u, v: u) / total, moment(lambda u, v: v) / total
    eta = {(i, j): sign * moment(lambda u, v, i=i, j=j: (u - cx) ** i * (v - cy) ** j) / m00 ** (1 + (i + j) / 2) for i in range(4) for j in range(4) if 2 <= i + j <= 3}
    n20, n02, n11, n30, n03, n21, n12 = (eta[k] for k in ((2, 0), (0, 2), (1, 1), (3, 0), (0, 3), (2, 1), (1, 2)))
    return [n20 + n02, (n20 - n02) ** 2 + 4 * n11**2, (n30 - 3 * n12) ** 2 + (3 * n21 - n03) ** 2, (n30 + n12) ** 2 + (n21 + n03) ** 2]


def kmeans(x: np.ndarray, k: int, seed: int, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's algorithm from a k-means++ start: centres and counts."""
    rng = np.random.default_rng(seed)
    centres = x[[rng.integers(len(x))]]
    for _ in range(k - 1):
        d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        centres = np.concatenate([centres, x[[rng.choice(len(x), p=d / d.sum()) if d.sum() else 0]]])
    for _ in range(steps):
        own = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        count = np.bincount(own, minlength=k)
        moved = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], axis=1) / np.maximum(count, 1)[:, None]
        moved[count == 0] = centres[count == 0]
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres, count


def colour_codes(rgb: np.ndarray) -> np.ndarray:
    """One number for each pixel, equal for equal colours."""
    r, g, b = (rgb[..., i].astype(np.int64) for i in range(3))
    return ((r << 16) | (g << 8) | b).ravel()


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(k, n) squared distances of the columns of x (3, n) from centres (k, 3)."""
    d = x[:, None, :] - centres.T[:, :, None]
    d *= d
    out = d[0] + d[1]
    out += d[2]
    return out


def _members(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(k, n) of 0 and 1: the nearest centre of each column of x, the first of equal ones. A matrix product decides where no
    second centre is nearly as near; the others are compared by their squared distances."""
    near = centres @ x - (0.5 * (centres * centres).sum(axis=1))[:, None]
    out = near >= near.max(axis=0) - 1e-6  # far above the rounding of numbers below 256 squared
    if np.count_nonzero(out) > x.shape[1]:
        open_ = np.flatnonzero(np.count_nonzero(out, axis=0) > 1)
        out[:, open_] = _squares(x[:, open_], centres).argmin(axis=0) == np.arange(len(centres))[:, None]
    return out.astype(np.float64)


def kmeans_colours(colours: np.ndarray, place: np.ndarray, k: int, seed: int, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Centres by kmeans of the pixels colours[place], and the (k, colours) members of each, 0 or 1. Every colour is compared once, whatever its
    pixels. Colours are whole numbers, so their sums are exact and the centres are those of kmeans to the last bit."""
    rng = np.random.default_rng(seed)
    x = np.ascontiguousarray(colours.T, dtype=np.float64)
    sums = np.concatenate([x, np.ones((1, x.shape[1]))]).T * np.bincount(place, minlength=len(colours))[:, None]
    centres = x[:, [place[rng.integers(len(place))]]].T
    near = np.full(len(colours), np.inf)
    for _ in range(k - 1):
        near = np.minimum(near, _squares(x, centres[-1:])[0])
        d = near[place]
        at = 0
        if total := d.sum():  # the draw of rng.choice(len(place), p=d / total), without its checks of p
            reach = np.cumsum(d / total)
            reach /= reach[-1]
            at = reach.searchsorted(rng.random(), side="right")
        centres = np.concatenate([centres, x[:, [place[at]]].T])
    for _ in range(steps):
        own = _members(x, centres)
        moved = own @ sums
        count = moved[:, 3:]
        moved = np.where(count == 0, centres, moved[:, :3] / np.maximum(count, 1))
        if (np.abs(moved - centres) <= 1e-8 + 1e-5 * np.abs(centres)).all():  # as np.allclose, which takes longer
            return centres, own
        centres = moved
    return centres, _members(x, centres)


def canny(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edges by Canny (1986): L1 gradient, thinning along its direction, hysteresis."""
    gx, gy = sobel(x)
    m = np.abs(gx) + np.abs(gy)
    p = np.pad(m, 1)
    h, w = m.shape
    at = lambda dr, dc: p[1 + dr : 1 + dr + h, 1 + dc : 1 + dc + w]
    ratio = np.abs(gy) / np.where(gx == 0, 1e-12, np.abs(gx))
    flat, steep = ratio < np.tan(np.pi / 8), ratio > np.tan(3 * np.pi / 8)
    rising = gx * gy >= 0
    one = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(rising, at(-1, -1), at(-1, 1))))
    two = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(rising, at(1, 1), at(1, -1))))
    thin = (m > one) & (m >= two)
    label, size = components(thin & (m > low))
    strong = np.unique(label[thin & (m > high)])
    return (np.isin(label, strong[strong > 0])).astype(np.uint8) * 255


def clahe(x: np.ndarray, limit: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of one 8-bit channel, bilinear between tiles."""
    h, w = x.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    y = np.pad(x, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if min(h, w) > max(th * tiles - h, tw * tiles - w) else "edge")
    clip = max(1, int(limit * th * tw / 256))
    tile = (np.arange(th * tiles) // th)[:, None] * tiles + np.arange(tw * tiles) // tw
    n = np.bincount((tile * 256 + y).ravel(), minlength=tiles * tiles * 256).reshape(tiles, tiles, 256)
    over = np.maximum(n - clip, 0).sum(axis=2, keepdims=True)
    n = np.minimum(n, clip) + over // 256 + (np.arange(256) < over % 256)
    maps = np.floor(np.cumsum(n, axis=2) * 255 / (th * tw) + 0.5)
    r, c = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    i, j = np.floor(r).astype(int), np.floor(c).astype(int)
    fr, fc = (r - i)[:, None], (c - j)[None, :]
    pick = lambda a, b: maps[np.clip(a, 0, tiles - 1)[:, None], np.clip(b, 0, tiles - 1)[None, :], x]
    out = (1 - fr) * ((1 - fc) * pick(i, j) + fc * pick(i, j + 1)) + fr * ((1 - fc) * pick(i + 1, j) + fc * pick(i + 1, j + 1))
    return as_u8(out)


def bilateral(img: np.ndarray, d: int = 9, colour: float = 75, space: float = 75) -> np.ndarray:
    r = d // 2
    y = np.pad(img.astype(np.float64), ((r, r), (r, r), (0, 0)), mode="reflect" if min(img.shape[:2]) > r else "edge")
    total, weight = np.zeros(img.shape), np.zeros(img.shape[:2])
    for dr in range(-r, r + 1):
        for dc in range(-r, r + 1):
            if dr * dr + dc * dc <= r * r:
                near = y[r + dr : r + dr + img.shape[0], r + dc : r + dc + img.shape[1]]
                w = np.exp(-((np.abs(near - img).sum(axis=2)) ** 2) / (2 * colour**2) - (dr * dr + dc * dc) / (2 * space**2))
                total += w[..., None] * near
                weight += w
    return as_u8(total / weight[..., None])


def nl_means(img: np.ndarray, h: float = 6, patch: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means (Buades 2005) on Lab: patches are compared by box means of squared differences, shift by shift."""
    lab = to_lab(img)
    lab[..., 0] *= 2.55
    r = search // 2
    y = np.pad(lab, ((r, r), (r, r), (0, 0)), mode="reflect" if min(img.shape[:2]) > r else "edge")
    out = np.zeros(lab.shape)
    sums = np.zeros(lab.shape[:2] + (2,))
    for dr in range(-r, r + 1):
        for dc in range(-r, r + 1):
            near = y[r + dr : r + dr + img.shape[0], r + dc : r + dc + img.shape[1]]
            d = (near - lab) ** 2
            for k, part in enumerate((slice(0, 1), slice(1, 3))):
                w = np.exp(-box(d[..., part].mean(axis=2), patch) / (h * h))
                out[..., part] += w[..., None] * near[..., part]
                sums[..., k] += w
    out[..., 0:1] /= sums[..., 0:1]
    out[..., 1:3] /= sums[..., 1:2]
    out[..., 0] /= 2.55
    return from_lab(out)


def rotate(img: np.ndarray, degrees: float, nearest: bool = False) -> np.ndarray:
    """Turn about the centre, counter-clockwise; bilinear with reflected border, or nearest with border 0."""
    h, w = img.shape[:2]
    t = np.deg2rad(degrees)
    yy, xx = np.mgrid[0:h, 0:w].astype(np.float64)
    dx, dy = xx - w / 2, yy - h / 2
    sx, sy = np.cos(t) * dx - np.sin(t) * dy + w / 2, np.sin(t) * dx + np.cos(t) * dy + h / 2
    if nearest:
        i, j = np.floor(sy + 0.5).astype(int), np.floor(sx + 0.5).astype(int)
        ok = (i >= 0) & (i < h) & (j >= 0) & (j < w)
        return np.where(ok, img[np.clip(i, 0, h - 1), np.clip(j, 0, w - 1)], 0).astype(np.uint8)

    def mirror(i, n):
        if n == 1:
            return np.zeros_like(i)
        i = np.abs(i) % (2 * n - 2)
        return np.where(i >= n, 2 * n - 2 - i, i)

    i, j = np.floor(sy).astype(int), np.floor(sx).astype(int)
    fy, fx = (sy - i)[..., None], (sx - j)[..., None]
    at = lambda a, b: img[mirror(a, h), mirror(b, w)].astype(np.float64)
    return as_u8((1 - fy) * ((1 - fx) * at(i, j) + fx * at(i, j + 1)) + fy * ((1 - fx) * at(i + 1, j) + fx * at(i + 1, j + 1)))
