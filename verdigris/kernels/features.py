"""The 62 features of an image (RGB uint8) and its mask (0/255)."""

from __future__ import annotations

import numpy as np

from verdigris.kernels import image as K

#: A mask below this share of the image is not used by colour and texture, and is the whole image for canopy.
SMALL = 0.05
# Pixel sample and seed of the dominant colours, smallest contour area, smallest canopy component.
SAMPLE, SEED, MIN_CONTOUR, MIN_COMPONENT = 2000, 42, 200, 500


def share(mask: np.ndarray) -> float:
    return float((mask > 0).mean()) if mask.size else 0.0


def tree_mask(rgb: np.ndarray) -> np.ndarray:
    """Blur, Otsu, fill the background from the corners, tidy up; what the fill doesn't reach is foreground."""
    g = K.gray(rgb)
    blurred = K.as_u8(K.gaussian(g, 5))
    binary = np.where(blurred > K.otsu(blurred), 255, 0).astype(np.uint8)
    h, w = binary.shape
    outside = np.zeros((h, w), dtype=bool)
    corners = ((0, 0), (0, w - 1), (h - 1, 0), (h - 1, w - 1))
    for level in (0, 255):
        label, _ = K.components(binary == level, diagonal=False)
        ids = [label[c] for c in corners if binary[c] == level]
        outside |= np.isin(label, ids) & (label > 0)
    mask = np.where(outside, 0, 255).astype(np.uint8)
    if share(mask) < 0.01:
        bright = np.mean([float(g[c]) for c in corners]) > 127
        mask = 255 - binary if bright else binary
    return K.opening(K.closing(mask, 7), 7)


def _inside(mask: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    return x[mask > 0] if mask is not None and (mask > 0).any() else x.reshape(-1, *x.shape[2:])


def color(rgb: np.ndarray, mask: np.ndarray | None) -> dict[str, float]:
    if mask is not None and share(mask) < SMALL:
        mask = None
    px, hs = _inside(mask, rgb), _inside(mask, K.hsv(rgb)).astype(np.int64)
    n = np.bincount(8 * hs[:, 0] // 180, minlength=8).astype(float)
    span = n.max() - n.min()
    out = {f"hue_hist_{i}": float((x - n.min()) / span) if span else 0.0 for i, x in enumerate(n)}
    t = np.deg2rad(2.0 * hs[:, 0])
    cx, sx = np.cos(t).mean(), np.sin(t).mean()
    out["h_mean"] = float(np.rad2deg(np.arctan2(sx, cx)) % 360 / 2)
    out["h_std"] = float(np.sqrt(max(-2 * np.log(np.hypot(cx, sx) + 1e-9), 0)) * 90 / np.pi)
    for i, c in ((1, "s"), (2, "v")):
        out[f"{c}_mean"], out[f"{c}_std"] = float(hs[:, i].mean()), float(hs[:, i].std())
    dominant = np.zeros((3, 3))
    if len(px) >= 3:
        if len(px) > SAMPLE:
            px = px[np.random.default_rng(SEED).choice(len(px), SAMPLE, replace=False)]
        centres, count = K.kmeans(px.astype(float), 3, SEED)
        dominant = centres[np.argsort(-count, kind="stable")] / 255
    for k in range(3):
        for c, x in zip("rgb", dominant[k], strict=True):
            out[f"dom_{c}{k + 1}"] = float(x)
    out["green_ratio"] = float(((hs[:, 0] >= 17) & (hs[:, 0] <= 42) & (hs[:, 1] >= 40) & (hs[:, 2] >= 40)).mean())
    return out


def symmetry(mask: np.ndarray) -> float:
    on = mask > 0
    if not on.any():
        return 0.0
    w = on.shape[1]
    centre = max(1, min(int(np.nonzero(on)[1].mean()), w - 2))
    m = min(centre, w - centre)
    left, right = on[:, :m], on[:, centre : centre + m][:, ::-1]
    union = (left | right).sum()
    return float((left & right).sum() / union) if union else 0.0


def shape(rgb: np.ndarray, mask: np.ndarray) -> dict[str, float]:
    h, w = mask.shape
    found = [c for c in K.contours(mask) if K.area(c) >= MIN_CONTOUR]
    zero = {"aspect_ratio": 0.0, "extent_ratio": 0.0, "area_ratio": 0.0, "solidity": 0.0, "centroid_x_norm": 0.5, "centroid_y_norm": 0.5, "symmetry": 0.0, "crown_ratio": 0.5} | {f"hu_{i}": 0.0 for i in range(4)}
    if not found:
        return zero
    c = max(found, key=K.area)
    a = K.area(c)
    bw, bh = (float(c[:, i].max() - c[:, i].min() + 1) for i in (0, 1))
    body = K.area(K.hull(c))
    rows, cols = np.nonzero(mask)
    hu = K.hu_moments(c)
    out = {"aspect_ratio": bw / bh, "extent_ratio": a / (bw * bh), "area_ratio": a / (h * w), "solidity": a / body if body else 0.0}
    out |= {"centroid_x_norm": float(cols.mean() / w), "centroid_y_norm": float(rows.mean() / h), "symmetry": symmetry(mask), "crown_ratio": float((rows < h // 2).mean())}
    return out | {f"hu_{i}": float(-np.sign(v) * np.log10(abs(v))) if v else 0.0 for i, v in enumerate(hu)}


# Places of the neighbours of bits 0 to 7.
NEIGHBOURS = ((-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1))


def lbp(g: np.ndarray) -> np.ndarray:
    """Codes of the inner pixels."""
    h, w = g.shape
    centre = g[1:-1, 1:-1]
    code = np.zeros(centre.shape, dtype=np.int64)
    for bit, (dr, dc) in enumerate(NEIGHBOURS):
        code |= (g[1 + dr : h - 1 + dr, 1 + dc : w - 1 + dc] >= centre).astype(np.int64) << bit
    return code


def glcm(level: np.ndarray, dr: int, dc: int) -> np.ndarray:
    h, w = level.shape
    a = level[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)]
    b = level[max(0, dr) : h - max(0, -dr), max(0, dc) : w - max(0, -dc)]
    n = np.bincount((a * 64 + b).ravel(), minlength=4096).reshape(64, 64).astype(float)
    n += n.T
    return n / n.sum() if n.sum() else n


def texture(rgb: np.ndarray, mask: np.ndarray | None) -> dict[str, float]:
    if mask is not None and share(mask) < SMALL:
        mask = None
    g = K.gray(rgb).astype(np.int64)
    code = lbp(g)
    inner = code[mask[1:-1, 1:-1] > 0] if mask is not None and (mask[1:-1, 1:-1] > 0).any() else code.ravel()
    n = np.bincount(10 * inner // 256, minlength=10)
    out = {f"lbp_{i}": float(x / n.sum()) if n.sum() else 0.0 for i, x in enumerate(n)}
    flat = np.where(mask > 0, g, int(g[mask > 0].mean())) if mask is not None and (mask > 0).any() else g
    i, j = np.mgrid[0:64, 0:64]
    sums = np.zeros(4)
    for dr, dc in ((0, 1), (-1, 1), (-1, 0), (-1, -1)):
        p = glcm(63 * flat // 255, dr, dc)
        mi, mj = (i * p).sum(), (j * p).sum()
        si, sj = np.sqrt((p * (i - mi) ** 2).sum() + 1e-9), np.sqrt((p * (j - mj) ** 2).sum() + 1e-9)
        sums += [(p * (i - j) ** 2).sum(), (p / (1 + np.abs(i - j) + 1e-9)).sum(), (p * p).sum(), (p * (i - mi) * (j - mj)).sum() / (si * sj)]
    out |= {k: float(v / 4) for k, v in zip(("contrast", "homogeneity", "energy", "correlation"), sums, strict=True)}
    gx, gy = K.sobel(g)
    magnitude = _inside(mask, np.hypot(gx, gy))
    out["grad_mean"], out["grad_std"] = float(magnitude.mean()), float(magnitude.std())
    rough = np.sqrt(np.maximum(K.box(g.astype(float) ** 2, 5) - K.box(g, 5) ** 2, 0))
    out["roughness"] = float(_inside(mask, rough).mean())
    return out


def canopy(rgb: np.ndarray, mask: np.ndarray) -> dict[str, float]:
    if share(mask) < SMALL:
        mask = np.full(mask.shape, 255, dtype=np.uint8)
    h, w = mask.shape
    on = mask > 0
    rows = on.sum(axis=1).astype(float)
    total = rows.sum()
    out = {"peak_row_norm": float(rows.argmax() / h) if total else 0.5, "top25_ratio": float(rows[: h // 4].sum() / total) if total else 0.25, "bottom25_ratio": float(rows[3 * h // 4 :].sum() / total) if total else 0.25}
    c = max(K.contours(mask), key=K.area, default=None)
    a = K.area(c) if c is not None else 0.0
    length = K.perimeter(c) if a > 0 else 0.0
    out["contour_complexity"] = length / np.sqrt(a) if a > 0 else 0.0
    out["convexity"] = K.perimeter(K.hull(c)) / length if length else 1.0
    wide = rows[rows > 0] / w
    out |= {"width_mean": float(wide.mean()), "width_std": float(wide.std()), "max_width_norm": float(wide.max())} if len(wide) else {"width_mean": 0.0, "width_std": 0.0, "max_width_norm": 0.0}
    _, size = K.components(K.closing(mask, 11) > 0)
    out["n_components"] = float((size >= MIN_COMPONENT).sum())
    return {k: float(v) for k, v in out.items()}


#: group -> function(rgb, mask); extraction calls these, and callers may add their own.
EXTRACTORS = {"color": color, "shape": shape, "texture": texture, "canopy": canopy}
