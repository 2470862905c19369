"""Cleaning steps of an image (RGB uint8): validate, orient, letterbox, denoise, segment, crop, centre, augment."""

from __future__ import annotations

import random
import struct
from dataclasses import dataclass, field

import numpy as np

from verdigris.kernels import image as K

# The usual channel statistics of photographs.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


@dataclass
class Validation:
    is_valid: bool
    reason: str
    issues: list[str] = field(default_factory=list)

    def __bool__(self) -> bool:
        return self.is_valid


def verdict(small: bool, large: bool, green: float, edges: float, colours: int, aspect: float, min_green: float = 0.04, min_edges: float = 0.02, min_colours: int = 80, max_aspect: float = 5.0) -> Validation:
    """The decision from measures: two critical issues (green, colours) reject."""
    if small:
        return Validation(False, "image too small")
    found = [(large, False, "very large image"), (green < min_green, True, f"low green ratio {green:.3f}"), (edges < min_edges, False, f"low edge density {edges:.4f}"), (colours < min_colours, True, f"few unique colours {colours}"), (aspect > max_aspect, False, f"extreme aspect ratio {aspect:.1f}")]
    issues = [text for bad, _, text in found if bad]
    critical = [text for bad, hard, text in found if bad and hard]
    if len(critical) >= 2:
        return Validation(False, "; ".join(critical), issues)
    return Validation(True, "; ".join(issues) or "OK", issues)


def validate(rgb: np.ndarray, min_size: int = 64, max_size: int = 8000, **limits) -> Validation:
    h, w = rgb.shape[:2]
    if min(h, w) < min_size:
        return verdict(True, False, 1, 1, 10**6, 1)
    x = K.hsv(rgb)
    green = float(((x[..., 0] >= 25) & (x[..., 0] <= 85) & (x[..., 1] >= 40) & (x[..., 2] >= 30)).mean())
    edges = float((K.canny(K.gray(rgb), 50, 150) > 0).mean())
    colours = len(np.unique(K.colour_codes(K.resize(rgb, 64, 64))))
    return verdict(False, max(h, w) > max_size, green, edges, colours, max(h, w) / max(min(h, w), 1), **limits)


def exif_orientation(raw: bytes) -> int:
    """Orientation tag of JPEG bytes; 1 if there is none."""
    at = 2
    if raw[:2] != b"\xff\xd8":
        return 1
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        kind, size = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
        body = raw[at + 4 : at + 2 + size]
        if kind == 0xE1 and body[:6] == b"Exif\0\0":
            tiff = body[6:]
            end = "<" if tiff[:2] == b"II" else ">"
            try:
                start = struct.unpack(end + "I", tiff[4:8])[0]
                for k in range(struct.unpack(end + "H", tiff[start : start + 2])[0]):
                    tag, _, _, value = struct.unpack(end + "HHIH", tiff[start + 2 + 12 * k : start + 12 + 12 * k])
                    if tag == 0x0112:
                        return value
            except struct.error:
                return 1
        if kind == 0xDA:
            break
        at += 2 + size
    return 1


def orient(rgb: np.ndarray, orientation: int, mode: str = "standard") -> np.ndarray:
    """Turns for orientations 3, 6 and 8. standard: 6 is shown upright by a clockwise turn; reference: the other way round."""
    turns = {3: 2, 6: -1, 8: 1} if mode == "standard" else {3: 2, 6: 1, 8: -1}
    return np.ascontiguousarray(np.rot90(rgb, turns.get(orientation, 0)))


def letterbox(rgb: np.ndarray, target: tuple[int, int] = (512, 512), correct_exposure: bool = True, fill: int = 128) -> np.ndarray:
    tw, th = target
    h, w = rgb.shape[:2]
    scale = min(tw / w, th / h)
    nw, nh = max(1, int(w * scale)), max(1, int(h * scale))
    out = np.full((th, tw, 3), fill, dtype=np.uint8)
    x, y = (tw - nw) // 2, (th - nh) // 2
    out[y : y + nh, x : x + nw] = K.resize(rgb, nw, nh)
    if correct_exposure:
        lab = K.to_lab(out)
        lab[..., 0] = K.clahe(K.as_u8(lab[..., 0] * 2.55)) / 2.55
        out = K.from_lab(lab)
    return out


def standardize(rgb: np.ndarray, mean=MEAN, std=STD) -> np.ndarray:
    return ((rgb / 255 - np.array(mean)) / np.array(std)).astype(np.float32)


def denoise(rgb: np.ndarray, method: str = "nlmeans", gaussian_ksize: int = 3, h: float = 6, template: int = 7, search: int = 21, remove_watermark: bool = True) -> np.ndarray:
    if method == "none":
        out = rgb.copy()
    elif method == "gaussian":
        k = gaussian_ksize + (gaussian_ksize % 2 == 0)
        out = K.as_u8(K.gaussian(rgb, k))
    elif method == "bilateral":
        out = K.bilateral(rgb)
    elif method == "nlmeans":
        out = K.nl_means(rgb, h, template, search)
    else:
        raise ValueError(f"unknown denoise method {method!r}")
    if remove_watermark:
        f = out.astype(np.float64)
        blurred = K.as_u8(K.gaussian(out, 21))
        out = np.clip(f - 0.15 * (f - blurred), 0, 255).astype(np.uint8)
    return out


def _clusters(colours: np.ndarray, place: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and covariances of k clusters of the pixels colours[place]."""
    at = place if len(place) <= 4000 else place[np.random.default_rng(seed).choice(len(place), 4000, replace=False)]
    n = np.bincount(at, minlength=len(colours))
    held = np.flatnonzero(n)
    x, n = colours[held], n[held]
    _, own = K.kmeans_colours(x, (np.cumsum(np.bincount(held, minlength=len(colours))) - 1)[at], min(k, len(at)), seed, 10)
    parts = np.concatenate([np.ones((len(x), 1)), x, (x[:, :, None] * x[:, None]).reshape(-1, 9)], axis=1)
    parts = (own * n) @ parts  # whole numbers, so these sums are exact
    parts = parts[parts[:, 0] > 0]
    total, sums, products = parts[:, :1], parts[:, 1:4], parts[:, 4:].reshape(-1, 3, 3)
    covs = (total[..., None] * products - sums[:, :, None] * sums[:, None]) / total[..., None] ** 2 + 4 * np.eye(3)
    return total[:, 0] / len(at), sums / total, np.where(total[..., None] > 1, covs, 100 * np.eye(3))


def _cost(colours: np.ndarray, model) -> np.ndarray:
    weights, means, covs = model
    to = np.linalg.cholesky(np.linalg.inv(covs)).transpose(0, 2, 1)  # squares of what it gives add up to d' inv(cov) d
    d = to.reshape(-1, 3) @ colours.T - (to @ means[:, :, None]).reshape(-1, 1)
    d *= d
    near = (weights / np.sqrt(np.linalg.det(covs)))[:, None] * np.exp(-0.5 * d.reshape(len(means), 3, -1).sum(axis=1))
    return -np.log(near.sum(axis=0) + 1e-300)


def grabcut_like(rgb: np.ndarray, iterations: int = 5) -> np.ndarray:
    """Foreground from two colour mixtures that start inside and outside a central rectangle.

    The labelling minimises colour costs plus a contrast-weighted smoothness by iterated conditional modes, an
    approximation of the minimum cut; then green pixels are added, gaps closed, and the largest component kept.
    """
    h, w = rgb.shape[:2]
    x0, y0 = int(0.15 * w), int(0.10 * h)
    inside = np.zeros((h, w), dtype=bool)
    inside[y0 : h - y0, x0 : w - x0] = True
    if inside.sum() < 16 or inside.all():
        return np.full((h, w), 255, dtype=np.uint8)
    codes, place = np.unique(K.colour_codes(rgb), return_inverse=True)
    colours = np.stack([codes >> 16, codes >> 8 & 255, codes & 255], axis=1).astype(np.float64)
    fg = inside.copy()
    diffs = [np.abs(np.diff(rgb.astype(float), axis=a)).sum(axis=2) for a in (0, 1)]
    beta = 1 / (2 * np.mean([(d**2).mean() for d in diffs]) + 1e-9)
    wd = [50 * np.exp(-beta * d**2) for d in diffs]
    for it in range(iterations):
        if not fg.any() or fg.all():
            break
        cf, cb = (_cost(colours, _clusters(colours, place[m.ravel()], 5, it))[place].reshape(h, w) for m in (fg, ~fg))
        for _ in range(4):
            s = fg * 2.0 - 1
            pull = np.zeros((h, w))
            pull[:-1] += wd[0] * s[1:]
            pull[1:] += wd[0] * s[:-1]
            pull[:, :-1] += wd[1] * s[:, 1:]
            pull[:, 1:] += wd[1] * s[:, :-1]
            fg = inside & (cf - cb < pull / 10)
    x = K.hsv(rgb)
    green = (x[..., 0] >= 25) & (x[..., 0] <= 90) & (x[..., 1] >= 35) & (x[..., 2] >= 25)
    mask = (fg | green).astype(np.uint8) * 255
    return K.largest_component(K.opening(K.closing(mask, 7, 3), 7))


def model_segment(rgb: np.ndarray) -> np.ndarray:
    """Place of a learned segmenter; its weights are not part of this library."""
    raise NotImplementedError("no segmentation model is installed")


#: method -> function(rgb) -> mask; tried in this order from the method asked for.
SEGMENTERS = {"rembg": model_segment, "grabcut": grabcut_like}


def segment(rgb: np.ndarray, method: str = "rembg", white_background: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(mask, image): a method that fails hands over to the next one."""
    names = list(SEGMENTERS)
    if method not in names:
        raise ValueError(f"unknown segmentation method {method!r}; known: {names}")
    for name in names[names.index(method) :]:
        try:
            mask = SEGMENTERS[name](rgb)
            break
        except NotImplementedError:
            continue
    out = rgb.copy()
    if white_background:
        out[mask == 0] = 255
    return mask, out


def crop(rgb: np.ndarray, mask: np.ndarray, padding: float = 0.07) -> tuple[np.ndarray, np.ndarray, tuple[int, int, int, int]]:
    h, w = mask.shape
    rows, cols = np.nonzero(mask)
    if not len(rows):
        return rgb.copy(), mask.copy(), (0, 0, w, h)
    x, y, bw, bh = int(cols.min()), int(rows.min()), int(cols.max() - cols.min()), int(rows.max() - rows.min())
    px, py = max(2, int(padding * bw)), max(2, int(padding * bh))
    x1, y1, x2, y2 = max(0, x - px), max(0, y - py), min(w, x + bw + px), min(h, y + bh + py)
    return rgb[y1:y2, x1:x2].copy(), mask[y1:y2, x1:x2].copy(), (x1, y1, x2 - x1, y2 - y1)


def draw_box(rgb: np.ndarray, box: tuple[int, int, int, int], colour: tuple[int, int, int] = (255, 0, 0), width: int = 2) -> np.ndarray:
    """A copy with the box's border painted."""
    out = rgb.copy()
    x, y, w, h = box
    part = out[y : y + h, x : x + w]
    for edge in (part[:width], part[-width:], part[:, :width], part[:, -width:]):
        edge[...] = colour
    return out


def centre(rgb: np.ndarray, mask: np.ndarray, size: tuple[int, int] = (512, 512), background: int = 255) -> tuple[np.ndarray, np.ndarray]:
    ow, oh = size
    out, om = np.full((oh, ow, 3), background, dtype=np.uint8), np.zeros((oh, ow), dtype=np.uint8)
    h, w = rgb.shape[:2]
    if not h or not w:
        return out, om
    scale = 0.88 * min(ow, oh) / max(h, w)
    nw, nh = max(1, int(w * scale)), max(1, int(h * scale))
    x, y = (ow - nw) // 2, (oh - nh) // 2
    small, sm = K.resize(rgb, nw, nh), K.resize_nearest(mask, nw, nh)
    out[y : y + nh, x : x + nw], om[y : y + nh, x : x + nw] = small, sm
    return out, om


def augment(rgb: np.ndarray, mask: np.ndarray | None = None, flip_h: bool = True, flip_v: bool = False, rotate: tuple[float, float] = (-10, 10), brightness: tuple[float, float] = (0.85, 1.15), seed: int | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Random flips, turn and brightness; draws in that order, so a seed fixes the result."""
    rng = random.Random(seed)
    both = [rgb, mask]
    for allowed, axis in ((flip_h, 1), (flip_v, 0)):
        if allowed and rng.random() < 0.5:
            both = [None if x is None else np.flip(x, axis) for x in both]
    angle, factor = rng.uniform(*rotate), None
    out = K.rotate(both[0], angle)
    turned = None if both[1] is None else K.rotate(both[1], angle, nearest=True)
    factor = rng.uniform(*brightness)
    return np.clip(out.astype(np.float32) * factor, 0, 255).astype(np.uint8), turned


@dataclass
class Result:
    is_valid: bool
    validation: Validation
    image: np.ndarray | None = None
    mask: np.ndarray | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    @property
    def coverage(self) -> float:
        return 0.0 if self.mask is None else float((self.mask > 0).mean())

    def summary(self) -> str:
        lines = [f"valid: {self.is_valid} ({self.validation.reason})", *(f"{k}: {v}" for k, v in self.metadata.items())]
        return "\n".join(lines)


def run(rgb: np.ndarray, orientation: int = 1, size: tuple[int, int] = (512, 512), method: str = "rembg", denoiser: str = "nlmeans", augmented: bool = False, seed: int | None = None, min_size: int = 64) -> Result:
    """All steps for one image."""
    check = validate(rgb, min_size)
    meta = {"original_size": f"{rgb.shape[1]}x{rgb.shape[0]}", "validation_issues": "; ".join(check.issues)}
    if not check:
        return Result(False, check, metadata=meta)
    x = denoise(letterbox(orient(rgb, orientation), size), denoiser)
    mask, x = segment(x, method)
    x, mask, box = crop(x, mask)
    x, mask = centre(x, mask, size)
    if augmented:
        x, mask = augment(x, mask, seed=seed)
    out = Result(True, check, x, mask, meta)
    meta |= {"output_size": f"{size[0]}x{size[1]}", "tree_coverage": f"{out.coverage:.4f}"} | {f"bbox_{k}": str(v) for k, v in zip("xywh", box, strict=True)}
    return out
