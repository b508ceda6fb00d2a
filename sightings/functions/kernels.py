"""NumPy kernels for the per-image work (called from pandas UDFs, one Arrow batch at a time).

Images use the layout of Spark's ``image`` source: row-major bytes, BGR(A) channel order.
OpenCV is not available, so its 8-bit grey conversion and bilinear resize are written out:

* grey = (1868 * B + 9617 * G + 4899 * R + 8192) >> 14  (the 0.114 / 0.587 / 0.299 weights in
  14-bit fixed point, as OpenCV computes 8-bit BGR -> GRAY),
* bilinear resize with half-pixel centres, source coordinate clamped to the image (OpenCV's
  INTER_LINEAR geometry; OpenCV rounds its 8-bit weights to 11 bits, so pixels can differ by 1).
"""

from __future__ import annotations

import numpy as np

from .. import config

# Fixed values (must equal the reference): OpenCV grey weights in 14-bit fixed point.
GREY_B, GREY_G, GREY_R, GREY_SHIFT = 1868, 9617, 4899, 14


def to_array(data: bytes | None, height: int, width: int, channels: int) -> np.ndarray | None:
    """Raw image bytes -> uint8 array (h, w, 3) in BGR order (alpha dropped, grey expanded)."""
    if data is None or height is None or height <= 0 or width <= 0 or len(data) == 0:
        return None
    a = np.frombuffer(data, dtype=np.uint8)
    if a.size != height * width * channels:
        return None
    a = a.reshape(height, width, channels)
    if channels == 1:
        return np.repeat(a, 3, axis=2)
    return a[:, :, :3]


def grey(bgr: np.ndarray) -> np.ndarray:
    b = bgr[:, :, 0].astype(np.int32)
    g = bgr[:, :, 1].astype(np.int32)
    r = bgr[:, :, 2].astype(np.int32)
    return ((GREY_B * b + GREY_G * g + GREY_R * r + (1 << (GREY_SHIFT - 1))) >> GREY_SHIFT).astype(np.uint8)


def flat_share(rows: np.ndarray, low_std: float) -> float:
    """Share of the rows of a grey image whose population variance is below ``low_std`` squared, in whole numbers:
    n * sum(x^2) - sum(x)^2 is n^2 times the variance."""
    x, n = rows.astype(np.int64), rows.shape[1]
    spread = n * np.einsum("ij,ij->i", x, x) - x.sum(axis=1) ** 2
    return np.count_nonzero(spread < (low_std * n) ** 2) / max(len(x), 1)


def frame_quality(bgr: np.ndarray | None, low_std: float = config.LOW_STD,
                  flat_ratio: float = config.FLAT_RATIO) -> tuple[bool, str | None]:
    """(is_corrupt, reason). A frame without pixels is an "empty frame"; one whose bytes are all alike over all
    channels (A11) has a "single value"; "flat rows" make up more than ``flat_ratio`` of the lower half."""
    pixels = np.zeros((0, 0, 3), np.uint8) if bgr is None else bgr
    verdicts = {
        "empty frame": lambda: pixels.size == 0,
        "single value": lambda: pixels.min() == pixels.max(),
        "flat rows": lambda: flat_share(grey(pixels)[pixels.shape[0] // 2:], low_std) > flat_ratio,
    }
    reason = next((name for name, holds in verdicts.items() if holds()), None)
    return reason is not None, reason


def _axis(n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    scale = n_in / n_out
    src = (np.arange(n_out, dtype=np.float64) + 0.5) * scale - 0.5
    src = np.clip(src, 0.0, n_in - 1)
    i0 = np.floor(src).astype(np.int64)
    i1 = np.minimum(i0 + 1, n_in - 1)
    return i0, i1, (src - i0)


def resize_bilinear(img: np.ndarray, out_h: int, out_w: int) -> np.ndarray:
    """Half-pixel-centre bilinear resize of (h, w, c) to (out_h, out_w, c) as float64."""
    y0, y1, wy = _axis(img.shape[0], out_h)
    x0, x1, wx = _axis(img.shape[1], out_w)
    f = img.astype(np.float64)
    top = f[y0][:, x0] * (1 - wx)[None, :, None] + f[y0][:, x1] * wx[None, :, None]
    bot = f[y1][:, x0] * (1 - wx)[None, :, None] + f[y1][:, x1] * wx[None, :, None]
    return top * (1 - wy)[:, None, None] + bot * wy[:, None, None]


MEAN = np.array(config.NORM_MEAN, dtype=np.float32)
STD = np.array(config.NORM_STD, dtype=np.float32)


def normalise_chw(rgb01: np.ndarray) -> np.ndarray:
    """(h, w, 3) RGB in [0, 1] -> normalised float32 CHW, flattened."""
    x = (rgb01.astype(np.float32) - MEAN) / STD
    return np.ascontiguousarray(np.transpose(x, (2, 0, 1))).reshape(-1)


def tensorize(bgr: np.ndarray, size: int = config.INPUT_SIZE) -> np.ndarray:
    """M1: BGR -> RGB, bilinear S x S (aspect not kept), rounded to uint8 as an 8-bit resize
    would, /255, mean/std normalisation, CHW float32 (length 3*S*S)."""
    rgb = bgr[:, :, ::-1]
    r = np.clip(np.rint(resize_bilinear(rgb, size, size)), 0, 255)
    return normalise_chw(r / 255.0)


def _grey01(rgb: np.ndarray) -> np.ndarray:
    return 0.299 * rgb[..., 0] + 0.587 * rgb[..., 1] + 0.114 * rgb[..., 2]


def augment(bgr: np.ndarray, size: int, seed: int, train: bool = True, jitter: float = 0.2) -> np.ndarray:
    """M2: train: resize (S+32)^2, random S crop, horizontal flip p=0.5, brightness / contrast /
    saturation jitter in [1-j, 1+j] in random order, normalise. Val: resize S, normalise.
    The generator is seeded per row, so a (seed, path, epoch) key reproduces the sample."""
    rgb = bgr[:, :, ::-1].astype(np.float64)
    if not train:  # the serving tensor, bit for bit
        return tensorize(bgr, size)
    rng = np.random.default_rng(np.uint64(seed & 0xFFFFFFFFFFFFFFFF))
    big = np.clip(resize_bilinear(rgb, size + 32, size + 32), 0, 255) / 255.0
    top = int(rng.integers(0, 33))
    left = int(rng.integers(0, 33))
    x = big[top:top + size, left:left + size]
    if rng.random() < 0.5:
        x = x[:, ::-1]
    factors = rng.uniform(1 - jitter, 1 + jitter, size=3)
    for op in rng.permutation(3):
        f = factors[op]
        if op == 0:  # brightness
            x = np.clip(x * f, 0, 1)
        elif op == 1:  # contrast: blend with the mean grey level
            m = _grey01(x).mean()
            x = np.clip((x - m) * f + m, 0, 1)
        else:  # saturation: blend with the grey image
            g = _grey01(x)[..., None]
            x = np.clip((x - g) * f + g, 0, 1)
    return normalise_chw(x)


def crop(bgr: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    """M7: pixel slice [y1:y2, x1:x2] (a copy)."""
    return bgr[y1:y2, x1:x2].copy()


def draw_boxes(bgr: np.ndarray, boxes, thickness: int = 2, color=(0, 255, 0)) -> np.ndarray:
    """A green rectangle outline per (x1, y1, x2, y2), later boxes drawn over earlier ones.
    The outline is a ``thickness``-pixel band on each edge, clipped to the frame."""
    out = bgr.copy()
    h, w = out.shape[:2]
    t0 = thickness // 2
    t1 = thickness - t0
    for b in boxes or []:
        if b is None or len(b) != 4 or any(v is None for v in b):
            continue
        x1, y1, x2, y2 = (int(v) for v in b)
        for (ya, yb, xa, xb) in (
            (y1 - t0, y1 + t1, x1 - t0, x2 + t1), (y2 - t0, y2 + t1, x1 - t0, x2 + t1),
            (y1 - t0, y2 + t1, x1 - t0, x1 + t1), (y1 - t0, y2 + t1, x2 - t0, x2 + t1),
        ):
            ya, yb = max(ya, 0), min(yb, h)
            xa, xb = max(xa, 0), min(xb, w)
            if ya < yb and xa < xb:
                out[ya:yb, xa:xb] = color
    return out
