"""Minimal PNG writer (8-bit RGB, filter 0) for synthetic test images; no imaging library needed."""

import struct
import zlib

import numpy as np


def png_bytes(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    raw = b"".join(b"\x00" + rgb[y].astype(np.uint8).tobytes() for y in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)

    ihdr = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", ihdr) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def grey_rgb(g: np.ndarray) -> np.ndarray:
    return np.repeat(g[:, :, None], 3, axis=2).astype(np.uint8)


def fixture_images(seed: int = 5) -> dict[str, bytes]:
    rnd = np.random.default_rng(seed)
    h, w = 40, 64
    noise = rnd.integers(0, 256, size=(h, w, 3), dtype=np.uint8)
    flat = np.full((h, w, 3), 77, dtype=np.uint8)

    def banded(n_flat):
        img = noise.copy()
        for y in range(h // 2, h // 2 + n_flat):
            img[y] = 120
        return img

    top = noise.copy()
    top[: h // 2] = 9
    g = np.zeros((h, w), dtype=np.uint8)
    g[:, ::2] = 100
    g[:, 1::2] = 104
    g[: h // 2] = rnd.integers(0, 256, size=(h // 2, w))
    return {
        "noise.png": png_bytes(noise),
        "flat.png": png_bytes(flat),
        "band_30.png": png_bytes(banded(6)),  # 6 of 20 bottom rows = 0.30
        "band_35.png": png_bytes(banded(7)),  # 0.35
        "top_flat.png": png_bytes(top),
        "std2.png": png_bytes(grey_rgb(g)),
        "junk.png": b"junk",
        "empty.png": b"",
    }
