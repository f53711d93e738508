"""Pixel kernels as numpy functions, and the Arrow UDFs that apply them to image columns.

Images are rows of (height, width, data) with data as RGB bytes.  Only kernels that
numpy can state exactly are here; edge detectors and local histogram equalisation of a
particular imaging library are taken as input scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

SIZE, MARGIN, RADIUS = 64, 0.055, 0.45
SCALES, SHIFTS = (0.92, 0.96, 1.0, 1.04, 1.08), (-2, 0, 2)


def to_image(height: int, width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)


def gray(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area, by interpolated cumulative sums."""
    def along(a: np.ndarray, n: int) -> np.ndarray:
        total = np.concatenate((np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)))
        at = np.linspace(0, a.shape[0], n + 1)
        low = np.minimum(at.astype(int), a.shape[0] - 1)
        part = (at - low).reshape(-1, *[1] * (a.ndim - 1))
        edge = total[low] + part * (total[low + 1] - total[low])
        return (edge[1:] - edge[:-1]) * (n / a.shape[0])

    return np.swapaxes(along(np.swapaxes(along(x.astype(np.float64), height), 0, 1), width), 0, 1)


def disk(size: int = SIZE, radius: float = RADIUS) -> np.ndarray:
    c = (np.arange(size) + 0.5) / size - 0.5
    return c[:, None] ** 2 + c[None] ** 2 <= radius**2


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Mapped Pearson correlation, 0 where either side is flat."""
    da, db = a - a.mean(), b - b.mean()
    bottom = float(np.sqrt((da * da).sum() * (db * db).sum()))
    return 0.0 if bottom <= 1e-9 else float(np.clip(((da * db).sum() / bottom + 1) / 2, 0, 1))


def hue_saturation_histogram(image: np.ndarray, mask: np.ndarray, bins: tuple[int, int] = (24, 16)) -> np.ndarray:
    x = image.astype(np.float64) / 255
    top, low = x.max(axis=2), x.min(axis=2)
    span = top - low
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    safe = np.where(span > 0, span, 1)
    hue = np.where(top == r, (g - b) / safe % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) / 6
    hue, saturation = np.where(span > 0, hue, 0), np.where(top > 0, span / np.where(top > 0, top, 1), 0)
    out, _, _ = np.histogram2d(hue[mask], saturation[mask], bins=bins, range=((0, 1), (0, 1)))
    return out / max(out.sum(), 1)


def histogram_correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation of histograms; 1 where either has no variance."""
    da, db = a - a.mean(), b - b.mean()
    bottom = float(np.sqrt((da * da).sum() * (db * db).sum()))
    return 1.0 if bottom <= 1e-12 else float((da * db).sum() / bottom)


def prepare(image: np.ndarray) -> dict[str, np.ndarray]:
    """Margin crop, 64 x 64, circular mask, gray, colour and histogram features."""
    h, w = image.shape[:2]
    my, mx = int(h * MARGIN), int(w * MARGIN)
    small = area_resize(image[my : h - my or None, mx : w - mx or None], SIZE, SIZE)
    mask = disk()
    g = gray(small)
    return {"gray": g[mask], "gray_plane": g, "color": small[mask].ravel(), "histogram": hue_saturation_histogram(small, mask), "mask": mask}


def variants(plane: np.ndarray) -> list[np.ndarray]:
    """The plane at five scales and nine shifts."""
    out, n = [], plane.shape[0]
    for scale in SCALES:
        m = max(2, round(n * scale))
        big = area_resize(plane, m, m)
        if m >= n:
            at = (m - n) // 2
            same = big[at : at + n, at : at + n]
        else:
            at = (n - m) // 2
            same = np.pad(big, ((at, n - m - at),) * 2, mode="edge")
        out += [np.roll(same, (dy, dx), axis=(0, 1)) for dy in SHIFTS for dx in SHIFTS]
    return out


def aligned_correlation(a: dict, b: dict) -> float:
    """Best gray correlation over the reference's variants."""
    mask = a["mask"]
    bank = np.stack([v[mask] for v in variants(b["gray_plane"])])
    bank -= bank.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(bank, axis=1)
    q = a["gray"] - a["gray"].mean()
    bottom = norm * np.linalg.norm(q)
    r = np.where(bottom > 1e-9, bank @ q / np.where(bottom > 1e-9, bottom, 1), -1)
    return float(np.clip((r.max() + 1) / 2, 0, 1))


def fused(aligned: float, color: float, histogram: float, edge: float) -> float:
    """Fixed weights of the fused similarity."""
    return 0.55 * aligned + 0.20 * color + 0.20 * histogram + 0.05 * edge


def dct2(x: np.ndarray) -> np.ndarray:
    n = x.shape[0]
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n)) * np.sqrt(np.where(k[:, None] == 0, 1, 2) / n)
    return basis @ x @ basis.T


def perceptual_hash(image: np.ndarray) -> str:
    """64 low frequencies of a 32 x 32 gray plane against the median without the first."""
    low = dct2(area_resize(gray(image), 32, 32))[:8, :8].ravel()
    bits = low >= np.median(low[1:])
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def sharpness(image: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian."""
    g = gray(image)
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var()) if min(g.shape) > 2 else 0.0


def dynamic_range(image: np.ndarray) -> float:
    low, high = np.percentile(gray(image), (1, 99))
    return float((high - low) / 255)


def blockiness(image: np.ndarray, block: int = 8) -> float:
    """Mean step at block borders over the mean step elsewhere."""
    step = np.abs(np.diff(gray(image), axis=1))
    at = np.arange(step.shape[1]) % block == block - 1
    return float(step[:, at].mean() / max(step[:, ~at].mean(), 1e-9)) if at.any() and (~at).any() else 0.0


def best_offset(plane: np.ndarray, template: np.ndarray, exclude: int) -> tuple[int, int, float, float]:
    """(x, y, score, best score beyond the exclusion radius) of normalised matching."""
    th, tw = template.shape
    views = np.lib.stride_tricks.sliding_window_view(plane, (th, tw)).astype(np.float64)
    d = views - views.mean(axis=(2, 3), keepdims=True)
    t = template - template.mean()
    bottom = np.sqrt((d * d).sum(axis=(2, 3)) * (t * t).sum())
    r = np.where(bottom > 1e-9, (d * t).sum(axis=(2, 3)) / np.where(bottom > 1e-9, bottom, 1), 0.0)
    y, x = np.unravel_index(int(r.argmax()), r.shape)
    far = (np.abs(np.arange(r.shape[0])[:, None] - y) > exclude) | (np.abs(np.arange(r.shape[1])[None] - x) > exclude)
    return int(x), int(y), float(r[y, x]), float(r[far].max()) if far.any() else 0.0


@F.pandas_udf(StructType([StructField("phash", StringType()), *[StructField(c, DoubleType()) for c in ("sharpness", "dynamic_range", "blockiness")]]))
def image_features(height: pd.Series, width: pd.Series, data: pd.Series) -> pd.DataFrame:
    """Hash and quality of image rows, an Arrow batch at a time."""
    rows = []
    for h, w, d in zip(height, width, data, strict=True):
        image = to_image(h, w, d)
        rows.append((perceptual_hash(image), sharpness(image), dynamic_range(image), blockiness(image)))
    return pd.DataFrame(rows, columns=["phash", "sharpness", "dynamic_range", "blockiness"])
