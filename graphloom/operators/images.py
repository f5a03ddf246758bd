"""Image measurements in NumPy, run per image inside ``mapInPandas``: what needs no vision library."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = 1024


def decode_pnm(data: bytes | None) -> np.ndarray | None:
    """A binary PGM or PPM as (height, width[, 3]) floats, None where it can't be read."""
    if not data or data[:2] not in (b"P5", b"P6"):
        return None
    fields, at = [], 2
    while len(fields) < 3 and at < len(data):
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    w, h, _ = fields
    depth = 3 if data[:2] == b"P6" else 1
    body = np.frombuffer(data, np.uint8, offset=at + 1)
    if len(body) < w * h * depth:
        return None
    return _bounded(body[: w * h * depth].reshape((h, w, 3) if depth == 3 else (h, w)).astype(np.float64))


def _bounded(img: np.ndarray) -> np.ndarray:
    """Every n-th row and column, so that neither side is longer than ``LARGEST``."""
    step = max(1, -(-max(img.shape[:2]) // LARGEST))
    return img[::step, ::step]


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    """One row of a PNG with its filter undone; sums are modulo 256."""
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.add.accumulate(row.reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()
    out = bytearray(row.tobytes())
    up = above.tobytes()
    for i in range(len(out)):
        a, b = out[i - bpp] if i >= bpp else 0, up[i]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            c = up[i - bpp] if i >= bpp else 0
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        out[i] = (out[i] + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)


#: Colour type of a PNG -> numbers a pixel.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(data: bytes | None) -> np.ndarray | None:
    """A PNG of 8 bits a sample, not interlaced, as (height, width[, 3]) floats without its transparency; None where it can't be read."""
    if not data or data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, head, palette, packed = 8, None, None, []
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR" and len(body) == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6] or not head[0] or not head[1] or (head[3] == 3 and palette is None):
        return None
    w, h, n = head[0], head[1], _CHANNELS[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error:
        return None
    if len(raw) < h * (w * n + 1):
        return None
    rows, above = np.empty((h, w * n), np.uint8), np.zeros(w * n, np.uint8)
    for y, line in enumerate(raw[: h * (w * n + 1)].reshape(h, w * n + 1)):
        if line[0] > 4:
            return None
        rows[y] = above = _unfilter(int(line[0]), line[1:], above, n)
    img = rows.reshape(h, w, n)
    if head[3] == 3:
        if img.max() >= len(palette):
            return None
        img = palette[img[:, :, 0]]
    img = img[:, :, 0] if n == 2 or img.shape[2] == 1 else img[:, :, :3]
    return _bounded(img.astype(np.float64))


def decode(data: bytes | None) -> np.ndarray | None:
    """A PNG, PGM or PPM, told apart by its first bytes; None for anything else."""
    return decode_png(data) if data and data[:4] == b"\x89PNG" else decode_pnm(data)


# Measures of which any one above zero means that something was found, and flags that say so themselves.
FOUND_COUNTS = ("total_stains", "minutiae_count", "striation_count")
FOUND_FLAGS = ("wound_detected", "text_detected")


def has_findings(df: DataFrame) -> Column:
    """Whether the measures of an image found anything; measures that aren't there or are null count as nothing."""
    parts = [F.coalesce(F.col(c), F.lit(0)) > 0 for c in FOUND_COUNTS if c in df.columns] + [F.coalesce(F.col(c), F.lit(False)) for c in FOUND_FLAGS if c in df.columns]
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def gray(img: np.ndarray) -> np.ndarray:
    return img if img.ndim == 2 else img @ np.array([0.299, 0.587, 0.114])


def otsu(g: np.ndarray) -> float:
    hist = np.bincount(g.astype(int).ravel(), minlength=256).astype(float)
    p, m = np.cumsum(hist), np.cumsum(hist * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * p / p[-1] - m) ** 2 / (p * (p[-1] - p))
    return float(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Four-connected components by union of row runs."""
    ids = np.zeros(mask.shape, int)
    parent = [0]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.r_[False, row, False].astype(int)))
        for a, b in zip(edge[::2], edge[1::2]):
            above = {find(x) for x in np.unique(ids[i - 1, a:b]) if x} if i else set()
            k = min(above) if above else len(parent)
            if not above:
                parent.append(k)
            for x in above:
                parent[x] = k
            ids[i, a:b] = k
    roots = {r: n + 1 for n, r in enumerate(sorted({find(x) for x in range(1, len(parent))}))}
    table = np.array([0, *[roots[find(x)] for x in range(1, len(parent))]])
    return table[ids], len(roots)


def stains(img: np.ndarray, least: float = 100, most: float = 50_000) -> list[dict]:
    """Dark regions within the area limits: area, perimeter, box, axes, centroid."""
    g = gray(img)
    ids, n = label(g <= otsu(g))
    out = []
    for k in range(1, n + 1):
        ys, xs = np.nonzero(ids == k)
        if not least <= len(xs) <= most:
            continue
        m = ids == k
        inner = m.copy()
        inner[1:] &= m[:-1]
        inner[:-1] &= m[1:]
        inner[:, 1:] &= m[:, :-1]
        inner[:, :-1] &= m[:, 1:]
        ev = np.sort(np.linalg.eigvalsh(np.cov(xs, ys) + 1e-9 * np.eye(2)))
        out.append({"area": float(len(xs)), "perimeter": float(m.sum() - inner.sum()), "width": float(np.ptp(xs) + 1), "height": float(np.ptp(ys) + 1), "major": float(4 * np.sqrt(ev[1])), "minor": float(4 * np.sqrt(max(0, ev[0]))), "center_x": float(xs.mean()), "center_y": float(ys.mean())})
    return out


def sharpness(img: np.ndarray) -> dict:
    """Sobel magnitude (max, mean) and Laplacian variance."""
    g = np.pad(gray(img), 1, mode="edge")
    gx = (g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[1:-1, :-2] + g[2:, :-2])
    gy = (g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:]) - (g[:-2, :-2] + 2 * g[:-2, 1:-1] + g[:-2, 2:])
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    mag = np.hypot(gx, gy)
    return {"sobel_max": float(mag.max()), "sobel_mean": float(mag.mean()), "laplacian_var": float(lap.var())}


def line_count(img: np.ndarray) -> int:
    """Written lines: runs of rows with ink, rows up to five apart taken together."""
    g = gray(img)
    rows = np.flatnonzero((g <= otsu(g)).sum(axis=1) > 0)
    return int(len(rows) > 0) + int((np.diff(rows) > 5).sum()) if len(rows) else 0


def red_share(img: np.ndarray) -> float:
    """Share of clearly red pixels of a colour image."""
    if img.ndim == 2:
        return 0.0
    r, g, b = img[..., 0], img[..., 1], img[..., 2]
    return float(((r > 80) & (r > 1.5 * g) & (r > 1.5 * b)).mean())


def measure(df: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """One row an image: stains and measures; nulls where it can't be decoded."""

    def run(it):
        for pdf in it:
            rows = []
            for k, data in zip(pdf[key], pdf[content]):
                img = decode(bytes(data) if data is not None else None)
                rows.append((k, None, None, None, None, None, None) if img is None else (k, len(stains(img)), *sharpness(img).values(), line_count(img), red_share(img)))
            yield pd.DataFrame(rows, columns=[key, "n_stains", "sobel_max", "sobel_mean", "laplacian_var", "n_lines", "red_share"])

    return df.select(key, content).mapInPandas(run, f"{key} string, n_stains double, sobel_max double, sobel_mean double, laplacian_var double, n_lines double, red_share double")
