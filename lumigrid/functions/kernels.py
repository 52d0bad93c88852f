"""Whole-image kernels in numpy, for image-grain frames. Arrays are (height, width, channels)."""

from __future__ import annotations

import numpy as np

from ..schema import PIXEL_TYPES

LUMA = (0.299, 0.587, 0.114)
METHODS = ("none", "nearest", "linear", "cubic")


def _unit(a: np.ndarray, kind: str) -> np.ndarray:
    _, low, high, _ = PIXEL_TYPES[kind]
    return (a.astype(np.float32) - np.float32(low)) / (np.float32(high) - np.float32(low)) * np.float32(255)


def _saturate(x: np.ndarray) -> np.ndarray:
    return np.clip(np.nan_to_num(x, nan=0.0, posinf=255.0, neginf=0.0), 0, 255).astype(np.uint8)


def cast_u8(a: np.ndarray, kind: str) -> np.ndarray:
    """Scale to 8 bits, half away from zero, saturating; NaN gives 0."""
    return a if kind == "u8" else _saturate(np.floor(_unit(a, kind).astype(np.float64) + 0.5))


def floor_u8(a: np.ndarray, kind: str) -> np.ndarray:
    return a if kind == "u8" else _saturate(np.floor(_unit(a, kind)))


def luma(a: np.ndarray, kind: str, weights=LUMA) -> np.ndarray:
    """Weighted sum over channels, left to right in double precision; truncated for integers, clamped to the type."""
    if len(weights) != a.shape[2]:
        raise ValueError("Number of channels and weights do not match.")
    total = np.zeros(a.shape[:2])
    for c, w in enumerate(weights):
        total += a[:, :, c].astype(np.float64) * w
    _, low, high, _ = PIXEL_TYPES[kind]
    if not kind.startswith("f"):
        total = np.trunc(total)
    total = np.where(np.isnan(total), total, np.clip(total, low, high))
    return total.astype(PIXEL_TYPES[kind][0])[:, :, None]


def colours(pattern: str, height: int, width: int) -> np.ndarray:
    tile = np.array(["RGB".index(p) for p in pattern]).reshape(2, 2)
    return np.tile(tile, ((height + 1) // 2, (width + 1) // 2))[:height, :width]


def debayer(a: np.ndarray, kind: str, pattern: str, method: str) -> np.ndarray:
    """Interpolate a (height, width) mosaic to three channels; borders reflect without repeating the edge."""
    height, width = a.shape
    if min(height, width) < (4 if method == "cubic" else 2):
        raise ValueError("WrongResolution")
    dtype = PIXEL_TYPES[kind][0]
    real = kind.startswith("f")
    own = colours(pattern, height, width)
    reach = 3 if method == "cubic" else 1
    wide = np.pad(a.astype(np.float64 if real else np.int64), reach, mode="reflect")
    near = lambda dy, dx: wide[reach + dy : reach + dy + height, reach + dx : reach + dx + width]

    def mean(taps):
        total = sum(near(dy, dx) for dy, dx in taps)
        return (total / len(taps)).astype(np.float32).astype(np.float64) if real else total // len(taps)

    def quotient(top, below):
        out = top / below
        if real:
            return out
        out = np.trunc(out)
        return np.where((out < PIXEL_TYPES[kind][1]) | (out > PIXEL_TYPES[kind][2]), PIXEL_TYPES[kind][2], out)

    across, along, corner = [(0, -1), (0, 1)], [(-1, 0), (1, 0)], [(-1, -1), (-1, 1), (1, -1), (1, 1)]
    if method == "none":
        cross = diagonal = beside = above = np.zeros((height, width))
    elif method == "nearest":
        cross, diagonal, beside, above = near(0, -1), near(-1, -1), near(0, -1), near(-1, 0)
    elif method == "linear":
        cross, diagonal, beside, above = mean(across + along), mean(corner), mean(across), mean(along)
    elif method == "cubic":
        signs = [(s, t) for s in (-1, 1) for t in (-1, 1)]
        far_axes = [(0, -3), (0, 3), (-3, 0), (3, 0)]
        knights = [(2 * s, t) for s, t in signs] + [(s, 2 * t) for s, t in signs]
        far_corner = [(3 * s, 3 * t) for s, t in signs]
        wide_knights = [(3 * s, t) for s, t in signs] + [(s, 3 * t) for s, t in signs]
        cross = quotient(324 * mean(across + along) + 4 * mean(far_axes) - 72 * mean(knights), 256)
        diagonal = quotient(324 * mean(corner) + 4 * mean(far_corner) - 72 * mean(wide_knights), 256)
        beside = quotient(18 * mean(across) - 2 * mean([(0, -3), (0, 3)]), 16)
        above = quotient(18 * mean(along) - 2 * mean([(-3, 0), (3, 0)]), 16)
    else:
        raise ValueError(f"Unknown method {method}")
    left = np.roll(own, 1, axis=1)
    left[:, 0] = own[:, 1]
    out = np.empty((height, width, 3), dtype)
    for c in range(3):
        if c == 1:
            value = np.where(own == 1, near(0, 0), cross)
        else:
            value = np.where(own == c, near(0, 0), np.where(own == 1, np.where(left == c, beside, above), diagonal))
        out[:, :, c] = value
    return out


def select_roi(a: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    """The stated rectangle, zero where it leaves the image."""
    if width < 1 or height < 1 or x < 0 or y < 0:
        raise ValueError("ROI needs a positive size.")
    if y >= a.shape[0] or x >= a.shape[1]:
        raise ValueError("ROI is out of bounds.")
    out = np.zeros((height, width, a.shape[2]), a.dtype)
    cut = a[y : y + height, x : x + width]
    out[: cut.shape[0], : cut.shape[1]] = cut
    return out


def copy_to(a: np.ndarray, into: np.ndarray, x: int, y: int) -> np.ndarray:
    """``into``'s shape, zeroed, with the part of ``a`` from (x, y) at its origin."""
    if a.shape[2] != into.shape[2]:
        raise ValueError("Channels do not match.")
    out = np.zeros_like(into)
    cut = a[y : y + into.shape[0], x : x + into.shape[1]]
    out[: cut.shape[0], : cut.shape[1]] = cut
    return out
