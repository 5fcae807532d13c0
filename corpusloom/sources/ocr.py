"""Images to text: preprocessing in numpy and a pluggable recogniser as a column function.

No recogniser is bundled.  :func:`register` takes any callable that gives the
words of an image with their confidences; everything around it runs in Arrow
batches on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of an image and their confidence (0 to 100), from its bytes and the languages to expect.
Recogniser = Callable[[bytes, tuple[str, ...]], list[tuple[str, float]]]
_RECOGNISERS: dict[str, Recogniser] = {}


def register(name: str, recogniser: Recogniser) -> None:
    _RECOGNISERS[name] = recogniser


def recogniser(name: str = "default") -> Recogniser:
    if name not in _RECOGNISERS:
        raise RuntimeError(f"no recogniser {name!r} is registered")
    return _RECOGNISERS[name]


def read(image: Column, recognise: Recogniser, langs: tuple[str, ...] = ("eng",)) -> Column:
    """struct<text, confidence> of an image column; the confidence is the mean over words, null without any."""

    @F.pandas_udf("text string, confidence double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for images in batches:
            rows = [_joined(recognise(bytes(x), langs)) if x is not None else ("", None) for x in images]
            yield pd.DataFrame(rows, columns=["text", "confidence"])

    return run(image)


def _joined(words: list[tuple[str, float]]) -> tuple[str, float | None]:
    known = [(w, c) for w, c in words if w.strip()]
    return " ".join(w for w, _ in known), float(np.mean([c for _, c in known])) if known else None


# --- preprocessing ----------------------------------------------------------


def grayscale(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) if image.ndim == 2 else image[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def equalise(gray: np.ndarray, tiles: int = 8, limit: float = 2.0) -> np.ndarray:
    """Histogram equalisation by tiles; bins above ``limit`` times the mean are cut and spread."""
    out = np.empty_like(gray)
    for rows in np.array_split(np.arange(gray.shape[0]), min(tiles, gray.shape[0])):
        for cols in np.array_split(np.arange(gray.shape[1]), min(tiles, gray.shape[1])):
            part = np.clip(gray[np.ix_(rows, cols)], 0, 255).astype(np.int64)
            counts = np.bincount(part.ravel(), minlength=256).astype(np.float64)
            most = limit * counts.mean()
            counts = np.minimum(counts, most) + np.maximum(counts - most, 0).sum() / 256
            out[np.ix_(rows, cols)] = 255 * (np.cumsum(counts) / counts.sum())[part]
    return out


def median(gray: np.ndarray) -> np.ndarray:
    """Median of each pixel's 3 x 3 neighbourhood."""
    padded = np.pad(gray, 1, mode="edge")
    h, w = gray.shape
    return np.median(np.stack([padded[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0)


def _means(x: np.ndarray, size: int) -> np.ndarray:
    half = size // 2
    padded = np.pad(x, ((half + 1, half), (half + 1, half)), mode="edge").cumsum(0).cumsum(1)
    n = 2 * half + 1
    return (padded[n:, n:] - padded[:-n, n:] - padded[n:, :-n] + padded[:-n, :-n]) / (n * n)


def sauvola(gray: np.ndarray, size: int = 25, k: float = 0.2) -> np.ndarray:
    """Black (0) and white (255) by a threshold from the mean and deviation around each pixel."""
    mean = _means(gray, size)
    deviation = np.sqrt(np.maximum(_means(gray * gray, size) - mean * mean, 0))
    return np.where(gray > mean * (1 + k * (deviation / 128 - 1)), 255, 0).astype(np.uint8)


def otsu(gray: np.ndarray) -> np.ndarray:
    """Black and white by the one threshold that parts the histogram best."""
    counts = np.bincount(np.clip(gray, 0, 255).astype(np.int64).ravel(), minlength=256).astype(np.float64)
    weight, total = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    rest = weight[-1] - weight
    with np.errstate(divide="ignore", invalid="ignore"):
        between = weight * rest * (total / weight - (total[-1] - total) / rest) ** 2
    return np.where(gray > np.argmax(np.nan_to_num(between)), 255, 0).astype(np.uint8)


def skew(black: np.ndarray, most: float = 5.0, step: float = 0.5) -> float:
    """Angle in degrees at which the rows of dark pixels are sharpest."""
    y, x = np.nonzero(black == 0)
    if not len(y):
        return 0.0
    angles = np.arange(-most, most + step, step)
    sharp = [np.var(np.bincount(np.rint(y * np.cos(a) - x * np.sin(a)).astype(np.int64) + black.shape[1] + black.shape[0])) for a in np.deg2rad(angles)]
    return float(angles[int(np.argmax(sharp))])


def rotated(image: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned about its middle, nearest pixel, edges repeated."""
    if not degrees:
        return image
    a, (h, w) = np.deg2rad(degrees), image.shape
    y, x = np.mgrid[0:h, 0:w]
    y, x = y - h / 2, x - w / 2
    from_y, from_x = y * np.cos(a) + x * np.sin(a) + h / 2, x * np.cos(a) - y * np.sin(a) + w / 2
    return image[np.clip(np.rint(from_y), 0, h - 1).astype(int), np.clip(np.rint(from_x), 0, w - 1).astype(int)]


def preprocess(image: np.ndarray) -> np.ndarray:
    """Gray, equalised, without specks, black and white, upright; all one colour falls back to one threshold."""
    gray = median(equalise(grayscale(image)))
    black = sauvola(gray)
    if black.min() == black.max():
        black = otsu(gray)
    return rotated(black, skew(black))
