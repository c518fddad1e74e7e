"""Preview strips: the frames of a topic at the inner points of a bag, side by side in one picture.

A topic has as many frames as there are points (a handful, whatever the bag), so a group is small. Frames are resampled by area to
the largest width and height among them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payloads
from ..functions.messages import png

#: Up to ROW frames are one row, more of them have COLUMNS in a row.
ROW, COLUMNS = 7, 4


def shares(many: int, into: int) -> np.ndarray:
    """Of each of `into` equal parts of a line the share of each of its `many` equal parts."""
    edges = np.arange(into + 1) * many / into
    lo, hi = edges[:-1, None], edges[1:, None]
    at = np.arange(many)[None, :]
    return np.clip(np.minimum(hi, at + 1) - np.maximum(lo, at), 0, None) * into / many


def resampled(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Rows of RGB pixels at another size, each new pixel the mean of the area that it covers, halves rounded up."""
    rows, columns = shares(pixels.shape[0], height), shares(pixels.shape[1], width)
    mean = np.einsum("ij,jkc,lk->ilc", rows, pixels.astype(np.float64), columns)
    return np.floor(mean + 0.5 + 1e-9).clip(0, 255).astype(np.uint8)


def tiled(frames: list[np.ndarray]) -> np.ndarray:
    """Frames in their order on a white ground."""
    height, width = (max(f.shape[i] for f in frames) for i in (0, 1))
    columns = len(frames) if len(frames) <= ROW else COLUMNS
    out = np.full((-(-len(frames) // columns) * height, columns * width, 3), 255, np.uint8)
    for k, f in enumerate(frames):
        y, x = k // columns * height, k % columns * width
        out[y : y + height, x : x + width] = resampled(f, height, width)
    return out


def frames_of(samples: DataFrame, data: Column, encoding: Column, width: Column, height: Column) -> DataFrame:
    """samples (bag, topic, p, ...) of raw images with their RGB bytes; those of unknown encodings or with too few bytes are left out."""
    own = samples.select("bag", "topic", "p", width.cast("int").alias("width"), height.cast("int").alias("height"), payloads.rgb(data, encoding, width, height).alias("rgb"))
    return own.where("rgb is not null")


def strips(frames: DataFrame) -> DataFrame:
    """(bag, topic, frames, width, height, pixels, png) from frames (bag, topic, p, width, height, rgb)."""

    def strip(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")
        whole = tiled([np.frombuffer(d, np.uint8).reshape(h, w, 3) for d, w, h in zip(pdf["rgb"], pdf["width"], pdf["height"], strict=True)])
        bag, topic = pdf["bag"].iloc[0], pdf["topic"].iloc[0]
        return pd.DataFrame([(bag, topic, len(pdf), whole.shape[1], whole.shape[0], whole.tobytes(), png(whole))], columns=["bag", "topic", "frames", "width", "height", "pixels", "png"])

    return frames.groupBy("bag", "topic").applyInPandas(strip, "bag string, topic string, frames int, width int, height int, pixels binary, png binary")
