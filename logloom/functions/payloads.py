"""Payload bytes: packed points, pictures, and the text forms of the smaller message types."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x: float, y: float, z: float, r: int, g: int, b: int>"
POINTS = f"array<{POINT}>"
# Fixed values of the message definition: data types of a point's fields.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}


def unpack_points(data: bytes | None, step: int, fields: list[tuple[str, int, int]], big: bool = False, drop_zero: bool = True) -> list[tuple]:
    """Finite points of a packed cloud. Colour is a packed rgb field, or r, g and b of which fractions up to 1 count 255 fold."""
    n = len(data or b"") // step if step else 0
    if not n:
        return []
    raw = np.frombuffer(data, np.uint8)[: n * step].reshape(n, step)

    def column(offset: int, kind: int) -> np.ndarray:
        t = np.dtype((">" if big else "<") + TYPES[kind])
        if not 0 <= offset <= step - t.itemsize:
            raise ValueError("a field beyond its point")
        return np.ascontiguousarray(raw[:, offset : offset + t.itemsize]).view(t)[:, 0]

    by = {name: (offset, kind) for name, offset, kind in fields}
    x, y, z = (column(*by[c]).astype(np.float32) if c in by else np.zeros(n, np.float32) for c in "xyz")
    colour = [np.zeros(n, np.int32)] * 3
    packed = by.get("rgb") or by.get("rgba")
    if packed:
        bits = column(packed[0], 6).astype(np.int64)
        colour = [(bits >> s & 255).astype(np.int32) for s in ((24, 16, 8) if big else (16, 8, 0))]
    elif all(c in by for c in "rgb"):
        parts = [column(*by[c]) for c in "rgb"]
        colour = [np.where(p <= 1, p * 255, p).astype(np.int32) if p.dtype.kind == "f" else p.astype(np.int32) for p in parts]
    ok = np.isfinite(x) & np.isfinite(y) & np.isfinite(z)
    if drop_zero:
        ok &= (x != 0) | (y != 0) | (z != 0)
    return list(zip(*(c[ok].tolist() for c in (x, y, z, *colour)), strict=True))


def points(data: Column, step: Column, fields: Column, big: Column, drop_zero: bool = True) -> Column:
    """data: bytes; fields: array of structs (name, offset, datatype). Null bytes are no points; null for fields beyond a point
    or of an unknown datatype."""

    def run(d: pd.Series, s: pd.Series, f: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, n, fs, e in zip(d, s, f, b, strict=True):
            try:
                got = unpack_points(x, int(n or 0), [(q["name"], int(q["offset"]), int(q["datatype"])) for q in (fs if fs is not None else [])], bool(e), drop_zero)
            except (ValueError, KeyError):
                out.append(None)
                continue
            out.append([dict(zip(("x", "y", "z", "r", "g", "b"), p, strict=True)) for p in got])
        return pd.Series(out)

    return F.pandas_udf(run, POINTS)(data, step, fields, big)


def to_rgb(data: bytes | None, encoding: str | None, width: int, height: int) -> bytes | None:
    """Pixels as 8-bit RGB rows; None for encodings that are not pictures and for too few bytes."""
    channels = {"rgb8": (3, (0, 1, 2)), "bgr8": (3, (2, 1, 0)), "rgba8": (4, (0, 1, 2)), "bgra8": (4, (2, 1, 0)), "mono8": (1, (0, 0, 0)), "8uc1": (1, (0, 0, 0)), "8uc3": (3, (2, 1, 0)), "mono16": (1, (0, 0, 0)), "16uc1": (1, (0, 0, 0))}
    if data is None or (key := (encoding or "").lower()) not in channels:
        return None
    n, order = channels[key]
    wide = key in ("mono16", "16uc1")
    need = width * height * n * (2 if wide else 1)
    if need <= 0 or len(data) < need:
        return None
    px = np.frombuffer(data[:need], "<u2" if wide else np.uint8).reshape(height, width, n)
    px = (px // 256).astype(np.uint8) if wide else px
    return px[:, :, list(order)].tobytes()


def rgb(data: Column, encoding: Column, width: Column, height: Column) -> Column:
    def run(d: pd.Series, e: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([to_rgb(x, y, int(a or 0), int(b or 0)) for x, y, a, b in zip(d, e, w, h, strict=True)])

    return F.pandas_udf(run, "binary")(data, encoding, width, height)


def message_text(msg_type: Column, message: Column) -> Column:
    """JSON of a decoded struct for the types that are exported as JSON; other types in their plain text form."""
    return F.when(msg_type.rlike("(NavSatFix|BESTPOS|Imu|Odometry|TFMessage)$"), F.to_json(message)).otherwise(message.cast("string"))


def first_transform(transforms: Column) -> Column:
    return F.get(transforms, F.lit(0))


def image_base64(data: Column) -> Column:
    return F.base64(data)
