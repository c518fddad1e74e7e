"""Polygon files in one folder: small documents that a client draws and that the driver keeps."""

from __future__ import annotations

import json
import re
from pathlib import Path


def saved_name(name: str) -> str:
    """The file of a polygon document: letters, digits, spaces, hyphens and underscores of its name."""
    kept = re.sub(r"[^a-zA-Z0-9\s_-]", "", name).strip()
    if not kept:
        raise ValueError(f"{name!r} has no letter or digit")
    return f"{kept}.json"


def save(folder: str, name: str, document: dict) -> str:
    """Write a FeatureCollection, in place of one of that name, and return its file's name."""
    if not isinstance(document, dict) or document.get("type") != "FeatureCollection":
        raise ValueError("a polygon document must be a FeatureCollection")
    target = Path(folder) / saved_name(name)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(document, indent=2))
    return target.name


def names(folder: str) -> list[str]:
    return sorted(p.name for p in Path(folder).glob("*.json"))


def delete(folder: str, file: str) -> None:
    """Delete a file of names(); no path leads out of the folder."""
    if not file.endswith(".json") or ".." in file or "/" in file or "\\" in file:
        raise ValueError(f"{file!r} is no polygon file")
    (Path(folder) / file).unlink()
