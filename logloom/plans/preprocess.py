"""From messages and positions to every derived table, by bag and segment.

Messages are read once for each output. Only those of one run need computing: pass the messages of unprocessed segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import align, exports, spatial


def tables(messages: DataFrame, positions: DataFrame | None = None) -> dict[str, DataFrame]:
    ticks = align.uniform_timeline(messages)
    aligned = align.nearest_messages(ticks, messages)
    out = {"aligned": aligned, "summary": align.summaries(ticks), "max_distance": align.max_distances(aligned)}
    if positions is not None:
        out["grid"] = spatial.grid(spatial.valid_positions(positions))
        out["boundary"] = spatial.boundaries(positions)
    return out


def write(made: dict[str, DataFrame], target: str) -> None:
    for name, df in made.items():
        by = ["bag", "mcap_id"] if "mcap_id" in df.columns else ["bag"]
        exports.write_tables(df.repartition(*(F.col(c) for c in by)), f"{target}/{name}", by)
