"""From polygons on the map to the messages of the segments inside: overlap, windows, parts, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import align, exports, spatial


def plan(positions: DataFrame, timeline: DataFrame, polygons: dict[str, spatial.Ring], metres: float = 0.0) -> DataFrame:
    """(bag, name, start_index, end_index, start_ts, end_ts, start_mcap, end_mcap) of every run of segments inside."""
    spark = positions.sparkSession
    grown = {f"{n}/{i}": r for n, ring in polygons.items() for i, r in enumerate(spatial.offset_rings(ring, metres))}
    cells = spatial.grid(spatial.valid_positions(positions))
    edges = spatial.polygon_edges(spark, grown)
    held = cells.join(spatial.bags_in_polygons(cells, edges, spatial.boxes(positions)), "bag", "left_semi")
    summary = align.summaries(timeline)
    windows = exports.windows_of_segments(spatial.segments_in_polygons(held, edges), summary)
    return exports.planned(exports.export_names(windows), timeline, summary)


def messages(planned: DataFrame, source: DataFrame, topics: list[str] | None = None) -> DataFrame:
    return exports.export_messages(source, planned, topics)
