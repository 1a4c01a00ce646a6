"""Offsets of a drawn flow: nodes are stacked in columns, links along the sides of their nodes. All are running sums by group, see `prefix`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.prefix import running

#: Widths of a node and of a link without value, the gap below a node; fixed values.
NODE_WIDTH, LINK_WIDTH, NODE_PAD = 18, 1, 2


def stacked_nodes(nodes: DataFrame, ky: float, spacing: float, pad: float = NODE_PAD, ministry_gap: float = 0, limit: int | None = None) -> DataFrame:
    """nodes(id, col, place, value, layout_value) -> x0, x1, y0, y1. In each column they stand in the order of place; one is as high as its value, but takes the room of its
    layout_value where it has one, and below a low one the gap may be wider (pad)."""
    high = lambda v: F.greatest(F.lit(1.0), v * F.lit(float(ky)))
    room = high(F.coalesce("layout_value", "value"))
    gap = F.when(room < pad, float(pad)).otherwise(float(NODE_PAD)) if pad > NODE_PAD else F.lit(float(NODE_PAD))
    x0 = F.col("col") * F.lit(float(spacing)) + F.when(F.col("col") >= 2, float(ministry_gap)).otherwise(0.0)
    sized = nodes.withColumns({"room": room + gap, "height": high(F.col("value"))})
    return (running(sized, [F.col("place"), F.col("id")], {"upto": F.col("room")}, ("col",), limit=limit)
            .withColumns({"x0": x0, "x1": x0 + NODE_WIDTH, "y0": F.col("upto") - F.col("room")}).withColumn("y1", F.col("y0") + F.col("height")).drop("upto", "room", "height"))


def stacked_links(links: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """links(source, target, value) between nodes(id, y0, y1) -> source_y, source_width, target_y, target_width. Along a side links stand as their other ends do;
    each has its share of its node's height, one without value a hair's breadth that takes no room."""
    places = nodes.select("id", "y0", (F.col("y1") - F.col("y0")).alias("height"))
    out = links
    for end in ("source", "target"):
        out = out.join(places.select(F.col("id").alias(end), F.col("y0").alias(f"{end}_top"), F.col("height").alias(f"{end}_height")), end)
    for end, other in (("source", "target"), ("target", "source")):
        # whole values are summed, and then scaled once
        out = running(out, [F.col(f"{other}_top"), F.col(other)], {"upto": F.col("value")}, (end,), totals=True, limit=limit)
        scale = F.when(F.col("upto_all") > 0, F.col(f"{end}_height") / F.nullif("upto_all", F.lit(0))).otherwise(0.0)
        out = out.withColumns({f"{end}_width": F.when(F.col("value") == 0, float(LINK_WIDTH)).otherwise(F.col("value") * scale),
                               f"{end}_y": F.col(f"{end}_top") + (F.col("upto") - F.col("value")) * scale}).drop("upto", "upto_all")
    return out.select("source", "target", "value", "source_y", "source_width", "target_y", "target_width")
