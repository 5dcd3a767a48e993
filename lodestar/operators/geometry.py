"""Geometry: image regions and tiles, layout boxes, reading order, rows and table runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of images and tiles.
MAX_PIXELS, MAX_SIDE, MAX_TILES, OVERLAP = 40_000_000, 1280, 64, 0.15


def valid_size(w: Column, h: Column) -> Column:
    return (w > 0) & (h > 0) & (w.cast("bigint") * h <= MAX_PIXELS)


def pixel_region(w: Column, h: Column, x: Column, y: Column, rw: Column, rh: Column) -> Column:
    """The pixels that a normalised region meets, as a struct of x, y, width, height."""
    left, top = F.floor(x * w), F.floor(y * h)
    right, bottom = F.least(w, F.ceil(F.least(F.lit(1.0), x + rw) * w)), F.least(h, F.ceil(F.least(F.lit(1.0), y + rh) * h))
    return F.struct(left.cast("int").alias("x"), top.cast("int").alias("y"), F.greatest(F.lit(1), right - left).cast("int").alias("width"), F.greatest(F.lit(1), bottom - top).cast("int").alias("height"))


def resize_target(w: Column, h: Column, side: int = MAX_SIDE) -> Column:
    """Size within ``side`` at the same proportions, never enlarged."""
    scale = F.least(F.lit(1.0), F.lit(float(side)) / F.greatest(w, h))
    return F.struct(F.greatest(F.lit(1), F.floor(w * scale)).cast("int").alias("width"), F.greatest(F.lit(1), F.floor(h * scale)).cast("int").alias("height"))


def tiles(images: DataFrame, tile_w: int, tile_h: int, overlap: float = OVERLAP, max_tiles: int = 16) -> DataFrame:
    """images (id, width, height) as rows of tiles, line by line; edge tiles shrink. Too many tiles for an image is an error."""
    tw, th = F.least(F.lit(tile_w), "width"), F.least(F.lit(tile_h), "height")
    sx, sy = (F.greatest(F.lit(1), F.ceil(t * (1 - overlap))).cast("int") for t in (tw, th))
    nx, ny = (1 + F.ceil((F.col(s) - t) / step).cast("int") for s, t, step in (("width", tw, sx), ("height", th, sy)))
    many = F.raise_error(F.concat(F.lit("image needs more tiles than the limit: "), F.col("id").cast("string")))
    sized = images.select("id", "width", "height", tw.alias("tw"), th.alias("th"), sx.alias("sx"), sy.alias("sy"), nx.alias("nx"), F.when(nx * ny <= max_tiles, ny).otherwise(many.cast("int")).alias("ny"))
    cut = sized.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("column", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    x, y = F.col("column") * F.col("sx"), F.col("row") * F.col("sy")
    return cut.select("id", "row", "column", x.alias("x"), y.alias("y"), F.least("tw", F.col("width") - x).alias("width"), F.least("th", F.col("height") - y).alias("height"))


def union_bounds(boxes: DataFrame, *key: str) -> DataFrame:
    """The least box around the boxes (x, y, w, h) of each key."""
    x, y = F.min("x"), F.min("y")
    return boxes.groupBy(*key).agg(x.alias("x"), y.alias("y"), (F.max(F.col("x") + F.col("w")) - x).alias("w"), (F.max(F.col("y") + F.col("h")) - y).alias("h"))


def transformed(x: Column, y: Column, w: Column, h: Column, m: tuple[float, ...], page_w: float, page_h: float) -> Column:
    """A text box under the affine map (a, b, c, d, e, f), clamped to the page."""
    a, b, c, d, e, f = m
    left, top = a * x + c * y + e, b * x + d * y + f
    cx, cy = F.greatest(F.lit(0.0), F.least(F.lit(page_w), left)), F.greatest(F.lit(0.0), F.least(F.lit(page_h), top))
    width, height = w * (a * a + b * b) ** 0.5, h * (c * c + d * d) ** 0.5
    return F.struct(cx.alias("x"), cy.alias("y"), F.least(width, page_w - cx).alias("w"), F.least(height, page_h - cy).alias("h"))


def rescaled(boxes: DataFrame, image_w: int, image_h: int, page_w: float, page_h: float) -> DataFrame:
    """Boxes (x, y, w, h) in pixels of an image as boxes in points of its page."""
    sx, sy = page_w / image_w, page_h / image_h
    return boxes.withColumns({k: F.col(k) * s for k, s in (("x", sx), ("y", sy), ("w", sx), ("h", sy))})


def reading_order(boxes: DataFrame, page: str = "page_id") -> DataFrame:
    """Adds the place of each box on its page: from top to bottom, then left to right, then as given."""
    return boxes.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("y", "x", "ord")))


def x_gap_cells(boxes: DataFrame, row: str, gap: float) -> DataFrame:
    """Adds the cell number of each box in its row: a new cell where the gap to the box before is wider than ``gap``."""
    by = Window.partitionBy(row).orderBy("x", "ord", "w")
    far = F.col("x") - F.lag(F.col("x") + F.col("w")).over(by) > gap
    return boxes.withColumn("cell", F.sum(F.when(far, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def row_clusters(boxes: DataFrame, tolerance: float, page: str = "page_id") -> DataFrame:
    """Adds the line of each box: a box joins the open line if its y is near that line's first box.

    The comparison with the first of the run is sequential, so sorted partitions stream through Python, whole pages in a
    partition, with only the open line's state between batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, first, n = object(), 0.0, 0
        for pdf in batches:
            lines = []
            for key, y in zip(pdf[page], pdf["y"], strict=True):
                if key != own:
                    own, first, n = key, y, 0
                elif abs(y - first) > tolerance:
                    first, n = y, n + 1
                lines.append(n)
            yield pdf.assign(line=pd.Series(lines, index=pdf.index, dtype="int32"))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.schema)
    return boxes.repartition(page).sortWithinPartitions(page, "y", "x", "ord").mapInPandas(run, f"{kinds}, line int")


def table_runs(cells: DataFrame) -> DataFrame:
    """cells (page_id, line, cell, x): runs of at least two successive lines with as many cells, at least two, that start at
    the same places: (page_id, first_line, lines, columns)."""
    lines = cells.groupBy("page_id", "line").agg(F.sort_array(F.collect_list("x")).alias("starts")).where(F.size("starts") > 1)
    by = Window.partitionBy("page_id").orderBy("line")
    new = (F.col("line") - F.lag("line").over(by) != 1) | ~F.col("starts").eqNullSafe(F.lag("starts").over(by))
    runs = lines.withColumn("new", F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("page_id", "run").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("lines"), F.first(F.size("starts")).alias("columns")).where("lines > 1").drop("run")


def block_faults(blocks: DataFrame) -> DataFrame:
    """OCR blocks outside their page, of no size, or with cell fields where there is no cell: (page_id, block_id, reason)."""
    cellish = F.col("row").isNotNull() | F.col("col").isNotNull()
    reason = (
        F.when((F.col("w") <= 0) | (F.col("h") <= 0), "no size").when((F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > F.col("page_w")) | (F.col("y") + F.col("h") > F.col("page_h")), "out of bounds")
        .when((F.col("kind") != "cell") & cellish, "cell fields").when((F.col("kind") == "cell") & ~(F.col("row").isNotNull() & F.col("col").isNotNull()), "cell without a place")
    )
    return blocks.withColumn("reason", reason).where("reason is not null").select("page_id", "block_id", "reason")


def nucleus(logits: DataFrame, p: float, k: int, temperature: float = 1.0) -> DataFrame:
    """logits (id, token, logit): of each id the k largest, cut where the probability before a token reaches p."""
    by = Window.partitionBy("id")
    order = by.orderBy(F.desc("logit"), "token")
    kept = logits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    weight = kept.withColumn("e", F.exp((F.col("logit") - F.max("logit").over(by)) / temperature)).withColumn("all", F.sum("e").over(by))
    before = F.coalesce(F.sum("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / F.col("all")
    return weight.withColumn("before", before).where(F.col("before") < p).select("id", "token", "rank", (F.col("e") / F.col("all")).alias("prob"))
