"""Relations of sources: selection, constraint checks, container ancestry, table headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Protocols that a resource may have.
SAFE = ("http", "https", "data")


def select_sources(sources: DataFrame, wanted: DataFrame, key: str, predicate: Column | None = None) -> DataFrame:
    """Sources whose key is wanted and that meet the predicate."""
    kept = sources.join(wanted.select(key).distinct(), key, "left_semi")
    return kept if predicate is None else kept.where(predicate)


def unknown_ids(wanted: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Wanted keys that no source has: a selection with one is an error."""
    return wanted.select(key).distinct().join(sources.select(key), key, "left_anti")


def duplicate_ids(sources: DataFrame, *key: str) -> DataFrame:
    return sources.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose reference is set but names no parent."""
    return children.where(F.col(child_key).isNotNull()).join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def cascade_selection(containers: DataFrame, retained: list[str] | Column) -> DataFrame:
    """Containers reduced to retained paragraph ids; those left with none go."""
    kept = retained if isinstance(retained, Column) else F.array(*map(F.lit, retained))
    return containers.withColumn("paragraph_ids", F.filter("paragraph_ids", lambda p: F.array_contains(kept, p))).where(F.size("paragraph_ids") > 0)


def overlapping_cells(cells: DataFrame) -> DataFrame:
    """(table_id, r, c) grid places that more than one cell covers."""
    spread = cells.withColumn("r", F.explode(F.expr("sequence(row, row + row_span - 1)"))).withColumn("c", F.explode(F.expr("sequence(col, col + col_span - 1)")))
    return spread.groupBy("table_id", "r", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def allowed_url(url: Column) -> Column:
    """http, https or data, and no credentials in it."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return scheme.isin(*SAFE) & ~url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@")


def ancestry(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, depth) of a forest of (id, parent_id), the node itself at depth 0: a join for each level, whose rows are
    stored. A cycle is an error."""
    up = stored(nodes.select("id", "parent_id"), "ancestry-nodes")
    front = up.select("id", F.col("id").alias("ancestor"), F.col("parent_id").alias("next"), F.lit(0).alias("depth"))
    levels, most = [front], up.count()
    while not front.where("next is not null").isEmpty():
        if len(levels) > most:
            raise ValueError("the containers have a cycle")
        step = front.join(up.select(F.col("id").alias("next"), F.col("parent_id").alias("after")), "next")
        front = stored(step.select("id", F.col("next").alias("ancestor"), F.col("after").alias("next"), (F.col("depth") + 1).alias("depth")), "ancestry-level")
        levels.append(front)
    return reduce(DataFrame.unionAll, levels).select("id", "ancestor", "depth")


def cyclic_parents(nodes: DataFrame) -> DataFrame:
    """Nodes that never reach a root. Pointers double with each join, until a round brings no node to a root: then no chain is
    longer, whatever its depth."""
    step = stored(nodes.select("id", F.col("parent_id").alias("up")), "cycles")
    left = step.where("up is not null").count()
    while left:
        step = step.alias("a").join(step.alias("b"), F.col("a.up") == F.col("b.id"), "left").select(F.col("a.id").alias("id"), F.col("b.up").alias("up"))
        step = stored(step, "cycles")
        was, left = left, step.where("up is not null").count()
        if left == was:
            break
    return step.where("up is not null").select("id")


def header_links(cells: DataFrame) -> DataFrame:
    """(table_id, cell_id, header_id, axis): implicit headers of each cell by where they stand.

    Row headers: scope rowgroup in the cell's group, or row or none with rows that overlap and a smaller column. Column
    headers: colgroup with columns that overlap, or col or none with columns that overlap and a smaller row. Headers are put
    at each row, column or group that they cover, so the interval join becomes equi-joins; a pair found twice counts once. The
    cells are stored first, as they are joined three times and may come from a parse. Cells pack well, so the size of their files
    says little of the rows': without the hint the planner sends headers, or all cells, through the driver to every task.
    """
    cells = stored(cells, "cells").hint("merge")
    head = cells.where("kind = 'header'").select(*(F.col(c).alias(f"h_{c}") for c in ("table_id", "cell_id", "row", "col", "row_span", "col_span", "row_group", "scope")))
    other = (F.col("table_id") == F.col("h_table_id")) & (F.col("cell_id") != F.col("h_cell_id"))
    pick = lambda df, axis: df.select("table_id", "cell_id", F.col("h_cell_id").alias("header_id"), F.lit(axis).alias("axis"))
    scope = lambda s: F.coalesce(F.col("h_scope"), F.lit("none")).isin(*s)
    cell_at = lambda kind: cells.withColumn("at", F.explode(F.expr(f"sequence({kind}, {kind} + {kind}_span - 1)")))
    head_at = lambda kind: head.withColumn("h_at", F.explode(F.expr(f"sequence(h_{kind}, h_{kind} + h_{kind}_span - 1)")))
    rows = cell_at("row").join(head_at("row").where(scope(("row", "none"))), other & (F.col("at") == F.col("h_at")) & (F.col("h_col") < F.col("col")))
    groups = cells.join(head.where(scope(("rowgroup",))), other & (F.col("row_group") == F.col("h_row_group")))
    columns = cell_at("col").join(head_at("col").where(scope(("col", "none", "colgroup"))), other & (F.col("at") == F.col("h_at")) & (scope(("colgroup",)) | (F.col("h_row") < F.col("row"))))
    return pick(rows, "row").unionByName(pick(groups, "row")).unionByName(pick(columns, "column")).distinct()


def explicit_headers(cells: DataFrame) -> DataFrame:
    """(table_id, cell_id, header_id) of cells' own header lists by HTML id; ids that stand twice in a table name nothing."""
    named = cells.where("html_id is not null").withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("table_id", "html_id"))).where("same = 1 and kind = 'header'")
    listed = cells.where("headers is not null").select("table_id", "cell_id", F.explode(F.array_distinct(F.filter(F.split(F.trim("headers"), "\\s+"), lambda x: x != ""))).alias("html_id"))
    return listed.join(named.select("table_id", "html_id", F.col("cell_id").alias("header_id")), ["table_id", "html_id"]).where("cell_id <> header_id").select("table_id", "cell_id", "header_id")


def image_groups(found: DataFrame) -> DataFrame:
    """found (page_id, ord, url, kind, alt, caption): one row for each URL of a page, the first alt and caption, all kinds."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("ord")))
    return found.groupBy("page_id", "url").agg(F.min("ord").alias("ord"), first("alt").alias("alt"), first("caption").alias("caption"), F.array_sort(F.collect_set("kind")).alias("discovered_by"))
