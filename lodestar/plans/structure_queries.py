"""Queries of relations and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import relations as R
from .registry import query, table


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_totalprice > 1000")
def select_semi(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return R.select_sources(table(spark, sf_dir, "orders"), wanted, "o_custkey", F.col("o_totalprice") > 1000).select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def dangling_refs(spark, sf_dir):
    return R.dangling(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return R.duplicate_ids(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def unknown_selection(spark, sf_dir):
    return R.unknown_ids(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


@query(r"SELECT page_id, url, regexp_matches(url, '^(?i)(https?|data):') AND NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@') AS allowed FROM pages")
def url_policy_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", R.allowed_url(F.col("url")).alias("allowed"))


_NODES = """
    n AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"""


def _tree(spark, sf_dir):
    node = lambda t, a, b, up: table(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(b)).alias("id"), up.alias("parent_id"))
    regions = node("region", "r", "r_regionkey", F.lit(None).cast("string"))
    return regions.unionAll(node("nation", "n", "n_nationkey", F.concat(F.lit("r"), "n_regionkey"))).unionAll(node("customer", "c", "c_custkey", F.concat(F.lit("n"), "c_nationkey")))


@query(f"WITH RECURSIVE {_NODES}, u AS (SELECT id, id AS ancestor, parent_id AS nxt, 0 AS depth FROM n UNION ALL SELECT u.id, n.id, n.parent_id, u.depth + 1 FROM u JOIN n ON u.nxt = n.id) SELECT id, ancestor, depth FROM u")
def container_ancestry(spark, sf_dir):
    return R.ancestry(_tree(spark, sf_dir))


@query("SELECT id FROM (SELECT 'x' AS id UNION ALL SELECT 'y') v")
def cyclic_parents(spark, sf_dir):
    """A tree with one loop added: only the loop's nodes are found."""
    return R.cyclic_parents(_tree(spark, sf_dir).unionAll(spark.createDataFrame([("x", "y"), ("y", "x")], "id string, parent_id string")))


#: Cells made of order lines: a table for each order, columns by line number, three rows; the first row and column are headers.
_CELLS = """
    c AS (SELECT l_orderkey AS table_id, 'c' || (rw * 10 + l_linenumber) AS cell_id, CAST(rw AS INT) AS "row", l_linenumber AS col, CAST(1 + (l_partkey + rw) % 2 AS INT) AS row_span, 1 AS col_span,
          CAST(rw // 2 AS INT) AS row_group, CASE WHEN rw = 0 OR l_linenumber = 1 THEN 'header' ELSE 'data' END AS kind, CASE WHEN rw = 0 THEN 'col' WHEN l_suppkey % 3 = 0 THEN 'rowgroup' ELSE 'row' END AS scope
          FROM lineitem, (SELECT unnest([0, 1, 2]) AS rw) z)"""


def _cells(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("rw", F.explode(F.array(*map(F.lit, range(3)))))
    return li.select(
        F.col("l_orderkey").alias("table_id"), F.concat(F.lit("c"), F.col("rw") * 10 + F.col("l_linenumber")).alias("cell_id"), F.col("rw").alias("row"), F.col("l_linenumber").alias("col"),
        (1 + (F.col("l_partkey") + F.col("rw")) % 2).cast("int").alias("row_span"), F.lit(1).alias("col_span"), F.floor(F.col("rw") / 2).cast("int").alias("row_group"),
        F.when((F.col("rw") == 0) | (F.col("l_linenumber") == 1), "header").otherwise("data").alias("kind"), F.when(F.col("rw") == 0, "col").when(F.col("l_suppkey") % 3 == 0, "rowgroup").otherwise("row").alias("scope"),
    )


@query(f"""WITH {_CELLS},
    h AS (SELECT * FROM c WHERE kind = 'header')
    SELECT DISTINCT c.table_id, c.cell_id, h.cell_id AS header_id, CASE WHEN h.scope = 'col' THEN 'column' ELSE 'row' END AS axis FROM c JOIN h ON c.table_id = h.table_id AND c.cell_id <> h.cell_id WHERE
      (h.scope = 'rowgroup' AND c.row_group = h.row_group)
      OR (h.scope = 'row' AND h."row" < c."row" + c.row_span AND c."row" < h."row" + h.row_span AND h.col < c.col)
      OR (h.scope = 'col' AND h.col < c.col + c.col_span AND c.col < h.col + h.col_span AND h."row" < c."row")""")
def table_header_intervals(spark, sf_dir):
    return R.header_links(_cells(spark, sf_dir))


@query(f"""WITH {_CELLS}, s AS (SELECT table_id, unnest(range("row", "row" + row_span)) AS r, col AS c FROM c) SELECT table_id, CAST(r AS INT) AS r, c, count(*) AS n FROM s GROUP BY ALL HAVING count(*) > 1""")
def overlapping_cells(spark, sf_dir):
    return R.overlapping_cells(_cells(spark, sf_dir))


_TILES = """
    i AS (SELECT p_partkey AS id, 20 + p_size AS width, 15 + p_size // 2 AS height FROM part),
    g AS (SELECT *, least(32, width) AS tw, least(24, height) AS th FROM i),
    s AS (SELECT *, CAST(ceil(tw * 0.75) AS INT) AS sx, CAST(ceil(th * 0.75) AS INT) AS sy FROM g),
    n AS (SELECT *, CAST(1 + ceil((width - tw) / sx) AS INT) AS nx, CAST(1 + ceil((height - th) / sy) AS INT) AS ny FROM s),
    t AS (SELECT *, unnest(range(0, nx)) AS "column" FROM n), u AS (SELECT *, unnest(range(0, ny)) AS "row" FROM t)"""


@query(f"""WITH {_TILES} SELECT id, CAST("row" AS INT) AS "row", CAST("column" AS INT) AS "column", CAST("column" * sx AS INT) AS x, CAST("row" * sy AS INT) AS y, CAST(least(tw, width - "column" * sx) AS INT) AS width, CAST(least(th, height - "row" * sy) AS INT) AS height FROM u""")
def tile_regions(spark, sf_dir):
    images = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (20 + F.col("p_size")).alias("width"), (15 + F.floor(F.col("p_size") / 2)).cast("int").alias("height"))
    return G.tiles(images, 32, 24, overlap=0.25)


@query("""
    WITH i AS (SELECT p_partkey AS id, 20 + p_size AS w, 15 + p_size AS h, (p_size % 8) / 16.0::DOUBLE AS x, (p_size % 4) / 8.0::DOUBLE AS y, 0.25::DOUBLE AS rw, 0.5::DOUBLE AS rh FROM part)
    SELECT id, CAST(floor(x * w) AS INT) AS x, CAST(floor(y * h) AS INT) AS y, CAST(greatest(1, least(w, ceil(least(1.0, x + rw) * w)) - floor(x * w)) AS INT) AS width, CAST(greatest(1, least(h, ceil(least(1.0, y + rh) * h)) - floor(y * h)) AS INT) AS height FROM i""")
def region_normalize(spark, sf_dir):
    s = F.col("p_size")
    r = G.pixel_region(20 + s, 15 + s, (s % 8) / 16.0, (s % 4) / 8.0, F.lit(0.25), F.lit(0.5))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), r.alias("r")).select("id", "r.*")


def _boxes(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("page_id"), c("l_linenumber").alias("ord"), (c("l_partkey") % 50).cast("int").alias("x"), (c("l_suppkey") % 20).cast("int").alias("y"),
        (5 + c("l_quantity")).cast("int").alias("w"), (3 + c("l_linenumber")).cast("int").alias("h"),
    )


_BOXES = "b AS (SELECT l_orderkey AS page_id, l_linenumber AS ord, CAST(l_partkey % 50 AS INT) AS x, CAST(l_suppkey % 20 AS INT) AS y, CAST(5 + l_quantity AS INT) AS w, CAST(3 + l_linenumber AS INT) AS h FROM lineitem)"


@query(f"WITH {_BOXES} SELECT page_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM b GROUP BY page_id")
def bbox_union(spark, sf_dir):
    return G.union_bounds(_boxes(spark, sf_dir), "page_id")


@query(f"WITH {_BOXES} SELECT page_id, ord, CAST(row_number() OVER (PARTITION BY page_id ORDER BY y, x, ord) AS INT) AS place FROM b")
def reading_order(spark, sf_dir):
    return G.reading_order(_boxes(spark, sf_dir)).select("page_id", "ord", "place")


@query(f"WITH {_BOXES}, f AS (SELECT *, CASE WHEN x - lag(x + w) OVER (PARTITION BY page_id ORDER BY x, ord, w) > 4 THEN 1 ELSE 0 END AS far FROM b) SELECT page_id, ord, CAST(sum(far) OVER (PARTITION BY page_id ORDER BY x, ord, w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cell FROM f")
def x_gap_cells(spark, sf_dir):
    return G.x_gap_cells(_boxes(spark, sf_dir), "page_id", 4).select("page_id", "ord", "cell")


@query()
def row_clusters(spark, sf_dir):
    return G.row_clusters(_boxes(spark, sf_dir), 3.0)


@query()
def table_runs(spark, sf_dir):
    lines = G.row_clusters(_boxes(spark, sf_dir), 3.0)
    return G.table_runs(lines.select("page_id", "line", F.lit(0).alias("cell"), "x"))


@query("""
    WITH v AS (SELECT vec_id AS id, unnest(embedding) AS logit, unnest(range(0, len(embedding))) AS token FROM embeddings),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY logit DESC, token) AS rank FROM v QUALIFY rank <= 20),
    e AS (SELECT *, exp((CAST(logit AS DOUBLE) - max(CAST(logit AS DOUBLE)) OVER (PARTITION BY id)) / 0.2) AS e FROM k),
    s AS (SELECT *, sum(e) OVER (PARTITION BY id) AS al, coalesce(sum(e) OVER (PARTITION BY id ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e)
    SELECT id, CAST(token AS INT) AS token, CAST(rank AS INT) AS rank, round(e / al, 9) AS prob FROM s WHERE round(b / al, 12) < 0.7""")
def nucleus_topp(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("token", "logit")).withColumn("logit", F.col("logit").cast("double"))
    return G.nucleus(v, 0.7, 20, 0.2).withColumn("prob", F.round("prob", 9))
