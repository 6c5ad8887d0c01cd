"""The driver tables seen as scenes, footprints, masks and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over as many tasks as a shuffle has. Tables of few bytes are read by few tasks, however many rows they hold, so
    long formulas on each row come after this."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def scene_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of seven scenes on a raster of eight columns whose rows grow with the orders."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_linenumber").cast("long").alias("scene"), F.floor(c("l_orderkey") / 48).alias("row"), (c("l_partkey") % 8).alias("col"), F.round(c("l_discount") * 100).cast("int").alias("qa"), c("l_tax").alias("green"), (c("l_quantity") / 1000).alias("swir"), (c("l_extendedprice") / 1999993).alias("nir")
    )


SCENE_PX = "scene_px AS (SELECT l_linenumber::BIGINT AS scene, l_orderkey // 48 AS row, l_partkey % 8 AS col, round(l_discount * 100)::INT AS qa, l_tax AS green, l_quantity / 1000 AS swir, l_extendedprice / 1999993 AS nir FROM lineitem)"


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    x, y, d = (64 + c("p_partkey") % 26).cast("double"), (63 + c("p_partkey") % 11).cast("double"), c("p_size") / 25
    return table(spark, sf_dir, "part").select(
        c("p_partkey").alias("id"), x.alias("xmin"), y.alias("ymin"), (x + d).alias("xmax"), (y + d).alias("ymax"), F.when(c("p_size") % 7 != 0, 1950 + c("p_size")).alias("year"), c("p_brand").alias("layer"), c("p_name").alias("file"), c("p_type").alias("type"),
        F.when(c("p_partkey") % 16 == 0, "WGS 84").when(c("p_partkey") % 16 == 1, "EPSG:4326").when(c("p_partkey") % 16 == 2, F.lit("local grid")).when(c("p_partkey") % 16 > 3, " Pulkovo 1942").alias("datum"),
    )


FOOTPRINT = """footprint AS (SELECT p_partkey AS id, (64 + p_partkey % 26)::DOUBLE AS xmin, (63 + p_partkey % 11)::DOUBLE AS ymin, (64 + p_partkey % 26)::DOUBLE + p_size / 25 AS xmax, (63 + p_partkey % 11)::DOUBLE + p_size / 25 AS ymax,
  CASE WHEN p_size % 7 <> 0 THEN 1950 + p_size END AS year, p_brand AS layer, p_name AS file, p_type AS type, CASE WHEN p_partkey % 16 = 0 THEN 'WGS 84' WHEN p_partkey % 16 = 1 THEN 'EPSG:4326' WHEN p_partkey % 16 = 2 THEN 'local grid' WHEN p_partkey % 16 > 3 THEN ' Pulkovo 1942' END AS datum FROM part)"""


#: Height and width of an image of `mask`.
IMAGE = (16, 24)


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of `mask`, as often as they are touched."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("image"), (c("l_orderkey") % IMAGE[0]).alias("row"), (c("l_partkey") % IMAGE[1]).alias("col"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, row, col: an image for each supplier, with the pixels that the supplier's lines touch."""
    return touched(spark, sf_dir).distinct()


MASK = f"dense AS (SELECT DISTINCT l_suppkey AS image, l_orderkey % {IMAGE[0]} AS row, l_partkey % {IMAGE[1]} AS col FROM lineitem)"


def wide_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse mask on a raster that grows with the data: a strip of 96 columns for each line number, with four free ones
    between strips; about one pixel in six of the first strip is set, less in later ones."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.floor(key / 64).alias("row"), ((key * 7 + line * 3) % 96 + line * 100).alias("col")).distinct()


WIDE_MASK = "wide_mask AS (SELECT DISTINCT l_orderkey // 64 AS row, (l_orderkey * 7 + l_linenumber * 3) % 96 + l_linenumber * 100 AS col FROM lineitem)"


def acquisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene_id"), F.to_date("o_orderdate").alias("dt"), (F.col("o_totalprice") % 100).alias("cloud"))


ACQUISITIONS = "acquisitions AS (SELECT o_orderkey AS scene_id, o_orderdate::DATE AS dt, o_totalprice % 100 AS cloud FROM orders)"


def map_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibration file for each part."""
    c, k = F.col, F.col("p_partkey")
    n = lambda x: x.cast("string")
    year = F.when(c("p_size") % 5 != 0, F.concat(F.lit("scale:"), n(c("p_size") * 1000), F.lit(" index:P-"), n(k % 60), F.lit(" year:"), n(1900 + c("p_size"))))
    datum = F.when(k % 3 == 0, F.lit("Pulkovo 1942,WGS 84,0,0,WGS")).when(k % 3 == 1, F.lit("WGS 84,,0,0,x")).otherwise(F.lit("Map Datum,reserved,0"))
    deg = lambda v, m: F.concat(n(v), F.lit(","), n(m))
    lines = [
        F.lit("OziExplorer Map Data File"), F.lit("title"), F.concat(F.lit("sheet"), n(k), F.lit(".gif")), F.lit("1 ,Map Code,"), datum, F.coalesce(year, F.lit("no title")), F.lit("Map Projection, Transverse Mercator ,PolyCal,No"),
        F.when(k % 4 == 0, F.lit("Projection Setup,0,bad,1,0,0")).otherwise(F.concat(F.lit("Projection Setup,0,"), n(3 * (k % 60)), F.lit(",1.0,500000,0,,"))), F.concat(F.lit("IWH,Map Image Width/Height,"), n(1000 + k % 100), F.lit(","), n(2000 + k % 100)),
        F.concat(F.lit("Point01,xy,"), n(k % 500), F.lit(","), n(k % 400), F.lit(",in,deg,"), deg(60 + k % 10, k % 60), F.lit(",N,"), deg(64 + k % 26, k % 50), F.lit(",E")), F.lit("Point02,xy,,,in,deg,,,N,,,E"),
        F.concat(F.lit("MMPXY,1,10,20\nMMPXY,2,910,20\nMMPXY,3,910,820\nMMPLL,1,"), n(64 + k % 26), F.lit(","), n(63 + k % 11), F.lit("\nMMPLL,2,"), n(65 + k % 26), F.lit(","), n(63 + k % 11), F.lit("\nMMPLL,3,"), n(65 + k % 26), F.lit(","), n(64 + k % 11)),
        F.concat(F.lit("Pulkovo text,"), n(k)), F.concat(F.lit("scale:"), n(c("p_size")), F.lit(" index:Q-"), n(k % 7)),
    ]
    name = F.concat(F.lit("/maps/set ("), n(1950 + k % 40), F.when(k % 2 == 0, F.concat(F.lit("-"), n(1990 + k % 9))).otherwise(""), F.lit(")/sheet"), n(k), F.lit(".map"))
    return spread(table(spark, sf_dir, "part")).select(name.alias("map_file"), F.concat_ws("\n", *lines).alias("text"))


#: The fields that map_text writes, straight from the parts.
SHEETS = """sheets AS (SELECT p_partkey AS k, '/maps/set (' || (1950 + p_partkey % 40) || CASE WHEN p_partkey % 2 = 0 THEN '-' || (1990 + p_partkey % 9) ELSE '' END || ')/sheet' || p_partkey || '.map' AS map_file,
  CASE p_partkey % 3 WHEN 0 THEN 'Pulkovo 1942' WHEN 1 THEN 'WGS 84' END AS datum, CASE WHEN p_size % 5 <> 0 THEN (1900 + p_size)::INT END AS year, CASE WHEN p_size % 5 <> 0 THEN (p_size * 1000)::VARCHAR END AS scale,
  CASE WHEN p_size % 5 <> 0 THEN 'P-' || (p_partkey % 60) END AS idx, p_size, (1950 + p_partkey % 40)::INT AS path_year FROM part)"""


def turned_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turned sheet for each part on a field that grows with their number, so that each overlaps a few others; every fourth is L-shaped."""
    k, w, h, o = F.col("p_partkey"), 0.3 + F.col("p_size") / 100, F.lit(0.4), F.lit(0.0)
    corners = lambda *of: F.array(*[F.struct(x.alias("a"), y.alias("b")) for x, y in of])
    local = F.when(k % 4 != 0, corners((-w, -h), (w, -h), (w, h), (-w, h))).otherwise(corners((-w, -h), (w, -h), (w, o), (o, o), (o, h), (-w, h)))
    rows = spread(table(spark, sf_dir, "part")).select(k.alias("id"), F.col("p_brand").alias("layer"), F.col("p_name").alias("file"), local.alias("local"), F.radians((k * 37 % 360).cast("double")).alias("t"), (k % 50 * 0.9).alias("cx"), (F.floor(k / 50) * 0.8).alias("cy"))
    point = lambda p: F.struct(F.round(F.col("cx") + F.cos("t") * p["a"] - F.sin("t") * p["b"], 7).alias("x"), F.round(F.col("cy") + F.sin("t") * p["a"] + F.cos("t") * p["b"], 7).alias("y"))
    rows = rows.withColumn("open", F.transform("local", point))
    return rows.select("id", "layer", "file", F.concat("open", F.slice("open", 1, 1)).alias("ring"))


#: sheet: the same sheets' frames; piece: their rectangles, two for an L; corner, side: those of the pieces, counter-clockwise.
TURNED = """sheet AS (SELECT p_partkey AS k, 0.3::DOUBLE + p_size / 100 AS w, radians((p_partkey * 37 % 360)::DOUBLE) AS t, p_partkey % 50 * 0.9::DOUBLE AS cx, p_partkey // 50 * 0.8::DOUBLE AS cy FROM part),
piece AS (SELECT *, 0 AS n, -w AS a0, w AS a1, -0.4::DOUBLE AS b0, CASE WHEN k % 4 = 0 THEN 0.0::DOUBLE ELSE 0.4::DOUBLE END AS b1 FROM sheet UNION ALL SELECT *, 1, -w, 0.0::DOUBLE, 0.0::DOUBLE, 0.4::DOUBLE FROM sheet WHERE k % 4 = 0),
corner AS (SELECT k, n, i, cx, cy, round(cx + cos(t) * a - sin(t) * b, 7) AS x, round(cy + sin(t) * a + cos(t) * b, 7) AS y FROM (SELECT *, unnest([0, 1, 2, 3]) AS i, unnest([a0, a1, a1, a0]) AS a, unnest([b0, b0, b1, b1]) AS b FROM piece)),
side AS (SELECT p.k, p.n, p.i, p.cx, p.cy, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM corner p JOIN corner q ON p.k = q.k AND p.n = q.n AND q.i = (p.i + 1) % 4)"""


def crossed_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quad for each supplier whose corners come in an order that crosses itself; every third in the right order."""
    k = F.col("s_suppkey")
    w, h, d = 1 + k % 7, 1 + k % 5, (k % 4).cast("double") / 8
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    a, b, c, e = p(d, d * 0), p(w + d * 0, d), p(w - d, h + d * 0), p(d * 0, h - d)
    ring = F.when(k % 3 == 0, F.array(a, b, c, e, a)).when(k % 3 == 1, F.array(a, c, b, e, a)).otherwise(F.array(a, b, e, c, a))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), ring.alias("ring"))


CROSSED = """quad AS (SELECT s_suppkey AS k, (1 + s_suppkey % 7)::DOUBLE AS w, (1 + s_suppkey % 5)::DOUBLE AS h, (s_suppkey % 4) / 8.0::DOUBLE AS d FROM supplier),
ends AS (SELECT k, d AS a_x, 0.0::DOUBLE AS a_y, w AS b_x, d AS b_y, w - d AS c_x, h AS c_y, 0.0::DOUBLE AS e_x, h - d AS e_y FROM quad),
ordered AS (SELECT k, a_x AS x0, a_y AS y0, CASE WHEN k % 3 = 1 THEN c_x ELSE b_x END AS x1, CASE WHEN k % 3 = 1 THEN c_y ELSE b_y END AS y1,
  CASE k % 3 WHEN 0 THEN c_x WHEN 1 THEN b_x ELSE e_x END AS x2, CASE k % 3 WHEN 0 THEN c_y WHEN 1 THEN b_y ELSE e_y END AS y2, CASE WHEN k % 3 = 2 THEN c_x ELSE e_x END AS x3, CASE WHEN k % 3 = 2 THEN c_y ELSE e_y END AS y3 FROM ends)"""


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, at, x, y: for each customer the running total of orders by date; curves are far apart."""
    from pyspark.sql import Window

    c, along = F.col, Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day, total = F.datediff(c("o_orderdate"), F.lit("1990-01-01")).cast("double"), F.sum(F.floor("o_totalprice") % 1000).over(along)
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.row_number().over(along).cast("long").alias("at"), day.alias("x"), total.alias("t"))
    return rows.select(c("o_custkey").alias("line"), "at", (c("x") + c("at") / 64).alias("x"), (c("t") + c("o_custkey") * 1000000).cast("double").alias("y"))


CURVES = """pt AS (SELECT o_custkey AS line, row_number() OVER w AS pos, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + row_number() OVER w / 64.0::DOUBLE AS x, (sum((floor(o_totalprice)::BIGINT) % 1000) OVER w + o_custkey * 1000000)::DOUBLE AS y
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))"""
