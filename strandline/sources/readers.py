"""Other inputs: GeoJSON bounds, annotations, band files, stored footprints; and sinks. KML is in `vectors`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as tx
from strandline.sources import vectors

RING = "array<struct<x:double,y:double>>"


def geojson_bounds(spark: SparkSession, path: str) -> DataFrame:
    """xmin, ymin, xmax, ymax of all polygons of a GeoJSON feature collection."""
    schema = "features array<struct<geometry:struct<coordinates:array<array<array<double>>>>>>"
    features = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features.geometry.coordinates").alias("c"))
    points = features.select(F.explode(F.flatten("c")).alias("p")).select(F.get("p", 0).alias("x"), F.get("p", 1).alias("y"))
    return points.agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """image, filename, region, ring: polygons of annotation files keyed by image."""
    return annotations(spark.read.text(path, wholetext=True))


def annotations(texts: DataFrame) -> DataFrame:
    """The same from texts (value), one for a file; those that aren't such JSON hold nothing."""
    shape = "struct<shape_attributes:struct<all_points_x:array<double>,all_points_y:array<double>>>"
    images = texts.select(F.from_json("value", f"map<string,struct<filename:string,regions:array<{shape}>>>").alias("m"))
    regions = images.select(F.explode("m").alias("image", "v")).select("image", "v.filename", F.posexplode("v.regions.shape_attributes").alias("region", "s"))
    ring = F.transform(F.arrays_zip("s.all_points_x", "s.all_points_y"), lambda p: F.struct(p["all_points_x"].alias("x"), p["all_points_y"].alias("y")))
    whole = (F.size("s.all_points_x") >= 3) & (F.size("s.all_points_x") == F.size("s.all_points_y"))
    return regions.where(whole).select("image", "filename", "region", ring.alias("ring"))


def objects_by_image(regions: DataFrame) -> DataFrame:
    """image, n_objects: polygons drawn on each image, and in a row without an image all of them."""
    return regions.rollup("image").agg(F.count(F.lit(1)).alias("n_objects"))


def band_sets(files: DataFrame, bands: dict[str, str], key: str = "B5") -> DataFrame:
    """A row for each scene with all its band files: path of the key band and of its siblings by name. files: path."""
    base = files.where(tx.basename(F.col("path")).contains(key)).select(F.col("path").alias(key))
    for name, token in bands.items():
        other = files.select(F.col("path").alias(name))
        base = base.join(other, F.replace(key, F.lit(key), F.lit(token)) == F.col(name))
    return base


def read_footprints(spark: SparkSession, path: str, epsg: int | None = None) -> DataFrame:
    """Stored footprints with stem and cog names; with a code, their rings are on that plane or datum and put on WGS84."""
    found = spark.read.parquet(path)
    if epsg is not None:
        found = vectors.on_wgs84(found, epsg)
    return found.withColumns({"stem": tx.stem(F.col("map_file")), "cog": F.concat(tx.stem(F.col("map_file")), F.lit(".tif"))})


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet, split by columns such as sensor and month; Spark's commit protocol makes it appear whole."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; nested columns become JSON."""
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode(mode).csv(path, header=True, escape='"')


def read_csv(spark: SparkSession, path: str, nested: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header; the named columns are JSON of the given types, as write_csv writes them. Text that isn't is NULL."""
    found = spark.read.csv(path, header=True, escape='"', multiLine=True)
    return found.withColumns({c: F.from_json(c, kind) for c, kind in (nested or {}).items()})


def products(scenes: DataFrame, bands: list[str] | None = None) -> DataFrame:
    """scene_id, product: available files of scenes that can be had in bulk (scene_id, bulk, secondary), only those whose
    name holds one of the bands if any are given; each once."""
    found = scenes.where("bulk").select("scene_id", F.explode("secondary").alias("s")).where("s.available").select("scene_id", F.col("s.name").alias("product"))
    if bands:
        found = found.where(F.exists(F.array(*[F.lit(b) for b in bands]), lambda b: F.contains("product", b)))
    return found.distinct()


def downloads(products: DataFrame, kind: str = "all", names: list[str] | None = None) -> DataFrame:
    """What to order of products (entity_id, product_id, bulk, system, secondary: array of struct<entity_id, product_id, display_id,
    bulk, groups>), each once. bundle: whole products that don't come as folders; band: secondary files whose display_id holds one of
    the names; all: both, secondary files of bulk products only; these give entity_id, product_id. band_group: entity_id, file_group of secondary files that have
    groups, only the named groups if any are named."""
    whole = products.where(F.col("bulk") & (F.col("system") != "folder")).select("entity_id", "product_id")
    files = products.select(F.col("bulk").alias("_bulk"), F.explode("secondary").alias("s")).where("s.bulk")
    if kind == "bundle":
        return whole.distinct()
    if kind == "band":
        wanted = F.exists(F.array(*[F.lit(n) for n in names or []]).cast("array<string>"), lambda n: F.contains("s.display_id", n))
        return files.where(wanted).select("s.entity_id", "s.product_id").distinct()
    if kind == "band_group":
        found = files.select("s.entity_id", F.explode("s.groups").alias("file_group"))
        return (found.where(F.col("file_group").isin(*[n.strip() for n in names])) if names else found).distinct()
    if kind == "all":
        return whole.unionByName(files.where("_bulk").select("s.entity_id", "s.product_id")).distinct()
    raise ValueError(f"kind is bundle, band, band_group or all, not {kind!r}")


def cached_table(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path, made by make() and written there if it isn't yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def not_done(work: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Items of work that a manifest doesn't list as done yet."""
    return work.join(manifest.where("status = 'ok'").select(key), key, "left_anti")
