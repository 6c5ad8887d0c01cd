"""Map calibration files (.map): one file is one record of text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as tx

#: What stands in the datum field of a file that has none.
PLACEHOLDERS = ("map datum", "reserved 1", "reserved 2")
TITLE = r"scale:(\S+)\s+index:(\S+)\s+year:(\d{4})"
POINT = "struct<x:int,y:int,lat:double,lon:double>"
PARAMS = ("latitude_of_origin", "central_meridian", "scale_factor", "false_easting", "false_northing")


def read_map_files(spark: SparkSession, path: str) -> DataFrame:
    """map_file, text of every .map file below a folder; file names come decoded, undecodable bytes are dropped."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.map")
    return raw.select(F.url_decode(F.col("_metadata.file_path")).alias("map_file"), F.replace("value", F.lit("�"), F.lit("")).alias("text"))


def listed(files: DataFrame, most: int | None = None) -> DataFrame:
    """Files in the order of their paths, the first `most` if that is given."""
    found = files.orderBy("map_file")
    return found if most is None else found.limit(most)


def _fields(line: Column) -> Column:
    return F.transform(F.split(line, ","), lambda x: F.trim(x))


def _last(lines: Column, test) -> Column:
    return F.try_element_at(F.filter(lines, test), F.lit(-1))


def parse(files: DataFrame) -> DataFrame:
    """map_file, text and the record's fields. Of repeated lines the last counts; malformed ones are left out."""
    at = files.withColumn("lines", F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x)))
    lines = F.col("lines")
    datum = F.trim(F.get(F.split(F.get(lines, 4), ","), 0))
    title = _last(lines, lambda x: x.rlike(TITLE) & ~x.endswith(".gif"))
    field = lambda k: tx.blank_null(F.regexp_extract(F.coalesce(title, F.lit("")), TITLE, k))
    proj = _last(lines, lambda x: x.startswith("Map Projection"))
    setup = F.slice(_fields(_last(lines, lambda x: x.startswith("Projection Setup"))), 2, 5)
    number = F.transform(setup, lambda x: x.try_cast("double"))
    size = _fields(_last(lines, lambda x: x.startswith("IWH") & (F.size(F.split(x, ",")) == 4)))

    def point(x: Column) -> Column:
        f = _fields(x)
        whole = lambda k: F.get(f, k).try_cast("int")
        real = lambda k: F.get(f, k).try_cast("double")
        return F.struct(whole(2).alias("x"), whole(3).alias("y"), (real(6) + real(7) / 60).alias("lat"), (real(9) + real(10) / 60).alias("lon"))

    points = F.filter(F.transform(F.filter(lines, lambda x: x.rlike(r"^Point\d*,xy,")), point), lambda p: p["x"].isNotNull() & p["y"].isNotNull() & p["lat"].isNotNull() & p["lon"].isNotNull())

    def marks(tag: str, kind: str) -> Column:
        entry = lambda x: F.struct(F.get(_fields(x), 1).try_cast("int").alias("k"), F.get(_fields(x), 2).try_cast(kind).alias("a"), F.get(_fields(x), 3).try_cast(kind).alias("b"))
        return F.filter(F.transform(F.filter(lines, lambda x: x.startswith(tag + ",")), entry), lambda e: e["k"].isNotNull() & e["a"].isNotNull() & e["b"].isNotNull())

    xy, ll = F.col("xy"), F.col("ll")
    corner = lambda k: F.struct(F.try_element_at(F.filter(xy, lambda e: e["k"] == k), F.lit(-1))["a"].alias("x"), F.try_element_at(F.filter(xy, lambda e: e["k"] == k), F.lit(-1))["b"].alias("y"), F.try_element_at(F.filter(ll, lambda e: e["k"] == k), F.lit(-1))["b"].alias("lat"), F.try_element_at(F.filter(ll, lambda e: e["k"] == k), F.lit(-1))["a"].alias("lon"))
    keys = F.array_sort(F.array_union(F.transform(xy, lambda e: e["k"]), F.transform(ll, lambda e: e["k"])))
    made = at.withColumns({"xy": marks("MMPXY", "int"), "ll": marks("MMPLL", "double")})
    return made.select(
        "map_file",
        "text",
        _last(lines, lambda x: x.endswith(".gif")).alias("gif_file"),
        field(3).try_cast("int").alias("year"),
        field(1).alias("scale"),
        field(2).alias("index"),
        F.when(~F.lower(datum).isin(*PLACEHOLDERS), tx.blank_null(datum)).alias("datum"),
        tx.blank_null(F.get(_fields(proj), 1)).alias("projection"),
        F.when((F.size(number) > 0) & F.forall(number, lambda x: x.isNotNull()), F.struct(*[F.get(number, k).alias(n) for k, n in enumerate(PARAMS)])).alias("projection_params"),
        F.get(size, 2).try_cast("int").alias("image_width"),
        F.get(size, 3).try_cast("int").alias("image_height"),
        points.alias("control_points"),
        F.map_from_arrays(keys, F.transform(keys, corner)).alias("corners"),
    )


def fallback_fields() -> Column:
    """Struct s, i, d: scale, index and datum of a text, read line by line, later lines over earlier ones, until all are set."""
    lines = F.split("text", r"\r?\n")
    start = F.struct(F.lit(None).cast("string").alias("s"), F.lit(None).cast("string").alias("i"), F.lit(None).cast("string").alias("d"))
    #: fixed values: how a line states scale and index
    pair = r"scale:(\S+)\s+index:(\S+)"

    def step(acc: Column, x: Column) -> Column:
        done = acc["s"].isNotNull() & acc["i"].isNotNull() & acc["d"].isNotNull()
        s, i = tx.blank_null(F.regexp_extract(x, pair, 1)), tx.blank_null(F.regexp_extract(x, pair, 2))
        d = F.when(x.startswith("WGS") | x.contains("Pulkovo"), F.trim(F.get(F.split(x, ","), 0)))
        return F.when(done, acc).otherwise(F.struct(F.coalesce(s, acc["s"]).alias("s"), F.coalesce(i, acc["i"]).alias("i"), F.coalesce(d, acc["d"]).alias("d")))

    return F.aggregate(lines, start, step)


def fill_missing(sheets: DataFrame) -> DataFrame:
    """Missing year from the path; missing scale, index and datum from the text of the same row."""
    more = sheets.withColumn("_g", fallback_fields())
    named = {"scale": "_g.s", "index": "_g.i", "datum": "_g.d"}
    return more.withColumns({"year": F.coalesce("year", tx.path_year(F.col("map_file"))), **{c: F.coalesce(tx.blank_null(F.col(c)), g) for c, g in named.items()}}).drop("_g")


def resolve_images(sheets: DataFrame, listing: DataFrame) -> DataFrame:
    """Adds gif_path: the named image beside the .map file, by exact name or else by name without case. listing: path."""
    files = listing.select(F.col("path").alias("gif_path"), F.regexp_extract("path", "^(.*)/", 1).alias("dir"), F.lower(tx.basename(F.col("path"))).alias("low"))
    keyed = sheets.withColumns({"dir": F.regexp_extract("map_file", "^(.*)/", 1), "low": F.lower("gif_file")})
    exact = (tx.basename(F.col("gif_path")) != F.col("gif_file")).alias("other")
    best = keyed.select("map_file", "dir", "low", "gif_file").join(files, ["dir", "low"]).groupBy("map_file").agg(F.min(F.struct(exact, "gif_path")).alias("b")).select("map_file", "b.gif_path")
    return sheets.join(best, "map_file", "left")
