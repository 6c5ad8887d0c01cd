"""Training patches, morphology and scores on pixel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATCH, STEP = 256, 128


def patchify(pixels: DataFrame, height: int, width: int, patch: int = PATCH, step: int = STEP) -> DataFrame:
    """pixels with pi, pj (patch) and pr, pc (place in it), a row for each patch that holds the pixel. The image is
    first cut to whole multiples of the patch size."""
    rows, cols = height // patch * patch, width // patch * patch

    def span(at: str, size: int) -> Column:
        first = F.greatest(F.lit(0), F.ceil((F.col(at) - patch + 1) / step))
        last = F.least(F.floor(F.col(at) / step), F.lit((size - patch) // step))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    inside = pixels.where((F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < rows) & (F.col("col") < cols))
    both = inside.withColumn("pi", F.explode(span("row", rows))).withColumn("pj", F.explode(span("col", cols)))
    return both.withColumns({"pr": F.col("row") - F.col("pi") * step, "pc": F.col("col") - F.col("pj") * step})


def unpatchify(patches: DataFrame, value: str, keys: tuple[str, ...] = (), step: int = STEP) -> DataFrame:
    """row, col, value: where patches overlap, the later one (by pi, then pj) wins."""
    row, col = (F.col("pi") * step + F.col("pr")).alias("row"), (F.col("pj") * step + F.col("pc")).alias("col")
    return patches.groupBy(*keys, row, col).agg(F.max_by(value, F.struct("pi", "pj")).alias(value))


def useful(patches: DataFrame, value: str, least: float = 0.05, keys: tuple[str, ...] = ("pi", "pj")) -> DataFrame:
    """keys, share of the patches of which more than `least` is not background."""
    return patches.groupBy(*keys).agg(F.avg((F.col(value) != 0).cast("double")).alias("share")).where(F.col("share") > least)


def _around(size: int) -> Column:
    k = size // 2
    return F.explode(F.array(*[F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")) for dr in range(-k, k + 1) for dc in range(-k, k + 1)])).alias("to")


def dilate(mask: DataFrame, size: int = 3, times: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """Square of the given side, as many times as asked in one step (a square grows to a larger square)."""
    return mask.select(*keys, _around(1 + times * (size - 1))).select(*keys, "to.row", "to.col").distinct()


def erode(mask: DataFrame, size: int = 3, times: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pixels whose whole square is in the mask; outside the image counts as in it only if the mask says so."""
    side = 1 + times * (size - 1)
    pixels = mask.select(*keys, "row", "col").distinct()
    return pixels.select(*keys, _around(side)).select(*keys, "to.row", "to.col").groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == side * side).select(*keys, "row", "col")


WORD, HALO = 32, 16  # columns of a word of bits, and columns it holds of each of its neighbours


def _shifted(bits: Column, k: int) -> Column:
    return F.shiftleft(bits, k) if k >= 0 else F.shiftrightunsigned(bits, -k)


def morph_open(mask: DataFrame, size: int = 3, times: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """Eroded, then dilated, by the square; pixels may repeat. Pixels are first put into words of WORD columns of a row, so that tasks
    hold a row of many pixels, not a row for each pixel's neighbours: rows of pixels take few bytes in files and many in
    memory. What stays is part of the mask, so words that it has no pixel in need no look; squares wider than HALO go by pixels."""
    side = 1 + times * (size - 1)
    half = side // 2
    if side % 2 == 0 or 2 * half > HALO:
        return dilate(erode(mask, size, times, keys), size, times, keys)
    c, at = F.col, [*keys, "row", "word"]
    bit = F.expr(f"shiftleft(1L, cast(pmod(col, {WORD}) as int))")
    own = mask.where("row is not null and col is not null").groupBy(*keys, "row", F.floor(c("col") / WORD).alias("word")).agg(F.bit_or(bit).alias("bits"))
    dealt = F.explode(F.array(*[F.struct((c("word") + k).alias("word"), _shifted(c("bits"), HALO - k * WORD).alias("bits"), F.lit(k == 0).alias("own")) for k in (-1, 0, 1)])).alias("to")
    wide = own.select(*keys, "row", dealt).select(*keys, "row", "to.*").groupBy(*at).agg(F.bit_or("bits").alias("bits"), F.bool_or("own").alias("own")).where("own")
    across = range(-half, half + 1)
    every, some = c("bits"), c("bits")
    for k in across:
        every, some = every.bitwiseAND(_shifted(c("bits"), k)), some.bitwiseOR(_shifted(c("bits"), k))
    rows = F.explode(F.array(*[c("row") + k for k in across])).alias("row")
    eroded = wide.select(*keys, "word", rows, every.alias("bits")).groupBy(*at).agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("n")).where((c("n") == side) & (c("bits") != 0))
    grown = eroded.select(*keys, "word", rows, "bits").groupBy(*at).agg(F.bit_or("bits").alias("bits"))
    bits = grown.select(*keys, "row", "word", some.alias("bits"))
    place = F.explode(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("bits", i + HALO) == 1)).alias("i")
    return bits.select(*keys, "row", "word", place).select(*keys, "row", (c("word") * WORD + c("i")).cast(mask.schema["col"].dataType).alias("col"))


def mean_iou(pixels: DataFrame, truth: str, predicted: str, keys: tuple[str, ...] = ("image",), classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """keys, iou: intersection over union, averaged over classes that occur."""
    both = [F.count_if((F.col(truth) == k) & (F.col(predicted) == k)) for k in classes]
    either = [F.count_if((F.col(truth) == k) | (F.col(predicted) == k)) for k in classes]
    scores = pixels.groupBy(*keys).agg(F.array(*[F.try_divide(b.cast("double"), e.cast("double")) for b, e in zip(both, either, strict=True)]).alias("s"))
    seen = F.filter("s", lambda x: x.isNotNull())
    return scores.select(*keys, (F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / F.size(seen)).alias("iou"))


def mean_over_images(scores: DataFrame, iou: str = "iou") -> DataFrame:
    """One row: n_images, mean_iou over the images whose score is not 1, which are those without anything to find."""
    some = F.when(F.col(iou) != 1.0, F.col(iou))
    return scores.agg(F.count(some).alias("n_images"), F.avg(some).alias("mean_iou"))


def value_counts(patches: DataFrame, value: str, keys: tuple[str, ...] = ("pi", "pj")) -> DataFrame:
    """keys, value, n: how often each label stands in each patch."""
    return patches.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def paired(images: DataFrame, masks: DataFrame, name: str = "name") -> DataFrame:
    """Patches of images with the masks of the same name; those without a partner go. Other columns of masks get `mask_`."""
    return images.join(masks.select(name, *[F.col(c).alias(f"mask_{c}") for c in masks.columns if c != name]), name)


def unit_range(pixels: DataFrame, bands: list[str], keys: tuple[str, ...]) -> DataFrame:
    """Bands of images (keys) that reach over 1 divided by 255."""
    top = pixels.groupBy(*keys).agg(F.max(F.greatest(*bands) if len(bands) > 1 else F.col(bands[0])).alias("_top"))
    return pixels.join(top, list(keys)).withColumns({b: F.when(F.col("_top") > 1, F.col(b) / 255).otherwise(F.col(b)) for b in bands}).drop("_top")


def crop(pixels: DataFrame, row0: int, col0: int, row1: int, col1: int) -> DataFrame:
    """Pixels of rows row0 to row1 and columns col0 to col1, ends exclusive, numbered anew from 0."""
    inside = pixels.where((F.col("row") >= row0) & (F.col("row") < row1) & (F.col("col") >= col0) & (F.col("col") < col1))
    return inside.withColumns({"row": F.col("row") - row0, "col": F.col("col") - col0})


def hash_split(df: DataFrame, key: str, shares: dict[str, float]) -> DataFrame:
    """Adds split: rows go by the md5 of their key, the same way on every engine and run."""
    at = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0
    name, edge = F.lit(list(shares)[-1]), 0.0
    for k, (label, share) in enumerate(shares.items()):
        edge += share
        name = F.when(at < edge, label) if k == 0 else name.when(at < edge, label)
    return df.withColumn("split", name.otherwise(list(shares)[-1]))


def fill_polygon(rings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, col: pixels whose centre is inside a ring (array<struct<x, y>>), even-odd. Each row of pixels is cut
    by the ring's sides; the crossings, in order, open and close runs."""
    n = F.size("ring")
    side = F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(F.col("ring"), i).alias("p"), F.get(F.col("ring"), F.pmod(i + 1, n)).alias("q")))).alias("s")
    sides = rings.select(*keys, side).select(*keys, F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2")).where("y1 <> y2")
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.ceil(lo - 0.5), F.ceil(hi - 0.5) - 1
    rows = sides.withColumn("row", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    cross = F.col("x1") + (F.col("row") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    lines = rows.groupBy(*keys, "row").agg(F.sort_array(F.collect_list(cross)).alias("xs"))
    runs = F.explode(F.transform(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.get("xs", (2 * i).cast("int")).alias("a"), F.get("xs", (2 * i + 1).cast("int")).alias("b")))).alias("r")
    a, b = F.ceil(F.col("r.a") - 0.5), F.ceil(F.col("r.b") - 0.5) - 1
    return lines.where("size(xs) >= 2").select(*keys, "row", runs).select(*keys, "row", F.explode(F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))).alias("col")).distinct()
