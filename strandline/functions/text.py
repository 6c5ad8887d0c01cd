"""Strings of catalogues: names, years, keys and labels as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def path_year(path: Column) -> Column:
    """First (YYYY) or (YYYY-YYYY) of a path, as its first year."""
    return blank_null(F.regexp_extract(path, r"\((\d{4})(?:-\d{4})?\)", 1)).try_cast("int")


def date_token(name: Column) -> Column:
    return blank_null(F.regexp_extract(name, r"\d{8}", 0))


def int_year(value: Column) -> Column:
    """A year from mixed text such as '1984', '1984.0', '' or 'nan'."""
    v = value.cast("string").try_cast("double")
    return F.when(~F.isnan(v), v).try_cast("int")


def cache_key(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12)


def hover_line(layer: Column, year: Column, file: Column) -> Column:
    """'layer (year) — file name' of what there is of it."""
    name, when = F.trim(F.coalesce(layer.cast("string"), F.lit(""))), F.concat(F.lit("("), year.cast("string"), F.lit(")"))
    return F.concat_ws(" — ", blank_null(F.concat_ws(" ", blank_null(name), when)), blank_null(basename(file)))


def hover_text(overlaps: Column, lines: Column) -> Column:
    """What a map shows over a cell: how many sheets overlap there, then their lines."""
    return F.concat_ws("<br>", F.concat(F.lit("<b>Overlaps: "), overlaps.cast("string"), F.lit("</b>")), F.array_join(lines, "<br>"))


def area_label(m2: Column, km2_from: float = 1e6) -> Column:
    """Square kilometres from `km2_from` square metres on, square metres below."""
    return F.when(m2 >= km2_from, F.concat(F.format_number(m2 / 1e6, 2), F.lit(" km2"))).otherwise(F.concat(F.format_number(m2, 0), F.lit(" m2")))


def length_label(m: Column) -> Column:
    return F.when(m >= 1e3, F.concat(F.format_number(m / 1e3, 2), F.lit(" km"))).otherwise(F.concat(F.format_number(m, 0), F.lit(" m")))


def tile_url(base: str, path: Column, rescale: str = "0,3000") -> Column:
    return F.concat(F.lit(base + "?url="), F.url_encode(path), F.lit("&rescale=" + rescale))
