"""What only shows on larger tables: plans that would send growing tables to the driver, keys beyond those of the small tables."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandline.operators import overlap, patches, subdivision
from strandline.plans import registry
from tests.checking import assert_same


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_interior_points_send_no_sides_to_the_driver(spark):
    sides = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 0.0), (1, 4.0, 0.0, 4.0, 4.0), (1, 4.0, 4.0, 0.0, 4.0), (1, 0.0, 4.0, 0.0, 0.0)], "face long, x1 double, y1 double, x2 double, y2 double")
    assert "Broadcast" not in plan_of(subdivision.interior_points(sides))


@pytest.mark.parametrize("name", ["sheet_names"])
def test_queries_equal_their_sql_at_large_keys(spark, tmp_path, name):
    n = 8
    keys = [0, 1, 999, 1000, 125000, 125001, 1199998, 1199999]
    part = {"p_partkey": pa.array(keys, pa.int64()), "p_name": ["a name"] * n, "p_brand": ["Brand#1", "Brand#2"] * 4, "p_type": ["SMALL"] * n, "p_size": pa.array([1, 7, 50, 49, 20, 21, 14, 30], pa.int32()), "p_retailprice": [900.0] * n}
    pq.write_table(pa.table(part), tmp_path / "part.parquet")
    assert_same(registry.queries()[name], registry.oracle_sql()[name], spark, str(tmp_path))


def test_repeated_and_nested_footprints_are_compared_once(spark):
    rows = [(k, f"l{k % 2}", f"f{k % 3}", 0.25, 0.25, 1.5 + k % 5 / 10, 1.5 + k % 5 / 10) for k in range(3000)] + [(3000, None, "f9", 3.0, 3.0, 4.0, 4.0), (3001, None, None, 5.0, 5.0, 6.0, 6.0)]
    boxes = spark.createDataFrame(rows, "id long, layer string, file string, xmin double, ymin double, xmax double, ymax double")
    kept = overlap.named_boxes(boxes, ["layer", "file"], 1.0)
    assert kept.where("gx < 3").count() == 4 * (2 + 3), "one box for each name and square"
    got = {(r.xmin, r.ymin, round(r.xmax, 9), r.overlap_count, tuple(r.layers), tuple(r.files)) for r in overlap.atomic_cells(boxes).collect()}
    inner = (0.25, 0.25, 1.5, 3000, ("l0", "l1"), ("f0", "f1", "f2"))
    assert inner in got and (3.0, 3.0, 4.0, 1, (), ("f9",)) in got and (5.0, 5.0, 6.0, 1, (), ()) in got and len(got) == 7


def test_regions_and_chains_send_nothing_growing_to_the_driver(spark, monkeypatch):
    from strandline.operators import cycles, graph, regions

    plans = []
    real = regions.stored

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    for module in (cycles, graph, regions):
        monkeypatch.setattr(module, "stored", seen)
    pixels = spark.createDataFrame([(r, c) for r in range(6) for c in range(6) if r != 2], "row long, col long")
    labels = regions.label_regions(pixels, tile=2)
    assert {r.label for r in labels.collect()} == {0, 3 << 31}
    plans.append(plan_of(labels))
    plans.append(plan_of(regions.area_perimeter(labels)))
    got = {r.node: (r.cycle, r["at"]) for r in cycles.cycles(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 7)], "node long, next long")).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 7: (7, 0)}
    assert not any("Broadcast" in p for p in plans)


def test_small_tables_of_long_formulas_are_dealt_over_tasks(spark, data_dir):
    from strandline.plans import views

    for rows in (views.map_text(spark, data_dir), views.turned_sheets(spark, data_dir)):
        assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_map_texts_are_read_once_and_after_they_are_dealt_out(spark, data_dir):
    plan = registry.queries()["map_parse_corners"](spark, data_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MMPXY,1") == 1 and plan.index("MMPXY,1") < plan.index("Repartition")


@pytest.mark.parametrize("size,times", [(3, 1), (5, 1), (3, 3), (17, 1)])
def test_opening_holds_rows_of_many_pixels_not_one_for_each_neighbour(spark, monkeypatch, size, times):
    rnd, half = random.Random(5), times * (size - 1) // 2
    mask = {(k, r, c) for k in (1, 2) for r in range(-9, 21) for c in range(-40, 70) if rnd.random() < 0.995}
    square = [(dr, dc) for dr in range(-half, half + 1) for dc in range(-half, half + 1)]
    eroded = {(k, r, c) for k, r, c in mask if all((k, r + dr, c + dc) in mask for dr, dc in square)}
    want = {(k, r + dr, c + dc) for k, r, c in eroded for dr, dc in square}
    by_pixels = patches.erode
    monkeypatch.setattr(patches, "erode", lambda *a: pytest.fail("goes by pixels"))
    rows = spark.createDataFrame(sorted(mask) + sorted(mask)[:50], "k int, row int, col long")
    got = patches.morph_open(rows, size, times, ("k",))
    assert got.dtypes == by_pixels(rows, size, times, ("k",)).dtypes
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_lakes_at_the_equator_equal_their_sql(spark, tmp_path):
    """Keys of a table 240 times sf0.1: the raster's latitudes go from one hemisphere to the other there."""
    rnd, line = random.Random(3), 64 * 223333
    rows = [(line + k, rnd.randrange(1, 8)) for k in range(-200, 260) for _ in range(4)]
    pq.write_table(pa.table({"l_orderkey": pa.array([k for k, _ in rows], pa.int64()), "l_linenumber": pa.array([n for _, n in rows], pa.int32())}), tmp_path / "lineitem.parquet")
    assert_same(registry.queries()["lake_metric_area"], registry.oracle_sql()["lake_metric_area"], spark, str(tmp_path))


def test_sides_are_put_on_the_plane_once(spark):
    from strandline.operators import regions

    sides = spark.createDataFrame([(1, 68.0, 67.0, 68.1, 67.0), (1, 68.1, 67.0, 68.0, 67.0)], "label long, x1 double, y1 double, x2 double, y2 double")
    plan = regions.measured(sides, ["label"], degrees=True)._jdf.queryExecution().optimizedPlan().toString().upper()
    assert plan.count("ATAN2(") == 2, "one for each end of a side"


@pytest.mark.parametrize("tile", [2, 3, 256])
def test_sides_within_tiles_and_across_them(spark, tile):
    from strandline.operators import regions

    rnd = random.Random(tile)
    pixels = {(k, n, r, c) for k in ("a", None) for n in (1, 2) for r in range(-4, 6) for c in range(-5, 4) if rnd.random() < 0.6}
    ends = (((0, 0), (0, 1), (-1, 0)), ((0, 1), (1, 1), (0, 1)), ((1, 1), (1, 0), (1, 0)), ((1, 0), (0, 0), (0, -1)))
    want = {(k, n, t, r + p[0], c + p[1], r + q[0], c + q[1]) for k, n, r, c in pixels for t, (p, q, d) in enumerate(ends) if (k, n, r + d[0], c + d[1]) not in pixels}
    rows = spark.createDataFrame(sorted(pixels, key=repr), "name string, n int, row long, col int")
    found = regions.sides(rows, ["name", "n"], tile)
    assert found.columns == ["name", "n", "turn", "r1", "c1", "r2", "c2"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert "SortMergeJoin" not in plan_of(found), "no row for each pixel's neighbours"
