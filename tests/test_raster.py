import json
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrazzo import queries
from terrazzo.functions.affine import Affine
from terrazzo.functions.encode import with_wkb
from terrazzo.functions.geometry import signed_area, wkb_size
from terrazzo.operators import grid, march
from terrazzo.operators.label import label_regions, region_stats
from terrazzo.operators.rings import cycles
from terrazzo.plans.isobands import isobands
from terrazzo.plans.polygonize import polygonize
from terrazzo.sources import synthetic
from terrazzo.sources.arrays import checked, pixels_of, tiles_of

SF = "/root/testdata/sf0.001"


def table(spark, rows, **more):
    a = np.array(rows, **more)
    return pixels_of(spark, *checked(a)), a.shape[1]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are absent")
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "part", "embeddings", "events"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.sql(queries.ORACLE_SQL[name]).df()[list(got.columns)]
    key = list(got.columns)
    got, want = (d.sort_values(key).reset_index(drop=True).astype(str) for d in (got.astype(object), want.astype(object)))
    assert len(got) == len(want) and (got.to_numpy() == want.to_numpy()).all()


def test_labels_across_tiles(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2, (20, 17)).astype(np.uint8)
    px = pixels_of(spark, *checked(a))
    for connectivity in (4, 8):
        whole = {(r.row, r.col): r.region_id for r in label_regions(px, 17, connectivity).collect()}
        tiled = {(r.row, r.col): r.region_id for r in label_regions(px, 17, connectivity, tile=5).collect()}
        assert whole == tiled == flood(a, connectivity)


def flood(a, connectivity):
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    out = {}
    for p in np.ndindex(a.shape):
        if p in out:
            continue
        todo, name = [p], p[0] * a.shape[1] + p[1]
        out[p] = name
        while todo:
            r, c = todo.pop()
            for dr, dc in steps:
                q = (r + dr, c + dc)
                if 0 <= q[0] < a.shape[0] and 0 <= q[1] < a.shape[1] and q not in out and a[q] == a[r, c]:
                    out[q] = name
                    todo.append(q)
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6), st.integers(1, 9), st.integers(1, 9), st.integers(1, 4), st.sampled_from([1.0, -1.0]))
def test_polygon_invariants(spark, seed, h, w, classes, flip):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, classes, (h, w)).astype(np.int16)
    mask = rng.random((h, w)) < 0.8
    found = polygonize(pixels_of(spark, a, mask), w, transform=(2.0, 0.0, 5.0, 0.0, 3.0 * flip, 7.0), tile=4)
    found = with_wkb(found).withColumn("size", wkb_size(F.col("rings"))).withColumn("areas", F.transform("rings", signed_area)).collect()
    assert abs(sum(r.area for r in found) - 6 * mask.sum()) < 1e-9
    for r in found:
        assert len(r.geometry) == r["size"] and r.areas[0] > 0 and all(x < 0 for x in r.areas[1:])
        assert abs(sum(r.areas) - r.area) < 1e-9
        assert all(ring[0] == ring[-1] and len(ring) >= 5 for ring in r.rings)


def test_simplified_polygons_keep_their_area(spark):
    px, w = table(spark, [[1, 1, 1], [1, 2, 1], [1, 1, 1]], dtype=np.uint8)
    found = {r.value: r for r in polygonize(px, w, simplify=True).collect()}
    assert [len(x) for x in found[1.0].rings] == [5, 5] and found[1.0].area == 8


def test_eight_connected_groups(spark):
    px, w = table(spark, [[1, 2], [2, 1]], dtype=np.uint8)
    found = polygonize(px, w, connectivity=8).collect()
    assert len(found) == 4 and len({r.group_id for r in found}) == 2


def test_tiles_and_masks(spark):
    a = np.arange(12, dtype=np.float32).reshape(3, 4)
    mask = a % 2 == 0
    got = grid.from_tiles(tiles_of(spark, a, mask, tile=2)).collect()
    assert {(r.row, r.col, r.value) for r in got} == {(r, c, float(a[r, c])) for r, c in zip(*np.nonzero(mask))}
    assert [r.value for r in grid.arithmetic_breaks(pixels_of(spark, a, mask), "value", 2.5).collect()] == [0.0, 2.5, 5.0, 7.5]
    with pytest.raises(TypeError):
        grid.pixels(spark.createDataFrame([("a",)], "v string"), F.lit(0), F.lit(0), F.col("v"))


def test_duplicate_pixels_are_refused(spark):
    px = spark.createDataFrame([("r", 0, 0, 1.0), ("r", 0, 0, 2.0)], "raster_id string, row int, col int, value double")
    with pytest.raises(Exception, match="same row and col"):
        label_regions(px, 1).collect()


def test_many_rasters_stay_apart(spark):
    px, w = table(spark, [[1, 1], [1, 2]], dtype=np.uint8)
    both = px.unionByName(px.withColumn("raster_id", F.lit("s")))
    found = region_stats(label_regions(both, w, tile=1)).collect()
    assert sorted((r.raster_id, r.n_pixels) for r in found) == [("r", 1), ("r", 3), ("s", 1), ("s", 3)]


def test_cycles():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 50):
        p = rng.permutation(n)
        rank = rng.permutation(n)
        start, step = cycles(p, rank)
        for i in range(n):
            ring, j = [i], p[i]
            while j != i:
                ring.append(j)
                j = p[j]
            first = min(ring, key=lambda k: rank[k])
            j, k = first, 0
            while j != i:
                j, k = p[j], k + 1
            assert (start[i], step[i]) == (first, k)


def test_isobands_of_hills(spark):
    found = isobands(synthetic.gaussian_hills(spark, 48, 40), 48, 40, [100.3, 300.3, 500.3]).collect()
    assert {r.value for r in found} == {100.3, 300.3} and all(r.area > 0 for r in found)
    turned = isobands(synthetic.gaussian_hills(spark, 48, 40), 48, 40, [100.3, 300.3, 500.3], transform=(1, 0, 0, 0, -1, 40)).collect()
    assert abs(sum(r.area for r in found) - sum(r.area for r in turned)) < 1e-9


@pytest.mark.parametrize("strict", [False, True])
def test_isobands_over_tiles(spark, strict):
    """Small tiles give what one tile gives, on two rasters with gaps, and strict bands fill what lies between their lines."""
    border = F.col("row").isin(0, 28) | F.col("col").isin(0, 36)  # low, as lines meet on a raster's edge
    whole = synthetic.random_floats(spark, 37, 29).withColumn("value", F.when(border, 0.0).otherwise(F.col("value")))
    gaps = whole.where(F.pmod(F.xxhash64("row", "col"), F.lit(19)) != 0).withColumn("raster_id", F.lit("q"))
    levels = [0.2, 0.5, 0.8]

    def found(tile):
        rows = isobands(whole.unionByName(gaps), 37, 29, levels, strict=strict, tile=tile).collect()
        return sorted((r.raster_id, r.feature_id, r.value, r.n_points, round(r.area, 9), tuple(tuple((p.x, p.y) for p in ring) for ring in r.rings)) for r in rows)

    one = found(64)
    assert found(5) == one and {r[0] for r in one} == {"r", "q"}
    cells = march.segments(march.codes(march.cells(whole, 37, 29, 8), levels))
    between = {r.threshold: -r.area for r in cells.groupBy("threshold").agg((F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("area")).collect()}
    if strict:
        for lo, hi in zip(levels, levels[1:]):
            assert abs(sum(r[4] for r in one if r[0] == "r" and r[2] == lo) - (between[lo] - between[hi])) < 1e-6


def test_array_segments_equal_column_segments(spark):
    rng = np.random.default_rng(5)
    grid = rng.integers(0, 6, (12, 15)) / 2.0
    px = spark.createDataFrame([("r", r, c, float(grid[r, c])) for r in range(12) for c in range(15) if (r, c) != (4, 7)], "raster_id string, row int, col int, value double")
    cells = march.cells(px, 15, 12, 6)
    want = {(r.threshold, r.row, r.col, r.k): (r.x0, r.y0, tuple(r.enters), tuple(r.leaves)) for r in march.segments(march.codes(cells, [0.5, 1.3, 2.0])).collect()}
    rows = cells.toPandas()
    columns = [rows[c].to_numpy() for c in ("row", "col", "tl", "tr", "br", "bl")]
    name = lambda k: (k % 2, (k // 2 >> 30) - 1, k // 2 % (1 << 30) - 1)
    got = {}
    for t in (0.5, 1.3, 2.0):
        for r, c, k, x, y, a, b in zip(*(v.tolist() for v in march.segments_of(*columns, t))):
            got[t, r, c, k] = (x, y, name(a), name(b))
    assert got == want and any(k for _, _, _, k in got)


def test_strict_bands_keep_pits(spark):
    a = np.zeros((9, 9))
    a[1:8, 1:8] = 9.0
    a[4, 4] = 3.0
    px = pixels_of(spark, *checked(a))
    assert len(isobands(px, 9, 9, [2.5, 6.5]).collect()) == 1
    assert len(isobands(px, 9, 9, [2.5, 6.5], strict=True).collect()) == 2


def test_geoparquet_footer(spark, tmp_path):
    from terrazzo.sources.geoparquet import GeoParquetSource

    spark.dataSource.register(GeoParquetSource)
    px, w = table(spark, [[1, 2], [1, 2]], dtype=np.uint8)
    out = with_wkb(polygonize(px, w)).select("geometry", "value").write.format("geoparquet").mode("overwrite")
    with pytest.raises(Exception, match="scheme"):
        out.save(str(tmp_path / "out"))
    for _ in range(2):  # the second run replaces the first one's files
        out.save(f"file://{tmp_path}/out")
    assert not [f for f in os.listdir(tmp_path / "out") if f.startswith(".part")]
    files = [f for f in os.listdir(tmp_path / "out") if f.startswith("part-")]
    meta = pq.read_schema(tmp_path / "out" / files[0]).metadata
    assert json.loads(meta[b"geo"])["primary_column"] == "geometry"
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_sql_function(spark):
    from terrazzo.functions.sql import register

    register(spark)
    px, w = table(spark, [[1]], dtype=np.uint8)
    polygonize(px, w).createOrReplaceTempView("polygons")
    assert spark.sql("SELECT octet_length(wkb_polygon(rings)) AS n FROM polygons").first().n == 93


def test_sql_tile_functions(spark):
    from terrazzo.functions.sql import register

    register(spark)
    rng = np.random.default_rng(8)
    classes, surface = rng.integers(0, 3, (9, 12)).astype(float), rng.random((9, 12))
    rows = []
    for name, grid_ in (("c", classes), ("s", surface)):
        data = grid_.reshape(-1).tolist()
        data[17] = None
        rows.append((name, data, 12))
    spark.createDataFrame(rows, "id string, data array<double>, w int").createOrReplaceTempView("some_tiles")
    px = {n: spark.createDataFrame([("r", k // 12, k % 12, v) for k, v in enumerate(d) if v is not None], "raster_id string, row int, col int, value double") for n, d, _ in rows}
    got = spark.sql("SELECT p.* FROM some_tiles t, LATERAL polygonize_tile(t.data, t.w, 0, 0) p WHERE t.id = 'c'").collect()
    want = with_wkb(polygonize(px["c"], 12)).collect()
    assert sorted((r.value, bytes(r.geometry)) for r in got) == sorted((r.value, bytes(r.geometry)) for r in want)
    got = spark.sql("SELECT p.* FROM some_tiles t, LATERAL isobands_tile(t.data, t.w, array(0.2D, 0.5D, 0.8D)) p WHERE t.id = 's'").collect()
    want = with_wkb(isobands(px["s"], 12, 9, [0.2, 0.5, 0.8])).collect()
    assert len(want) > 2 and sorted((r.value, bytes(r.geometry)) for r in got) == sorted((r.value, bytes(r.geometry)) for r in want)
    assert spark.sql("SELECT p.* FROM some_tiles t, LATERAL isobands_tile(t.data, t.w, array(0.2D)) p").count() == 0


def test_stream_of_tiles(spark, tmp_path):
    from terrazzo.streaming.tiles import polygonize_stream

    tiles = tiles_of(spark, np.array([[1, 1], [2, 2]], np.uint8), tile=1)
    tiles.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(tiles.schema).parquet(str(tmp_path / "in"))
    polygonize_stream(source, 2, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1.0, 2.0]


def test_affine():
    assert Affine().is_identity and Affine(2, 0, 0, 0, -3, 1).determinant == -6
