"""The registered raster queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.affine import Affine
from .functions.encode import feature_json, geojson, with_wkb
from .functions.geometry import bounds, in_bounds, net_area, n_points, normalized, point_in_ring, signed_area, wkb_size
from .operators import grid, march
from .operators.label import label_regions, region_holes, region_stats
from .operators.rings import boundary_edges
from .plans.isobands import isobands
from .plans.polygonize import class_area, class_area_delta, polygonize
from .sources import tables

#: Ten units a pixel, y upwards.
TRANSFORM = (10.0, 0.0, 100.0, 0.0, -10.0, 200.0)
#: Off the samples, which have two decimals.
THRESHOLDS = [10.005, 30.005, 60.005, 120.005]
BREAKS = [-0.2, -0.1, 0.0, 0.1, 0.2]
SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]

R1 = tables.order_priorities
W1 = tables.ORDERS


def q01_pixels_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R1(spark, sf_dir).select("row", "col", "value")


def q02_nodata_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.part_sizes(spark, sf_dir, nodata=4, mask=F.col("p_partkey") % 7 != 0)
    return found.groupBy("value").agg(F.count("*").alias("n"), F.sum(F.col("row").cast("long")).alias("rows"), F.sum(F.col("col").cast("long")).alias("cols"))


def q03_digitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.vector_elements(spark, sf_dir)
    band = grid.clipped(grid.digitize(F.col("value"), BREAKS), 0, len(BREAKS) - 2).cast("int")
    return found.select("row", "col", band.alias("band"))


def q04_quantile_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.quantile_breaks(tables.vector_elements(spark, sf_dir), "value", SHARES).select("break_idx", F.round("value", 6).alias("value"))


def q05_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.runs(R1(spark, sf_dir)).select("row", "col0", "col1", "value", "n_pixels")


def q06_label4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_regions(R1(spark, sf_dir), W1, 4).select("row", "col", "region_id")


def q07_label8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_regions(tables.part_sizes(spark, sf_dir), tables.PARTS, 8).select("row", "col", "region_id")


def q08_region_area_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = F.col("n_pixels") * abs(Affine(*TRANSFORM).determinant)
    return region_stats(label_regions(R1(spark, sf_dir), W1)).select("region_id", "value", area.alias("area"), "first_row", "first_col")


def q09_boundary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary_edges(label_regions(R1(spark, sf_dir), W1)).select("region_id", "x0", "y0", "x1", "y1", "dir")


def q10_region_perimeter_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = label_regions(R1(spark, sf_dir), W1)
    return region_stats(labels).join(region_holes(labels), ["raster_id", "region_id"]).select("region_id", "perimeter", "n_holes")


def _polygons(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    return polygonize(R1(spark, sf_dir), W1, **more)


def _summary(features: DataFrame) -> DataFrame:
    return features.select("region_id", "value", F.size("rings").alias("n_rings"), n_points(F.col("rings")).alias("n_points"), net_area(F.col("rings")).alias("area"))


def q11_polygon_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(_polygons(spark, sf_dir))


def q12_polygon_wkb_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_wkb(_polygons(spark, sf_dir))
    return found.select("region_id", F.octet_length("geometry").cast("long").alias("bytes"), (wkb_size(F.col("rings")) == F.octet_length("geometry")).alias("as_counted"))


def q13_polygon_wkb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_wkb(_polygons(spark, sf_dir, transform=TRANSFORM)).select("region_id", F.hex("geometry").alias("geometry"), "value")


def q14_polygon_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _polygons(spark, sf_dir, transform=TRANSFORM).select("region_id", geojson(F.col("rings")).alias("geometry"), "value")


def q15_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _polygons(spark, sf_dir).select("region_id", feature_json(F.col("rings"), value=F.col("value"), area=F.col("area")).alias("feature"))


def q16_transform_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _polygons(spark, sf_dir, transform=TRANSFORM).select("region_id", normalized(F.col("rings")).alias("rings"))
    outer = F.element_at("rings", 1)
    return found.select("region_id", bounds(outer).alias("b"), (signed_area(outer) > 0).alias("ccw")).select("region_id", "b.*", "ccw")


def q17_threshold_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands between the sizes of parts; brands of five give thresholds that are not finite."""
    odd = F.when(F.col("p_partkey") % 5 == 0, float("nan")).when(F.col("p_partkey") % 7 == 0, float("inf"))
    return grid.band_table(tables.read(spark, sf_dir, "part").select(F.coalesce(odd, F.col("p_size").cast("double")).alias("size")), "size")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.event_values(spark, sf_dir)
    height = (found.agg(F.max("row")).first()[0] or 0) + 1
    return march.cells(found, tables.EVENTS, height)


def q18_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = [F.when(F.col(k) == -float("inf"), F.lit(-1.0)).otherwise(F.col(k)).alias(k) for k in ("tl", "tr", "br", "bl")]
    return _cells(spark, sf_dir).select("row", "col", *finite)


def q19_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return march.codes(_cells(spark, sf_dir), THRESHOLDS).groupBy("threshold", "code").agg(F.count("*").alias("n"), F.sum(F.col("row").cast("long")).alias("rows"), F.sum(F.col("col").cast("long")).alias("cols"))


def q20_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = march.segments(march.codes(_cells(spark, sf_dir), THRESHOLDS))
    return found.select("threshold", "row", "col", "k", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


def q21_isoline_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = march.segments(march.codes(_cells(spark, sf_dir), THRESHOLDS))
    area = F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) * 0.5
    return found.groupBy("threshold").agg(F.round(area, 3).alias("area"), F.count("*").alias("n"))


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.event_values(spark, sf_dir)
    height = (found.agg(F.max("row")).first()[0] or 0) + 1
    return isobands(found, tables.EVENTS, height, THRESHOLDS)


def q22_isoband_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bands(spark, sf_dir).groupBy("value").agg(F.count("*").alias("n"), F.sum(F.col("n_rings").cast("long")).alias("n_rings"), F.sum("n_points").alias("n_points"), F.round(F.sum("area"), 6).alias("area"))


def q23_isobands_wkb(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_wkb(_bands(spark, sf_dir))
    outer, points = F.element_at("rings", 1), F.flatten("rings")

    def total(k: str):
        return F.round(F.aggregate(points, F.lit(0.0), lambda s, p: s + p[k]), 4)

    first = F.element_at(outer, 1)
    return found.select("feature_id", "value", F.octet_length("geometry").cast("long").alias("bytes"), F.round(first["x"], 6).alias("x"), F.round(first["y"], 6).alias("y"), total("x").alias("sum_x"), total("y").alias("sum_y"))


def q24_tiled_then_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(_polygons(spark, sf_dir, tile=32))


def q25_class_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_area(_polygons(spark, sf_dir))


def q26_class_area_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    raster = R1(spark, sf_dir).where("value <> 5")
    return class_area_delta(polygonize(R1(spark, sf_dir), W1), polygonize(raster, W1))


def q27_class_mask_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(polygonize(R1(spark, sf_dir).where("value = 1"), W1)).drop("value")


def q28_point_in_bbox_and_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each polygon, whether its first pixel's centre and that of the pixel left of it lie in its exterior."""
    outer = F.element_at("rings", 1)
    x, y = F.col("region_id") % W1 + 0.5, F.floor(F.col("region_id") / W1) + 0.5
    return _polygons(spark, sf_dir).select("region_id", point_in_ring(x, y, outer).alias("own"), point_in_ring(x - 1, y, outer).alias("left"), in_bounds(x - 1, y, bounds(outer)).alias("left_in_box"))


def q29_top_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _polygons(spark, sf_dir).orderBy(F.desc("area"), "region_id").limit(20).select("region_id", "value", "area")


def q30_arithmetic_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.arithmetic_breaks(tables.event_values(spark, sf_dir), "value", 7.5)


def q31_tile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of a table of tiles: each order's row of 128 pixels is cut into tiles of 16, some of which have a mask."""
    rows = R1(spark, sf_dir).withColumn("c0", F.floor(F.col("col") / 16).cast("int") * 16)
    grouped = rows.groupBy("raster_id", F.col("row").alias("r0"), "c0").agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("p"))
    at = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.get(F.filter("p", lambda p: p["col"] == F.col("c0") + k), 0)["value"])
    mask = F.when(F.col("r0") % 3 == 0, F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: (k % 5) != 0))
    tiles = grouped.select("raster_id", "r0", "c0", F.lit(1).alias("h"), F.lit(16).alias("w"), at.alias("data"), mask.alias("mask"))
    return _summary(polygonize(grid.from_tiles(tiles), W1))


def q32_quantized_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by threshold whose ends fall on one place in steps of 1e-10, and the largest step there is."""
    found = march.segments(march.codes(_cells(spark, sf_dir), THRESHOLDS))
    same = (march.quantized(F.col("x0")) == march.quantized(F.col("x1"))) & (march.quantized(F.col("y0")) == march.quantized(F.col("y1")))
    return found.groupBy("threshold").agg(F.count_if(same).alias("n_points"), F.max(march.quantized(F.col("y0")) % 10_000_000_000).alias("largest"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, f in list(globals().items()) if name[0] == "q" and name[1:3].isdigit()}

_PX = f"""px AS (SELECT o_orderkey // {W1} AS "row", o_orderkey % {W1} AS col, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS value, o_orderkey AS pos FROM orders)"""
_PX2 = """px AS (SELECT p_partkey // 16 AS "row", p_partkey % 16 AS col, CAST((p_size - 1) // 10 AS DOUBLE) AS value, p_partkey AS pos FROM part)"""


def _labels(px: str, steps: str) -> str:
    return f"""
    {px},
    adj AS (SELECT a.pos AS a, b.pos AS b FROM px a JOIN px b ON a.value = b.value AND ({steps})),
    both_ AS (SELECT a, b FROM adj UNION ALL SELECT b, a FROM adj),
    cc(id, lbl) USING KEY (id) AS (
      SELECT pos, pos FROM px
      UNION
      SELECT r.id, min(cc.lbl) FROM cc JOIN both_ e ON e.b = cc.id JOIN recurring.cc r ON r.id = e.a WHERE cc.lbl < r.lbl GROUP BY r.id
    ),
    labels AS (SELECT px.*, cc.lbl AS region_id FROM px JOIN cc ON cc.id = px.pos)"""


_FOUR = 'b."row" = a."row" AND b.col = a.col + 1 OR b.col = a.col AND b."row" = a."row" + 1'
_EIGHT = f'{_FOUR} OR b."row" = a."row" + 1 AND abs(b.col - a.col) = 1'
_L4 = "WITH RECURSIVE " + _labels(_PX, _FOUR)
_EDGES = """,
    sides AS (
      SELECT l.*, d.d FROM labels l, (VALUES (0, -1, 0), (1, 0, 1), (2, 1, 0), (3, 0, -1)) d(d, dr, dc)
      LEFT JOIN labels n ON n."row" = l."row" + d.dr AND n.col = l.col + d.dc AND n.region_id = l.region_id
      WHERE n.pos IS NULL),
    edges AS (
      SELECT region_id, value, pos,
        CASE d WHEN 0 THEN col WHEN 1 THEN col + 1 WHEN 2 THEN col + 1 ELSE col END AS x0,
        CASE d WHEN 0 THEN "row" WHEN 1 THEN "row" WHEN 2 THEN "row" + 1 ELSE "row" + 1 END AS y0,
        CASE d WHEN 0 THEN col + 1 WHEN 1 THEN col + 1 WHEN 2 THEN col ELSE col END AS x1,
        CASE d WHEN 0 THEN "row" WHEN 1 THEN "row" + 1 WHEN 2 THEN "row" + 1 ELSE "row" END AS y1, d AS dir
      FROM sides)"""
_STATS = _EDGES + """,
    per AS (SELECT region_id, count(*) AS perimeter FROM edges GROUP BY 1),
    size_ AS (SELECT region_id, any_value(value) AS value, count(*) AS n_pixels FROM labels GROUP BY 1),
    quads AS (
      SELECT region_id, "row" + dr AS y, col + dc AS x, sum(bit) AS code
      FROM labels, (VALUES (0, 0, 1), (0, 1, 2), (1, 0, 4), (1, 1, 8)) q(dr, dc, bit) GROUP BY ALL),
    holes AS (
      SELECT region_id, CAST(1 - (count(*) FILTER (code IN (1, 2, 4, 8)) - count(*) FILTER (code IN (7, 11, 13, 14)) + 2 * count(*) FILTER (code IN (6, 9))) / 4 AS BIGINT) AS n_holes
      FROM quads GROUP BY 1),
    stats AS (SELECT * FROM size_ JOIN per USING (region_id) JOIN holes USING (region_id))"""


def _summary_sql(labels: str) -> str:
    return f"{labels}{_STATS} SELECT region_id, value, CAST(n_holes + 1 AS INT) AS n_rings, perimeter + n_holes + 1 AS n_points, CAST(n_pixels AS DOUBLE) AS area FROM stats"


_R4 = """r4 AS (SELECT event_id // 50 AS "row", event_id % 50 AS col, CAST(value AS DOUBLE) AS value FROM events),
    size4 AS (SELECT max("row") + 1 AS h FROM r4),
    corners AS (
      SELECT y AS "row", x AS col,
        CASE WHEN y < 0 OR x < 0 THEN '-inf'::DOUBLE ELSE a.value END AS tl,
        CASE WHEN y < 0 OR x + 1 >= 50 THEN '-inf'::DOUBLE ELSE b.value END AS tr,
        CASE WHEN y + 1 >= h OR x + 1 >= 50 THEN '-inf'::DOUBLE ELSE c.value END AS br,
        CASE WHEN y + 1 >= h OR x < 0 THEN '-inf'::DOUBLE ELSE d.value END AS bl
      FROM size4, LATERAL (SELECT unnest(range(-1, h)) AS y) ys, (SELECT unnest(range(-1, 50)) AS x) xs
      LEFT JOIN r4 a ON a."row" = y AND a.col = x LEFT JOIN r4 b ON b."row" = y AND b.col = x + 1
      LEFT JOIN r4 c ON c."row" = y + 1 AND c.col = x + 1 LEFT JOIN r4 d ON d."row" = y + 1 AND d.col = x),
    cells AS (SELECT * FROM corners WHERE tl IS NOT NULL AND tr IS NOT NULL AND br IS NOT NULL AND bl IS NOT NULL)"""
_T = ", ".join(f"({t})" for t in THRESHOLDS)
_CODES = f"""WITH {_R4},
    codes AS (
      SELECT *, 8 * (tl >= threshold)::INT + 4 * (tr >= threshold)::INT + 2 * (br >= threshold)::INT + (bl >= threshold)::INT AS code
      FROM cells, (VALUES {_T}) t(threshold) WHERE least(tl, tr, br, bl) < threshold AND threshold <= greatest(tl, tr, br, bl))"""


def _at(v0: str, v1: str) -> str:
    return f"CASE WHEN isinf({v0}) AND isinf({v1}) THEN 0.5 WHEN isinf({v0}) THEN 0.0 WHEN isinf({v1}) THEN 1.0 WHEN abs({v1} - {v0}) < 2.220446049250313e-16 THEN 0.5 ELSE greatest(0.0, least(1.0, (threshold - {v0}) / ({v1} - {v0}))) END"


def _segment_rows() -> str:
    rows = []
    for code, pairs in march.SEGMENTS.items():
        for above, own in ((True, pairs), (False, pairs)) if isinstance(pairs, list) else ((True, pairs[0]), (False, pairs[1])):
            rows += [f"({code}, {str(above).lower()}, {k}, '{p[0]}', '{p[1]}')" for k, p in enumerate(own)]
    return ", ".join(rows)


_SEGMENTS = f"""{_CODES},
    points AS (
      SELECT *, (tl + tr + br + bl) * 0.25 >= threshold AS above,
        MAP {{'T': [col + {_at("tl", "tr")}, "row"], 'R': [col + 1, "row" + {_at("tr", "br")}], 'B': [col + {_at("bl", "br")}, "row" + 1], 'L': [col, "row" + {_at("tl", "bl")}]}} AS pt
      FROM codes),
    segments AS (
      SELECT threshold, "row", col, k, pt[f][1] AS x0, pt[f][2] AS y0, pt[g][1] AS x1, pt[g][2] AS y1
      FROM points JOIN (VALUES {_segment_rows()}) s(code, above, k, f, g) USING (code, above))"""

_A, _B, _C, _D, _E, _F = TRANSFORM

#: Rings by walking the edges from every one that might be a ring's first; points are (x, y) in order, closed.
_RINGS = f"""{_L4}{_EDGES},
    e AS (SELECT *, row_number() OVER (ORDER BY region_id, y0, x0, dir) AS id FROM edges),
    nxt AS (
      SELECT a.id, arg_min(b.id, CASE (b.dir - a.dir + 4) % 4 WHEN 1 THEN 0 WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 3 END) AS nid
      FROM e a JOIN e b ON b.region_id = a.region_id AND b.x0 = a.x1 AND b.y0 = a.y1 GROUP BY a.id),
    walk AS (
      SELECT id AS start, id, 0 AS step FROM e WHERE dir IN (0, 2)
      UNION ALL
      SELECT w.start, n.nid, w.step + 1 FROM walk w JOIN nxt n ON n.id = w.id WHERE n.nid <> w.start),
    walked AS (
      SELECT w.start, any_value(s.region_id) AS region_id, any_value(s.dir) AS dir, any_value(s.y0 * 100000 + least(s.x0, s.x1)) AS place,
        min(e.y0 * 100000 + least(e.x0, e.x1)) FILTER (e.dir = s.dir) AS least_, sum(e.x0 * e.y1 - e.x1 * e.y0) AS twice
      FROM walk w JOIN e ON e.id = w.id JOIN e s ON s.id = w.start GROUP BY w.start),
    rings AS (SELECT * FROM walked WHERE place = least_ AND (twice > 0) = (dir = 0)),
    steps AS (
      SELECT r.region_id, r.start, r.dir, r.place, w.step, count(*) OVER (PARTITION BY r.start) AS n, e.x0, e.y0
      FROM rings r JOIN walk w USING (start) JOIN e ON e.id = w.id),
    points AS (
      SELECT region_id, start, dir, place, n, step, x0, y0 FROM steps
      UNION ALL SELECT region_id, start, dir, place, n, n, x0, y0 FROM steps WHERE step = 0)"""


def _geojson_sql(x: str, y: str, order: str) -> str:
    """Coordinates of each region as text."""
    return f"""{_RINGS},
    ring_text AS (SELECT region_id, start, dir, place, '[' || string_agg('[' || CAST({x} AS DOUBLE) || ',' || CAST({y} AS DOUBLE) || ']', ',' ORDER BY {order}) || ']' AS t FROM points GROUP BY ALL),
    texts AS (SELECT region_id, '{{"type":"Polygon","coordinates":[' || string_agg(t, ',' ORDER BY dir, place) || ']}}' AS geometry FROM ring_text GROUP BY region_id),
    known AS (SELECT region_id, arg_min(value, pos) AS value, CAST(count(*) AS DOUBLE) AS area FROM labels GROUP BY region_id)"""


#: A whole number of at most 52 bits as the bytes of a double, little-endian; of a count as those of 32 bits.
_REVERSED = " || ".join(f"substr(h, {k}, 2)" for k in range(15, 0, -2))
_WKB = f"""{_RINGS},
    moved AS (SELECT *, CAST({_A} * x0 + {_C} AS BIGINT) AS x, CAST({_E} * y0 + {_F} AS BIGINT) AS y FROM points),
    whole AS (SELECT DISTINCT unnest([x, y]) AS v FROM moved),
    raised AS (SELECT v, abs(v) AS a, CAST(floor(log2(greatest(abs(v), 1))) AS INT) AS e2 FROM whole),
    bits AS (SELECT v, CASE WHEN v = 0 THEN repeat('0', 16) ELSE
        format('{{:016X}}', CAST((CASE WHEN v < 0 THEN 2048 ELSE 0 END + 1023 + e2) AS UBIGINT) * 4503599627370496 + CAST((a - (1::BIGINT << e2)) * (1::BIGINT << (52 - e2)) AS UBIGINT)) END AS h FROM raised),
    num AS (SELECT v, {_REVERSED} AS t FROM bits),
    ring_hex AS (
      SELECT region_id, start, dir, place, any_value(format('{{:02X}}{{:02X}}0000', (n + 1) % 256, (n + 1) // 256)) || string_agg(a.t || b.t, '' ORDER BY n - step) AS t
      FROM moved JOIN num a ON a.v = x JOIN num b ON b.v = y GROUP BY region_id, start, dir, place),
    texts AS (SELECT region_id, '0103000000' || format('{{:02X}}{{:02X}}0000', count(*) % 256, count(*) // 256) || string_agg(t, '' ORDER BY dir, place) AS geometry FROM ring_hex GROUP BY region_id),
    known AS (SELECT region_id, arg_min(value, pos) AS value FROM labels GROUP BY region_id)"""

#: Lines by following segments over grid edges from each line's first cell, bands from lines, holes by the even-odd rule.
_BANDS = f"""{_SEGMENTS.replace("WITH ", "WITH RECURSIVE ", 1).replace('SELECT threshold, "row", col, k, pt[f][1]', 'SELECT threshold, "row", col, k, f, g, pt[f][1]')},
    ends AS (
      SELECT *, row_number() OVER (ORDER BY threshold, "row", col, k) AS id, ((CAST("row" AS BIGINT) + 1) * 52 + col + 1) * 2 + k AS ring_id,
        [(f IN ('L', 'R'))::INT, "row" + (f = 'B')::INT, col + (f = 'R')::INT] AS enters, [(g IN ('L', 'R'))::INT, "row" + (g = 'B')::INT, col + (g = 'R')::INT] AS leaves FROM segments),
    nxt AS (SELECT a.id, b.id AS nid FROM ends a JOIN ends b ON b.threshold = a.threshold AND b.enters = a.leaves),
    walk AS (
      SELECT id AS start, id, 0 AS step FROM ends
      UNION ALL
      SELECT w.start, n.nid, w.step + 1 FROM walk w JOIN nxt n ON n.id = w.id WHERE n.nid > w.start),
    closed AS (SELECT DISTINCT w.start FROM walk w JOIN nxt n ON n.id = w.id AND n.nid = w.start),
    sides AS (SELECT w.start, w.step, e.* FROM closed JOIN walk w USING (start) JOIN ends e ON e.id = w.id),
    lines AS (
      SELECT start, any_value(threshold) AS threshold, min(ring_id) AS ring_id, count(*) AS n, sum(x0 * y1 - x1 * y0) * 0.5 AS area, arg_min(x0, step) AS px, arg_min(y0, step) AS py, sum(x0) + arg_min(x0, step) AS sx, sum(y0) + arg_min(y0, step) AS sy
      FROM sides GROUP BY start HAVING count(*) >= 3 AND abs(sum(x0 * y1 - x1 * y0) * 0.5) >= 2.220446049250313e-16),
    band(band, lo, hi) AS (VALUES {", ".join(f"({k}, {lo}, {hi})" for k, lo, hi in grid.bands(THRESHOLDS))}),
    outer_ AS (SELECT band, lo, l.* FROM lines l JOIN band ON l.threshold = lo WHERE area < 0),
    holes AS (
      SELECT band, 2 * ring_id AS key, l.* FROM lines l JOIN band ON l.threshold = lo WHERE area >= 0
      UNION ALL SELECT band, 2 * ring_id + 1 AS key, l.* FROM lines l JOIN band ON l.threshold = hi WHERE area < 0),
    sees AS (
      SELECT h.band, h.key, o.ring_id, count(*) AS c
      FROM outer_ o JOIN sides s USING (start) JOIN holes h ON h.band = o.band AND floor(h.py) = floor(least(s.y0, s.y1))
      WHERE (s.y0 > h.py) <> (s.y1 > h.py) AND h.px < (s.x1 - s.x0) * (h.py - s.y0) / (s.y1 - s.y0) + s.x0 GROUP BY ALL),
    placed AS (SELECT band, key, min(ring_id) AS ring_id FROM sees WHERE c % 2 = 1 GROUP BY ALL),
    alone AS (SELECT band, min(ring_id) AS only_ FROM outer_ GROUP BY band HAVING count(*) = 1),
    filled AS (SELECT h.*, coalesce(a.only_, p.ring_id) AS owner FROM holes h LEFT JOIN placed p ON p.band = h.band AND p.key = h.key LEFT JOIN alone a ON a.band = h.band),
    inner_ AS (SELECT band, owner, count(*) AS n_holes, sum(n + 1) AS n, sum(abs(area)) AS area, sum(sx) AS sx, sum(sy) AS sy FROM filled WHERE owner IS NOT NULL GROUP BY ALL),
    features AS (
      SELECT o.band * 281474976710656 + 2 * o.ring_id AS feature_id, CAST(o.lo AS DOUBLE) AS value, 1 + coalesce(n_holes, 0) AS n_rings, o.n + 1 + coalesce(i.n, 0) AS n_points, abs(o.area) - coalesce(i.area, 0) AS area,
        o.px, o.py, o.sx + coalesce(i.sx, 0) AS sx, o.sy + coalesce(i.sy, 0) AS sy
      FROM outer_ o LEFT JOIN inner_ i ON i.band = o.band AND i.owner = o.ring_id WHERE abs(o.area) - coalesce(i.area, 0) > 2.220446049250313e-16)"""

ORACLE_SQL: dict[str, str] = {
    "q01_pixels_from_rows": f'WITH {_PX} SELECT CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, value FROM px',
    "q02_nodata_mask": f'WITH {_PX2} SELECT value, count(*) AS n, CAST(sum("row") AS BIGINT) AS rows, CAST(sum(col) AS BIGINT) AS cols FROM px WHERE value <> 4 AND pos % 7 <> 0 GROUP BY value',
    "q03_digitize": """WITH e AS (SELECT vec_id AS "row", unnest(range(len(embedding))) AS col, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
        SELECT CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, CAST(greatest(0, least(3, (v >= -0.1)::INT + (v >= 0.0)::INT + (v >= 0.1)::INT)) AS INT) AS band FROM e""",
    "q04_quantile_breaks": f"""WITH e AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
        q AS (SELECT unnest(list_sort(list_distinct(quantile_cont(v, {SHARES})))) AS value FROM e)
        SELECT CAST(row_number() OVER (ORDER BY value) - 1 AS INT) AS break_idx, round(value, 6) AS value FROM q""",
    "q05_runs": f"""WITH {_PX}, m AS (SELECT *, CASE WHEN lag(value) OVER w = value AND lag(col) OVER w = col - 1 THEN 0 ELSE 1 END AS new FROM px WINDOW w AS (PARTITION BY "row" ORDER BY col)),
        r AS (SELECT *, sum(new) OVER (PARTITION BY "row" ORDER BY col) AS run FROM m)
        SELECT CAST("row" AS INT) AS "row", CAST(min(col) AS INT) AS col0, CAST(max(col) AS INT) AS col1, any_value(value) AS value, count(*) AS n_pixels FROM r GROUP BY "row", run""",
    "q06_label4": f'{_L4} SELECT CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, region_id FROM labels',
    "q07_label8": f'WITH RECURSIVE {_labels(_PX2, _EIGHT)} SELECT CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, region_id FROM labels',
    "q08_region_area_affine": f'{_L4} SELECT region_id, arg_min(value, pos) AS value, count(*) * 100.0::DOUBLE AS area, CAST(min("row") AS INT) AS first_row, CAST(arg_min(col, pos) AS INT) AS first_col FROM labels GROUP BY region_id',
    "q09_boundary_edges": f"{_L4}{_EDGES} SELECT region_id, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, CAST(dir AS INT) AS dir FROM edges",
    "q10_region_perimeter_holes": f"{_L4}{_STATS} SELECT region_id, perimeter, n_holes FROM stats",
    "q11_polygon_summary": _summary_sql(_L4),
    "q12_polygon_wkb_size": f"{_L4}{_STATS} SELECT region_id, 9 + 4 * (n_holes + 1) + 16 * (perimeter + n_holes + 1) AS bytes, true AS as_counted FROM stats",
    "q13_polygon_wkb": f"{_WKB} SELECT region_id, geometry, value FROM texts JOIN known USING (region_id)",
    "q14_polygon_geojson": f"{_geojson_sql(f'{_A} * x0 + {_C}', f'{_E} * y0 + {_F}', 'n - step')} SELECT region_id, geometry, value FROM texts JOIN known USING (region_id)",
    "q15_features": f"""{_geojson_sql("x0", "y0", "step")}
        SELECT region_id, '{{"type":"Feature","properties":{{"value":' || value || ',"area":' || area || '}},"geometry":' || geometry || '}}' AS feature FROM texts JOIN known USING (region_id)""",
    "q16_transform_bbox": f"""{_L4} SELECT region_id, {_A} * min(col) + {_C} AS min_x, {_A} * (max(col) + 1) + {_C} AS max_x,
        {_E} * (max("row") + 1) + {_F} AS min_y, {_E} * min("row") + {_F} AS max_y, true AS ccw FROM labels GROUP BY region_id""",
    "q17_threshold_bands": """WITH t AS (SELECT DISTINCT CAST(p_size AS DOUBLE) AS lo FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0),
        b AS (SELECT CAST(row_number() OVER (ORDER BY lo) - 1 AS INT) AS band_idx, lo, lead(lo) OVER (ORDER BY lo) AS hi FROM t) SELECT * FROM b WHERE hi IS NOT NULL""",
    "q18_cells": f"""WITH {_R4} SELECT CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, {", ".join(f"CASE WHEN isinf({k}) THEN -1.0 ELSE {k} END AS {k}" for k in ("tl", "tr", "br", "bl"))} FROM cells""",
    "q19_codes": f'{_CODES} SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(code AS INT) AS code, count(*) AS n, CAST(sum("row") AS BIGINT) AS rows, CAST(sum(col) AS BIGINT) AS cols FROM codes GROUP BY ALL',
    "q20_segments": f"""{_SEGMENTS} SELECT CAST(threshold AS DOUBLE) AS threshold, CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, CAST(k AS INT) AS k,
        round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM segments""",
    "q21_isoline_area": f"{_SEGMENTS} SELECT CAST(threshold AS DOUBLE) AS threshold, round(sum(x0 * y1 - x1 * y0) * 0.5, 3) AS area, count(*) AS n FROM segments GROUP BY 1",
    "q22_isoband_summary": f"{_BANDS} SELECT value, count(*) AS n, CAST(sum(n_rings) AS BIGINT) AS n_rings, CAST(sum(n_points) AS BIGINT) AS n_points, round(sum(area), 6) AS area FROM features GROUP BY value",
    "q23_isobands_wkb": f"""{_BANDS} SELECT feature_id, value, CAST(9 + 4 * n_rings + 16 * n_points AS BIGINT) AS bytes, round(px, 6) AS x, round(py, 6) AS y, round(sx, 4) AS sum_x, round(sy, 4) AS sum_y FROM features""",
    "q24_tiled_then_merged": _summary_sql(_L4),
    "q25_class_area": f"{_L4} SELECT value, CAST(count(*) AS DOUBLE) AS area, count(DISTINCT region_id) AS n_polygons FROM labels GROUP BY value",
    "q26_class_area_delta": f"WITH {_PX} SELECT value, CAST(count(*) AS DOUBLE) AS area_1, CAST(count(*) FILTER (value <> 5) AS DOUBLE) AS area_2, CAST(count(*) FILTER (value = 5) AS DOUBLE) AS delta FROM px GROUP BY value",
    "q27_class_mask_polygons": _summary_sql("WITH RECURSIVE " + _labels(_PX.replace("FROM orders", "FROM orders WHERE substr(o_orderpriority, 1, 1) = '1'"), _FOUR)).replace("SELECT region_id, value, CAST(n_holes", "SELECT region_id, CAST(n_holes"),
    "q28_point_in_bbox_and_ring": f"""{_L4}{_EDGES},
        p AS (SELECT DISTINCT region_id, region_id % {W1} + 0.5 AS x, region_id // {W1} + 0.5 AS y FROM labels)
        SELECT p.region_id, count(*) FILTER (x0 = x1 AND greatest(y0, y1) > y AND least(y0, y1) < y AND x < x0) % 2 = 1 AS own,
          count(*) FILTER (x0 = x1 AND greatest(y0, y1) > y AND least(y0, y1) < y AND x - 1 < x0) % 2 = 1 AS "left", any_value(x) - 1 >= min(x0) AND any_value(x) - 1 <= max(x0) AND any_value(y) >= min(y0) AND any_value(y) <= max(y0) AS left_in_box
        FROM p JOIN edges USING (region_id) GROUP BY p.region_id""",
    "q30_arithmetic_breaks": """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE isfinite(value)),
        k AS (SELECT unnest(range(CAST(ceil(lo / 7.5) AS BIGINT), CAST(ceil(hi / 7.5) AS BIGINT))) AS k FROM e)
        SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INT) AS break_idx, CAST(k * 7.5 AS DOUBLE) AS value FROM k""",
    "q31_tile_table": _summary_sql("WITH RECURSIVE " + _labels(_PX.replace("FROM orders", f"FROM orders WHERE NOT ((o_orderkey // {W1}) % 3 = 0 AND (o_orderkey % {W1} % 16) % 5 = 0)"), _FOUR)),
    "q32_quantized_segments": f"""{_SEGMENTS}, q AS (SELECT threshold, round(x0 * 1e10)::BIGINT AS a, round(y0 * 1e10)::BIGINT AS b, round(x1 * 1e10)::BIGINT AS c, round(y1 * 1e10)::BIGINT AS d FROM segments)
        SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (a = c AND b = d) AS n_points, max(b % 10000000000) AS largest FROM q GROUP BY threshold""",
    "q29_top_regions": f"{_L4} SELECT region_id, any_value(value) AS value, CAST(count(*) AS DOUBLE) AS area FROM labels GROUP BY region_id ORDER BY area DESC, region_id LIMIT 20",
}
