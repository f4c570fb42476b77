import numpy as np
import pytest

from terrazzo import api


def rings_of(features):
    return [(v, [len(r) for r in g["coordinates"]]) for g, v in features]


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def test_single_pixel(spark):
    (g, v), = api.shapes(np.array([[42]], np.uint8))
    assert v == 42.0 and g["type"] == "Polygon"
    assert {tuple(p) for p in g["coordinates"][0]} == {(0, 0), (1, 0), (1, 1), (0, 1)} and len(g["coordinates"][0]) == 5
    assert area(g["coordinates"][0]) == 1


def test_uniform_and_hole(spark):
    assert rings_of(api.shapes(np.ones((4, 4), np.uint8))) == [(1.0, [17])]
    hole = np.array([[1, 1, 1], [1, 2, 1], [1, 1, 1]], np.uint8)
    found = dict(rings_of(api.shapes(hole)))
    assert found == {1.0: [13, 5], 2.0: [5]}
    table = api.shapes_arrow(hole)
    assert sorted(len(b.as_py()) for b in table.column("geometry")) == [93, 305]
    assert table.schema.field("geometry").metadata[b"ARROW:extension:name"] == b"geoarrow.wkb" and b"geo" in table.schema.metadata


@pytest.mark.parametrize("connectivity", [4, 8])
def test_checkerboard(spark, connectivity):
    assert len(api.shapes(np.array([[1, 2], [2, 1]], np.uint8), connectivity=connectivity)) == 4


def test_masks_and_nodata(spark):
    a = np.array([[1, 2], [3, 4]], np.uint8)
    assert {v for _, v in api.shapes(a, mask=np.array([[True, False], [True, False]]))} == {1.0, 3.0}
    assert api.shapes(a, mask=np.zeros((2, 2), bool)) == []
    assert {v for _, v in api.shapes(a, nodata=1, mask=np.array([[True, True], [False, True]]))} == {2.0, 4.0}
    assert [v for _, v in api.shapes(np.array([[np.nan, 1], [1, 1]], np.float32), nodata=np.nan)] == [1.0]
    empty = api.shapes_arrow(a, mask=np.zeros((2, 2), bool))
    assert empty.num_rows == 0 and b"geo" in empty.schema.metadata


def test_nan_pixels_are_alone(spark):
    found = api.shapes(np.array([[np.nan, np.nan], [1, 1]], np.float64))
    assert len(found) == 3


def test_transform(spark):
    (g, _), = api.shapes(np.array([[1]], np.uint8), transform=(10, 0, 100, 0, -10, 200))
    ring = g["coordinates"][0]
    assert {p[0] for p in ring} == {100, 110} and {p[1] for p in ring} == {190, 200} and area(ring) == 100


def test_errors(spark):
    a = np.ones((2, 2), np.uint8)
    with pytest.raises(ValueError, match="connectivity must be 4 or 8"):
        api.shapes(a, connectivity=6)
    with pytest.raises(TypeError, match="Unsupported dtype"):
        api.shapes(a.astype(np.int64))
    with pytest.raises(TypeError, match="mask must be a 2D bool array"):
        api.shapes(a, mask=a)
    with pytest.raises(ValueError, match="does not match"):
        api.shapes(a, mask=np.ones((3, 2), bool))
    with pytest.raises(ValueError, match="C-contiguous"):
        api.shapes(np.asfortranarray(np.ones((2, 3), np.uint8)))
    with pytest.raises(TypeError, match="Cannot interpret"):
        api.shapes(np.ones(3, np.uint8))
    with pytest.raises(TypeError, match="transform"):
        api.shapes(a, transform=[1, 2])


def test_contours(spark):
    flat = np.full((3, 3), 5.0)
    (g, v), = api.contours(flat, [3, 7])
    assert v == 3 and len(g["coordinates"][0]) == 13 and abs(area(g["coordinates"][0])) == 14
    assert api.contours(np.full((3, 3), 10.0), [3, 7]) == []
    assert api.contours(np.full((3, 3), 1.0), [3, 7]) == []
    peak = np.zeros((3, 3))
    peak[1, 1] = 5
    (g, v), = api.contours(peak, [2, 8])
    assert v == 2 and len(g["coordinates"][0]) == 5 and abs(area(g["coordinates"][0]) - 0.72) < 1e-12
    donut = np.zeros((5, 5))
    donut[1:4, 1:4] = 2
    donut[2, 2] = 5
    (g, v), = api.contours(donut, [1, 3])
    assert len(g["coordinates"]) == 2
    assert len(api.contours(np.full((4, 4), 0.75, np.float32), [np.nan, 0.5, np.inf, 1, -np.inf])) == 1
    assert api.contours(np.ones((1, 1)), [0.5, 2]) == [] and api.contours(flat, [3]) == []
    assert api.contours_arrow(flat, [3, 7]).num_rows == 1
