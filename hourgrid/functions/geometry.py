"""Centroids of cell polygons held as GeoJSON text."""

from functools import reduce

from pyspark.sql import Column, functions as F

POLYGON = "struct<type:string,coordinates:array<array<array<double>>>>"
MULTIPOLYGON = "struct<type:string,coordinates:array<array<array<array<double>>>>>"


def outer_ring(geometry: str, kinds=("Polygon", "MultiPolygon")) -> Column:
    """First ring of the (first) polygon; NULL for kinds not asked for."""
    kind = F.get_json_object(F.col(geometry), "$.type")
    rings = {
        "Polygon": F.from_json(F.col(geometry), POLYGON)["coordinates"][0],
        "MultiPolygon": F.from_json(F.col(geometry), MULTIPOLYGON)["coordinates"][0][0],
    }
    return reduce(lambda acc, k: acc.when(kind == k, rings[k]), kinds, F)


def _axis(ring: Column, i: int) -> Column:
    return F.transform(ring, lambda p: p[i])


def vertex_mean(ring: Column, axis: int) -> Column:
    """Mean over the listed vertices; the closing vertex counts again."""
    values = _axis(ring, axis)
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def box_middle(ring: Column, axis: int) -> Column:
    values = _axis(ring, axis)
    return (F.array_min(values) + F.array_max(values)) / 2


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x1 - x2, F.lit(2.0)) + F.pow(y1 - y2, F.lit(2.0)))


def lattice_cell(cell: Column, columns=100, side=0.003, west=9.0, south=45.0) -> Column:
    """GeoJSON text of a square lattice cell numbered from 1 along rows."""
    zero = cell.cast("bigint") - 1
    x0 = F.lit(west) + (zero % columns) * F.lit(side)
    y0 = F.lit(south) + F.floor(zero / columns) * F.lit(side)
    x1, y1 = x0 + F.lit(side), y0 + F.lit(side)
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    ring = F.array(*[F.array(x, y) for x, y in corners])
    return F.to_json(F.struct(
        F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")
    ))
