"""The nearest of many places for each of many points, by joins on cells that grow.

Positions become points of the unit sphere in space, so neither poles nor the date line are special. Space is cut into cubes; a
point meets the places of its own cube and the 26 around it, which hold all within a cube's side. Where the best of them is
no farther than that, it is the nearest; the other points go on with cubes of twice the side, until one spans the sphere.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import haversine_km
from ..sources.scratch import saved

#: Radius of the distances, in km; places in a cube on average at first.
RADIUS, CROWD = 6371.0, 4


def _space(latitude: str, longitude: str) -> list[Column]:
    lat, lon = F.radians(latitude), F.radians(longitude)
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]


def _cells(axes: list[Column], side: float) -> list[Column]:
    return [F.floor(c / side).cast("int") for c in axes]


def first_side(places: int) -> float:
    """The side of cubes that hold CROWD of so many places, if they were spread evenly over the sphere."""
    return min(2.0, math.sqrt(4 * math.pi * CROWD / max(places, 1)))


def nearest(points: DataFrame, places: DataFrame) -> DataFrame:
    """id, place and km of the nearest place of each point with a position; of equally near ones (to a millimetre) the first.

    points: id, latitude, longitude. places: place (its order), latitude, longitude. Rows without a position drop out. A round writes the points
    that are left; with CROWD places in a cube a point meets some hundred rows at first, and few go on.
    """
    axes = ["x", "y", "z"]
    at = lambda df, key: df.where("latitude IS NOT NULL AND longitude IS NOT NULL").select(key, "latitude", "longitude", *[c.alias(a) for c, a in zip(_space("latitude", "longitude"), axes, strict=True)])
    left, known = saved(at(points, "id"), "points"), saved(at(places, "place"), "places")
    n = known.count()
    out, side = None, first_side(n)
    while True:
        whole = side >= 2
        cells = [F.lit(0)] * 3 if whole else _cells([F.col(a) for a in axes], side)
        held = known.select("place", F.col("latitude").alias("y2"), F.col("longitude").alias("x2"), F.struct(*[c.alias(a) for c, a in zip(cells, axes, strict=True)]).alias("cell"))
        around = F.sequence(F.lit(-1), F.lit(1)) if not whole else F.array(F.lit(0))
        near = left.select("id", "latitude", "longitude", *[c.alias(f"c{a}") for c, a in zip(cells, axes, strict=True)])
        for a in axes:
            near = near.withColumn(f"d{a}", F.explode(around))
        near = near.withColumn("cell", F.struct(*[(F.col(f"c{a}") + F.col(f"d{a}")).alias(a) for a in axes]))
        met = near.join(held, "cell").withColumn("km", F.round(haversine_km("latitude", "longitude", "y2", "x2", RADIUS), 6))
        best = met.groupBy("id").agg(F.min(F.struct("km", "place")).alias("b")).select("id", "b.place", "b.km")
        # a chord of length s spans 2 asin(s / 2); a little less, against rounding
        safe = 2 * RADIUS * math.asin(min(side, 2.0) / 2) * (1 - 1e-9)
        done = saved(best if whole else best.where(F.col("km") <= safe), "nearest")
        out = done if out is None else out.unionByName(done)
        if whole:
            return out
        left = saved(left.join(done.select("id"), "id", "left_anti"), "points")
        if not left.head(1):
            return out
        side *= 2


def all_distances(points: DataFrame, places: DataFrame) -> DataFrame:
    """The same by all distances, for tests on small tables."""
    both = points.crossJoin(places.withColumnsRenamed({"latitude": "y2", "longitude": "x2"}))
    km = F.round(haversine_km("latitude", "longitude", "y2", "x2", RADIUS), 6)
    return both.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in ("latitude", "longitude", "y2", "x2")])).groupBy("id").agg(F.min(F.struct(km.alias("km"), "place")).alias("b")).select("id", "b.place", "b.km")
