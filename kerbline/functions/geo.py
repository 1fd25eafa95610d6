"""Great-circle distance, bounding boxes, polylines and grid cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: mean earth radius in metres.
EARTH_M = 6_371_000.0
M_PER_DEG = EARTH_M * math.pi / 180.0

# Grid cells are this much wider than the search radius.
CELL_SLACK = 1.01


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres; null when a coordinate is missing or NaN."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    s_lat = F.sin(half_dlat)
    s_lon = F.sin(half_dlon)
    root = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lon * s_lon
    # Rounding may lift the root a little over 1. ``least`` would also turn null and NaN into 1.
    root = F.when(F.isnan(root), None).when(root > 1, 1.0).otherwise(root)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(root))


def within_bbox(lat: Column, lon: Column, bbox: dict) -> Column:
    """Plain range predicate for filters: null for missing coordinates, pushed to the scan."""
    return lat.between(bbox["min_lat"], bbox["max_lat"]) & lon.between(bbox["min_lon"], bbox["max_lon"])


def in_bbox(lat: Column, lon: Column, bbox: dict) -> Column:
    """True inside the box; false, not null, for missing coordinates."""
    return F.coalesce(within_bbox(lat, lon, bbox), F.lit(False))


def _mean_of(points: Column, axis: int) -> Column:
    total = F.aggregate(points, F.lit(0.0), lambda acc, pt: acc + F.try_element_at(pt, F.lit(axis)))
    return F.when(F.size(points) > 0, total / F.size(points))


def polyline_midpoint(paths: Column) -> Column:
    """Mean vertex over all paths as ``struct(lon, lat)``; nulls for an empty line."""
    pts = F.flatten(paths)
    return F.struct(_mean_of(pts, 1).alias("lon"), _mean_of(pts, 2).alias("lat"))


def path_mean(path: Column) -> Column:
    """Mean vertex of one path as ``struct(lon, lat)``."""
    return F.struct(_mean_of(path, 1).alias("lon"), _mean_of(path, 2).alias("lat"))


# --- grid cells -------------------------------------------------------------
# Latitude bands have a fixed height. The longitude width of a band depends on
# that band alone: it is wide enough for the radius at the most poleward edge of
# the band and of both its neighbours, so looking at the cell left and right of
# the own one is enough in every band.


def band_height(radius_m: float) -> float:
    return radius_m * CELL_SLACK / M_PER_DEG


def band_of(lat: Column, radius_m: float) -> Column:
    return F.floor(lat / band_height(radius_m)).cast("long")


def _columns(band: Column, radius_m: float) -> Column:
    """How many cells, each at least as wide as the radius there, go round the band."""
    height = band_height(radius_m)
    edge = F.greatest(F.abs(band - 1), F.abs(band + 2)) * height
    narrow = F.cos(F.radians(F.least(edge, F.lit(90.0))))
    return F.greatest(F.floor(F.lit(360.0) / F.lit(height) * narrow).cast("long"), F.lit(1).cast("long"))


def _around(lon: Column, band: Column, radius_m: float) -> Column:
    """Cells from the date line on; equal cells close the circle, near a pole there is one."""
    return (lon + 180.0) / 360.0 * _columns(band, radius_m)


def _column_of(lon: Column, band: Column, radius_m: float) -> Column:
    return F.pmod(F.floor(_around(lon, band, radius_m)).cast("long"), _columns(band, radius_m))


def _cell_key(band: Column, col: Column) -> Column:
    return band * F.lit(1 << 32) + col


def cell_of(lat: Column, lon: Column, radius_m: float) -> Column:
    """Grid cell of a point, one long."""
    band = band_of(lat, radius_m)
    return _cell_key(band, _column_of(lon, band, radius_m))


def with_cells_around(
    df: DataFrame, lat: str, lon: str, radius_m: float, out: str = "cell", bands_around: Sequence[int] = (-1, 0, 1)
) -> DataFrame:
    """``df`` once for each of the cells, nine at most, that hold every point within ``radius_m``.

    Band, columns of the band and column of the point are computed once per band,
    in projections of their own. With ``bands_around`` of 0 and 1, points in the band to
    the south are left out: none of those in the cells left out is north of the own one.
    """
    names = df.columns
    bands = df.withColumn("_band", band_of(F.col(lat), radius_m))
    steps = {k: F.col("_band") + F.lit(k).cast("long") for k in bands_around}
    bands = bands.withColumns({f"_n{k}": _columns(b, radius_m) for k, b in steps.items()})
    bands = bands.withColumns(
        {f"_c{k}": F.pmod(F.floor((F.col(lon) + 180.0) / 360.0 * F.col(f"_n{k}")).cast("long"), F.col(f"_n{k}")) for k in steps}
    )
    keys = []
    for k, b in steps.items():
        c, n = F.col(f"_c{k}"), F.col(f"_n{k}")
        left = F.when(c == 0, n - 1).otherwise(c - 1)
        right = F.when(c == n - 1, F.lit(0).cast("long")).otherwise(c + 1)
        keys.extend(_cell_key(b, x) for x in (left, c, right))
    # Only round a pole a band has so few cells that left and right are the same.
    wide = F.least(*[F.col(f"_n{k}") for k in steps]) >= 3
    around = F.when(wide, F.array(*keys)).otherwise(F.array_distinct(F.array(*keys)))
    return bands.select(*names, F.explode(around).alias(out))


def subcell_xy(lat: Column, lon: Column, radius_m: float, splits: int) -> tuple[Column, Column]:
    """Row and column inside ``cell_of`` when each side is cut in ``splits`` parts.

    ``splits`` is a power of two, so a right shift gives the enclosing coarser part.
    """
    band = band_of(lat, radius_m)
    fy = lat / band_height(radius_m)
    fx = _around(lon, band, radius_m)
    top = F.lit(splits - 1).cast("long")
    iy = F.least(F.floor((fy - F.floor(fy)) * splits).cast("long"), top)
    ix = F.least(F.floor((fx - F.floor(fx)) * splits).cast("long"), top)
    return iy, ix


def box_lower_bound_m(
    lat: Column, lon: Column, lat_lo: Column, lat_hi: Column, lon_lo: Column, lon_hi: Column
) -> Column:
    """No point of the box is nearer than this.

    The larger of the distance to the latitude strip and the distance to the
    meridian that bounds the longitude strip.
    """
    zero = F.lit(0.0)
    d_lat = F.greatest(lat_lo - lat, lat - lat_hi, zero)
    # The shorter way round to the strip, also over the date line.
    apart = F.least(F.pmod(lon_lo - lon, F.lit(360.0)), F.pmod(lon - lon_hi, F.lit(360.0)))
    d_lon = F.when(lon.between(lon_lo, lon_hi), zero).otherwise(apart)
    along = F.radians(d_lat) * EARTH_M
    across = F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(F.least(d_lon, F.lit(90.0))))) * EARTH_M
    # A millimetre is far above rounding error and far below any radius used.
    return F.greatest(along, across) - F.lit(0.001)
