"""Georeferencing: cells, coordinates and flat indices as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flat_index(r, c, ncols) -> Column:
    return _c(r).cast("long") * _c(ncols) + _c(c)


def from_flat_index(idx, ncols) -> tuple[Column, Column]:
    """Row and column of a flat index."""
    return F.floor(_c(idx) / _c(ncols)).cast("int"), (_c(idx) % _c(ncols)).cast("int")


def reglobalize(idx, ncols, row_offset, col_offset, global_ncols) -> Column:
    """A flat index of a part of an image, as one of the whole."""
    r, c = from_flat_index(idx, ncols)
    return flat_index(r + _c(row_offset), c + _c(col_offset), global_ncols)


def cell_centre(r, c, gt: Column) -> tuple[Column, Column]:
    """x and y of a cell's centre under the geotransform gt (six numbers)."""
    return gt[0] + (_c(c) + 0.5) * gt[1], gt[3] + (_c(r) + 0.5) * gt[5]


def cell_of(x, y, gt: Column) -> tuple[Column, Column]:
    """Column and row of the cell at (x, y), truncated toward zero."""
    return ((_c(x) - gt[0]) / gt[1]).cast("int"), ((_c(y) - gt[3]) / gt[5]).cast("int")


#: Names of proj4 units.
UNITS = {"degree": "degree", "deg": "degree", "m": "meter", "meter": "meter", "metre": "meter", "km": "kilometer", "ft": "foot", "us-ft": "US survey foot"}


def unit_of(proj4) -> Column:
    """The unit a proj4 string names; longlat is in degrees; null if it names none that is known."""
    named = F.regexp_extract(_c(proj4), r"\+units=(\S+)", 1)
    table = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.when(_c(proj4).contains("+proj=longlat"), F.lit("degree")).otherwise(table[named])


def dummy_geotransform(ncols) -> Column:
    """That of an image without georeference: unit cells, y down from its number of columns."""
    return F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0), _c(ncols).cast("double"), F.lit(0.0), F.lit(-1.0))


def moved_geotransform(gt: Column, left, top) -> Column:
    """gt of an image cropped by left columns and top rows."""
    return F.array(gt[0] + _c(left) * gt[1], gt[1], gt[2], gt[3] + _c(top) * gt[5], gt[4], gt[5])


def utm(lon, lat, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing (WGS84) of degrees, by Krueger's series to the third order in n (about a millimetre within a zone)."""
    f, a = 1 / 298.257223563, 6378137.0
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    phi, dlon = F.radians(_c(lat)), F.radians(_c(lon) - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(dlon)), F.atanh(F.sin(dlon) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, x in enumerate(alpha, 1):
        east = east + x * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + x * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(500000.0) + 0.9996 * radius * east, F.lit(10000000.0 if south else 0.0) + 0.9996 * radius * north


def lonlat(east, north, zone: int, south: bool = False) -> tuple[Column, Column]:
    """The inverse of utm()."""
    f, a = 1 / 298.257223563, 6378137.0
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = (_c(north) - (10000000.0 if south else 0.0)) / (0.9996 * radius)
    eta = (_c(east) - 500000.0) / (0.9996 * radius)
    x, y = xi, eta
    for j, b in enumerate(beta, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.lit(float(zone * 6 - 183)) + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(phi)
