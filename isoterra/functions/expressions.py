"""Column expressions: elevation text, plane geometry, squares, colours. All stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Metres in a degree of latitude (two are in use), tolerance of a strict crossing.
M_PER_DEGREE, M_PER_DEGREE_LONG, EPS = 110_540.0, 111_320.0, 1e-9
#: Fixed pattern: text that is a finite decimal number, with underscores between digits allowed.
NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
#: Fixed pattern: the build's own, looser test of a number.
LOOSE_NUMBER = r"^-?[0-9][-0-9.]*$"


def parse_ele(text: Column) -> Column:
    """Elevation in metres; null for text that is no finite number (unlike a cast, '12d', 'inf' and 'nan' are none)."""
    bare = F.trim(text)
    value = F.regexp_replace(bare, "_", "").try_cast("double")
    return F.when(bare.rlike(NUMBER) & (F.abs(value) < float("inf")), value)


def loosely_numeric(text: Column) -> Column:
    return text.rlike(LOOSE_NUMBER)


def format_ele(v: Column) -> Column:
    """Three places, half to even, as plain decimal digits without a trailing .0; a value that is not finite stops the
    query, a null has no text."""
    v = v.cast("double")
    digits = F.regexp_replace(F.bround(v, 3).cast("decimal(38,3)").cast("string"), r"\.?0+$", "")
    wrong = F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(v.isNull(), F.lit(None).cast("string")).when(wrong, F.raise_error(F.concat(v.cast("string"), F.lit(" is not an elevation")))).otherwise(digits)


#: Fixed pattern: a height as people write it (sign, thousands in commas, places, unit), and the units that are feet.
HEIGHT = r"(?i)^\s*(-?\d{1,3}(,\d{3})+|-?\d+)(\.\d+)?\s*(m|metres|meters|ft|feet|')?\s*$"
FEET = ["ft", "feet", "'"]


def height_text(text: Column) -> Column:
    """Metres of a height as people write it, null for any other text: feet are rounded to the metre, half to even."""
    number = F.concat(F.regexp_replace(F.regexp_extract(text, HEIGHT, 1), ",", ""), F.regexp_extract(text, HEIGHT, 3)).try_cast("double")
    feet = F.lower(F.regexp_extract(text, HEIGHT, 4)).isin(FEET)
    return F.when(text.rlike(HEIGHT), F.when(feet, F.rint(number * 0.3048)).otherwise(number))


def orient(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of a, b, c: positive where c lies left of a-b."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def both_sides(d1: Column, d2: Column, eps: float = EPS) -> Column:
    return ((d1 > eps) & (d2 < -eps)) | ((d1 < -eps) & (d2 > eps))


def strictly_cross(a: tuple, b: tuple, eps: float = EPS) -> Column:
    """Segments (x1, y1, x2, y2) that cross at inner points of both."""
    d1, d2 = orient(*b, a[0], a[1]), orient(*b, a[2], a[3])
    d3, d4 = orient(*a, b[0], b[1]), orient(*a, b[2], b[3])
    return both_sides(d1, d2, eps) & both_sides(d3, d4, eps)


def crossing_parameter(a: tuple, b: tuple) -> Column:
    """Where on segment a the line of b crosses it, 0 to 1."""
    d1, d2 = orient(*b, a[0], a[1]), orient(*b, a[2], a[3])
    return d1 / (d1 - d2)


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    dx, dy = bx - ax, by - ay
    along = ((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def square_name(lon: Column, lat: Column) -> Column:
    """N42E017 of the degree square that holds a point, its west and south sides included."""
    x, y = F.floor(lon), F.floor(lat)
    return F.concat(
        F.when(y >= 0, "N").otherwise("S"), F.lpad(F.abs(y).cast("string"), 2, "0"),
        F.when(x >= 0, "E").otherwise("W"), F.lpad(F.abs(x).cast("string"), 3, "0"),
    )


def square_lat(name: Column) -> Column:
    n = F.regexp_extract(name, r"^([NS])(\d{2})([EW])(\d{3})", 2).try_cast("int")
    return F.when(F.substring(name, 1, 1) == "S", -n).otherwise(n)


def square_lon(name: Column) -> Column:
    n = F.regexp_extract(name, r"^([NS])(\d{2})([EW])(\d{3})", 4).try_cast("int")
    return F.when(F.substring(name, 4, 1) == "W", -n).otherwise(n)


#: Figures that a span is rounded up to, times a power of ten.
NICE = (1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0)


def nice_span(v: Column, least: float = 5.0) -> Column:
    """v, to a tenth, rounded up to one of NICE times a power of ten, and at least `least`."""
    v = F.bround(v, 1)
    base = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(v, F.lit(1e-9)))))
    up = F.lit(NICE[-1])
    for step in NICE[-2::-1]:
        up = F.when(v <= base * step, F.lit(step)).otherwise(up)
    return F.when(v.isNull(), F.lit(None)).when(v <= least, F.lit(least)).otherwise(up * base)


def mercator_x(lon: Column) -> Column:
    return lon * (6378137.0 * 3.141592653589793 / 180)


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(0.7853981633974483) + lat * (3.141592653589793 / 360))) * 6378137.0
