"""Column expressions on points, rectangles and affine matrices (arrays a, b, c, d, e, f: x' = ax + cy + e, y' = bx + dy + f)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(*values) -> Column:
    return F.array(*[(v if isinstance(v, Column) else F.lit(v)).cast("double") for v in values])


def compose(m: Column, n: Column) -> Column:
    """First n, then m."""
    a, b, c, d, e, f = (m[i] for i in range(6))
    return matrix(a * n[0] + c * n[1], b * n[0] + d * n[1], a * n[2] + c * n[3], b * n[2] + d * n[3], a * n[4] + c * n[5] + e, b * n[4] + d * n[5] + f)


def apply(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def invert(m: Column) -> Column:
    """The inverse; null where there is none."""
    a, b, c, d, e, f = (m[i] for i in range(6))
    det = a * d - b * c
    return F.when(det != 0, matrix(d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det))


def viewport(bx: Column, by: Column, bw: Column, bh: Column, scale: float, rotation: Column) -> tuple[Column, Column, Column]:
    """(matrix, width, height) from a page box to device pixels, y down, for rotations by quarter turns; any other
    rotation counts as 0. The box's corner that ends up top left becomes the origin."""
    turn = F.pmod(rotation, F.lit(360))
    s, k = F.lit(float(scale)), float(scale)
    upright = matrix(k, 0.0, 0.0, -k, -bx * s, (by + bh) * s)
    quarter = matrix(0.0, k, k, 0.0, -by * s, -bx * s)
    half = matrix(-k, 0.0, 0.0, k, (bx + bw) * s, -by * s)
    three = matrix(0.0, -k, -k, 0.0, (by + bh) * s, (bx + bw) * s)
    sideways = turn.isin(90, 270)
    m = F.when(turn == 90, quarter).when(turn == 180, half).when(turn == 270, three).otherwise(upright)
    return m, F.when(sideways, bh).otherwise(bw) * s, F.when(sideways, bw).otherwise(bh) * s


def flipped(x: Column, y: Column, width: Column, height: Column, flip: Column) -> tuple[Column, Column]:
    """Mirrors a device point: bit 1 left to right, bit 2 top to bottom."""
    return F.when(flip.bitwiseAND(1) != 0, width - x).otherwise(x), F.when(flip.bitwiseAND(2) != 0, height - y).otherwise(y)


def rotated_rect(x: Column, y: Column, w: Column, h: Column, pw: Column, ph: Column, degrees: int) -> tuple[Column, Column, Column, Column]:
    """Bounds of a rectangle after quarter turns about the middle of a page of pw by ph, exactly."""
    cx, cy = pw / 2, ph / 2
    mx, my = x + w / 2 - cx, y + h / 2 - cy
    turn = degrees % 360
    mx, my, w, h = {0: (mx, my, w, h), 90: (-my, mx, h, w), 180: (-mx, -my, w, h), 270: (my, -mx, h, w)}[turn]
    return cx + mx - w / 2, cy + my - h / 2, w, h


def turned_rect(x: Column, y: Column, w: Column, h: Column, pw: Column, ph: Column, degrees: Column) -> tuple[Column, Column, Column, Column]:
    """Bounds of a rectangle after a turn by any angle about the middle of a page of pw by ph."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    mx, my = x + w / 2 - pw / 2, y + h / 2 - ph / 2
    tw, th = F.abs(c) * w + F.abs(s) * h, F.abs(s) * w + F.abs(c) * h
    return pw / 2 + mx * c - my * s - tw / 2, ph / 2 + mx * s + my * c - th / 2, tw, th


def overlaps(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Do two rectangles share more than an edge?"""
    return (ax < bx + bw) & (ax + aw > bx) & (ay < by + bh) & (ay + ah > by)


def advance(text: Column, widths: Column, size: Column, missing: float = 500.0) -> Column:
    """How far a line moves on: its characters' widths in thousandths of the size, from a map."""
    each = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(widths, c), F.lit(missing)))
    return F.aggregate(each, F.lit(0.0), lambda a, w: a + w) / 1000 * size


def placed(x: Column, w: Column, h: Column, width: Column, most: Column) -> tuple[Column, Column, Column]:
    """(x, w, h) of something put on a page: at most `most` wide, in its own proportions, within the page's width."""
    own = F.least(w, most)
    return F.greatest(F.lit(0.0), F.least(width - own, x)), own, F.when(w == 0, F.lit(0.0)).otherwise(own * h / w)


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Rec. 709 luminance."""
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def rgb(colour: Column) -> Column:
    """'#rrggbb' as a struct of shares of 1."""
    part = lambda at: F.conv(F.substring(colour, at, 2), 16, 10).cast("double") / 255
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


#: The shares of a run's height and length that count as covered, at least (fixed values).
LEAST_BAND, LEAST_SHARE = 0.45, 0.02


def _extent(middle: Column, half: Column, length: Column) -> tuple[Column, Column]:
    """The part of [0, length] within half of the middle."""
    return F.greatest(F.lit(0.0), middle - half), F.least(length, middle + half)


def covered(text: Column, x: Column, y: Column, dx: Column, dy: Column, height: Column, bx: Column, by: Column, bw: Column, bh: Column, least_band: float = LEAST_BAND, least_share: float = LEAST_SHARE) -> Column:
    """What a box covers of a text run: struct(start, end, frac, rect), null if too little.

    A box reaches as far from its middle along any direction as half its sides' shares in that direction; so its extent along the run
    and across it needs no corners, and turned pages no special case. Characters are taken to be of equal width."""
    n = F.hypot(dx, dy)
    c, s = dx / n, dy / n
    mx, my = bx + bw / 2 - x, by + bh / 2 - y
    a0, a1 = _extent(mx * c + my * s, (F.abs(c) * bw + F.abs(s) * bh) / 2, n)
    t0, t1 = _extent(my * c - mx * s, (F.abs(s) * bw + F.abs(c) * bh) / 2, height)
    chars = F.length(text)
    first, last = F.floor(chars * a0 / n), F.least(chars, F.ceil(chars * a1 / n))
    # The covered part of the run's band as an upright rectangle, from its middle.
    long, wide = a1 - a0, height
    px, py = x + c * (a0 + a1) / 2 - s * height / 2, y + s * (a0 + a1) / 2 + c * height / 2
    rw, rh = F.abs(c) * long + F.abs(s) * wide, F.abs(s) * long + F.abs(c) * wide
    rect = F.struct((px - rw / 2).alias("x"), (py - rh / 2).alias("y"), rw.alias("w"), rh.alias("h"))
    enough = (n > 0) & (height > 0) & (a1 > a0) & (t1 > t0) & (t1 - t0 >= height * least_band) & (long >= n * least_share) & (last > first)
    return F.when(enough, F.struct(first.cast("int").alias("start"), last.cast("int").alias("end"), (long / n).alias("frac"), rect.alias("rect")))
