"""Boxes, rotations and rigid transforms as Column formulas; vectors as array<double>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 1000
STD_FLOOR = 1e-7


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, and stands once in the plan."""
    return F.transform(F.array(value), use)[0]


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ordered_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A box on the 0-1000 grid with its corners in order; null if under one cell wide or high."""
    a, b, c, d = (clamp(F.bround(v, 0), 0, GRID).cast("int") for v in (x1, y1, x2, y2))
    box = F.struct(F.least(a, c).alias("x1"), F.least(b, d).alias("y1"), F.greatest(a, c).alias("x2"), F.greatest(b, d).alias("y2"))
    return F.when((a != c) & (b != d), box)


def to_pixels(v: Column, size: Column) -> Column:
    return F.bround(v * size / GRID, 0).cast("int")


def to_grid(v: Column, size: Column) -> Column:
    return clamp(F.bround(v * GRID / size, 0), 0, GRID).cast("int")


def overlaps(a: str, b: str) -> Column:
    """Do two rectangle structs (x, y, w, h) intersect in more than an edge?"""
    p, q = (lambda n: F.col(f"{a}.{n}")), (lambda n: F.col(f"{b}.{n}"))
    return (p("x") < q("x") + q("w")) & (q("x") < p("x") + p("w")) & (p("y") < q("y") + q("h")) & (q("y") < p("y") + p("h"))


def field_of_view(size: Column, focal: Column) -> Column:
    return 2 * F.atan(size / (2 * focal))


def cell(m: Column, row: int, col: int) -> Column:
    return F.get(m, row * 3 + col)


def rotate(m: Column, v: Column) -> Column:
    """3x3 matrix (nine numbers by rows) times vector."""
    return F.array(*[sum((cell(m, r, k) * F.get(v, k) for k in range(1, 3)), cell(m, r, 0) * F.get(v, 0)) for r in range(3)])


def product(a: Column, b: Column) -> Column:
    return F.array(*[cell(a, r, 0) * cell(b, 0, c) + cell(a, r, 1) * cell(b, 1, c) + cell(a, r, 2) * cell(b, 2, c) for r in range(3) for c in range(3)])


def transposed(m: Column) -> Column:
    return F.array(*[cell(m, c, r) for r in range(3) for c in range(3)])


def angle(m: Column) -> Column:
    """Rotation angle of a matrix, in radians: from sine and cosine together, so exact near zero as well."""
    x, y, z = cell(m, 2, 1) - cell(m, 1, 2), cell(m, 0, 2) - cell(m, 2, 0), cell(m, 1, 0) - cell(m, 0, 1)
    return F.atan2(F.sqrt(x * x + y * y + z * z), cell(m, 0, 0) + cell(m, 1, 1) + cell(m, 2, 2) - 1)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def identity() -> Column:
    return F.array(*[F.lit(float(r == c)) for r in range(3) for c in range(3)])


def homogeneous(m: Column, t: Column) -> Column:
    """Sixteen numbers by rows from a rotation and a translation."""
    rows = [F.concat(F.slice(m, 3 * r + 1, 3), F.slice(t, r + 1, 1)) for r in range(3)]
    return F.concat(*rows, F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0))))


def changed_view(m: Column, view: Column, mirror: Column) -> Column:
    """A rotation seen from another view, mirrored: view . m . mirror."""
    return product(product(view, m), mirror)


def changed_step(m: Column, view: Column) -> Column:
    """A relative rotation seen from another view: view . m . view transposed."""
    return product(product(view, m), transposed(view))


def swapped_halves(x: Column, flip: Column) -> Column:
    """A vector of left and right halves, exchanged where `flip` holds; of odd lengths the right half is longer."""
    half = F.floor(F.size(x) / 2).cast("int")
    return F.when(flip, F.concat(F.slice(x, half + 1, F.size(x) - half), F.slice(x, F.lit(1), half))).otherwise(x)


def projected(point: Column, intrinsics: Column, height: Column, width: Column, nearest: float = 0.05) -> Column:
    """Pixel (u, v) of a point in camera space under normalised intrinsics; depth is at least `nearest`."""
    z = F.greatest(F.get(point, 2), F.lit(nearest))
    ray = F.array(F.get(point, 0) / z, F.get(point, 1) / z, F.lit(1.0))
    at = rotate(intrinsics, ray)
    return F.struct(F.bround(F.get(at, 0) * width, 0).cast("int").alias("u"), F.bround(F.get(at, 1) * height, 0).cast("int").alias("v"))


def camera(fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    zero = F.lit(0.0)
    return F.array(fx.cast("double"), zero, cx.cast("double"), zero, fy.cast("double"), cy.cast("double"), zero, zero, F.lit(1.0))


def cropped_camera(k: Column, size: Column, crop: Column, resized: Column) -> Column:
    """Intrinsics after a centred square crop, then a resize."""
    shift, scale = (size - crop) / 2, resized / crop
    return camera(cell(k, 0, 0) * scale, cell(k, 1, 1) * scale, (cell(k, 0, 2) - shift) * scale, (cell(k, 1, 2) - shift) * scale)


def resized_camera(k: Column, height: Column, width: Column) -> Column:
    """Intrinsics of an image whose centre is the principal point, after a resize."""
    x, y = width / (2 * cell(k, 0, 2)), height / (2 * cell(k, 1, 2))
    return camera(cell(k, 0, 0) * x, cell(k, 1, 1) * y, cell(k, 0, 2) * x, cell(k, 1, 2) * y)


def normalised_camera(k: Column) -> Column:
    """Intrinsics in shares of the image, whose centre is the principal point."""
    x, y = cell(k, 0, 2) * 2, cell(k, 1, 2) * 2
    return F.array(*[cell(k, 0, c) / x for c in range(3)], *[cell(k, 1, c) / y for c in range(3)], *[cell(k, 2, c) for c in range(3)])


def coordinate(v: Column, size: Column, other: Column) -> Column:
    """A model's coordinate as a pixel: a share where it and the other axis are at most 1, else on the grid, else a pixel."""
    most = F.greatest(F.abs(v), F.abs(other))
    at = F.when(most <= 1, v * size).when(most <= GRID, v / GRID * size).otherwise(v)
    return F.bround(F.greatest(F.lit(0.0), F.least(size - 1.0, at)), 0).cast("int")


def share_box_pixels(box: Column, width: Column, height: Column) -> Column:
    """Pixel corners of a box given in shares of the image (four numbers, any order); null without an area or with fewer numbers."""
    x0, y0, x1, y1 = (F.get(box, i) for i in range(4))
    left, top = (F.least(x0, x1) * width).cast("int"), (F.least(y0, y1) * height).cast("int")
    right, bottom = (F.greatest(x0, x1) * width).cast("int"), (F.greatest(y0, y1) * height).cast("int")
    ok = (F.size(box) >= 4) & (right > left) & (bottom > top)
    return F.when(ok, F.struct(left.alias("x1"), top.alias("y1"), right.alias("x2"), bottom.alias("y2")))


def fitted_box(left: Column, top: Column, width: Column, height: Column, image_width: Column, image_height: Column, least: int) -> Column:
    """A box of at least `least` pixels a side moved into the image; null if it is larger than the image."""
    w, h = F.greatest(F.lit(least), width.cast("int")), F.greatest(F.lit(least), height.cast("int"))
    x = F.greatest(F.lit(0), F.least(left.cast("int"), image_width - w))
    y = F.greatest(F.lit(0), F.least(top.cast("int"), image_height - h))
    fits = (w <= image_width) & (h <= image_height)
    return F.when(fits, F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2")))


def atan2(y: Column, x: Column) -> Column:
    """The angle with the sign of y, also of a zero: Spark's own takes -0.0 for 0.0 and so pi for -pi."""
    return F.when((y == 0) & (F.pow(y, F.lit(-1.0)) < 0), -F.atan2(y, x)).otherwise(F.atan2(y, x))


def to_euler(m: Column) -> Column:
    """Extrinsic x, y, z angles; at gimbal lock (|y| = pi/2) the split between x and z is not unique."""
    return F.array(atan2(cell(m, 2, 1), cell(m, 2, 2)), -F.asin(clamp(cell(m, 2, 0), -1.0, 1.0)), atan2(cell(m, 1, 0), cell(m, 0, 0)))


def from_euler(e: Column) -> Column:
    x, y, z = (F.get(e, i) for i in range(3))
    cx, sx, cy, sy, cz, sz = F.cos(x), F.sin(x), F.cos(y), F.sin(y), F.cos(z), F.sin(z)
    return F.array(cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx, sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx, -sy, cy * sx, cy * cx)


def to_six(m: Column) -> Column:
    return F.slice(m, 1, 6)


def from_six(d: Column) -> Column:
    """Gram-Schmidt on two rows; the third is their cross product."""
    a, b = [F.get(d, i) for i in range(3)], [F.get(d, i) for i in range(3, 6)]
    n = F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
    a = [x / n for x in a]
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    b = [y - dot * x for x, y in zip(a, b, strict=True)]
    n = F.sqrt(b[0] * b[0] + b[1] * b[1] + b[2] * b[2])
    b = [x / n for x in b]
    c = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    return F.array(*a, *b, *c)


def normalised(x: Column, mean: Column, std: Column) -> Column:
    return F.transform(F.arrays_zip(x.alias("x"), mean.alias("m"), std.alias("s")), lambda r: (r["x"] - r["m"]) / (r["s"] + STD_FLOOR))


def denormalised(x: Column, mean: Column, std: Column) -> Column:
    return F.transform(F.arrays_zip(x.alias("x"), mean.alias("m"), std.alias("s")), lambda r: r["x"] * (r["s"] + STD_FLOOR) + r["m"])


def padded(x: Column, mask: Column, width: int) -> Column:
    """Masked-out numbers as zero, then zeros up to `width`."""
    kept = F.zip_with(x, mask, lambda v, m: F.when(m, v).otherwise(F.lit(0.0)))
    return F.concat(kept, F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size(x), F.lit(0))))
