"""Rotations, poses and projections as column algebra; every result stays in code generation.

A quaternion is a tuple of four columns (x, y, z, w), a vector one of three, a matrix a
tuple of nine, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, ...]


def dot(a: Vector, b: Vector) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        total = total + x * y
    return total


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    """a at length one; nulls for a vector of length zero."""
    n = F.nullif(norm(a), F.lit(0.0))
    return tuple(x / n for x in a)


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def quaternion_product(a: Vector, b: Vector) -> Vector:
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return (
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz,
    )


def conjugate(q: Vector) -> Vector:
    return (-q[0], -q[1], -q[2], q[3])


def rotate(q: Vector, v: Vector) -> Vector:
    """v turned by the unit quaternion q."""
    t = tuple(2 * x for x in cross(q[:3], v))
    u = cross(q[:3], t)
    return tuple(v[i] + q[3] * t[i] + u[i] for i in range(3))


def matrix(q: Vector) -> Vector:
    x, y, z, w = q
    return (
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )


def matrix_vector(m: Vector, v: Vector) -> Vector:
    return tuple(dot(m[3 * i : 3 * i + 3], v) for i in range(3))


def determinant(m: Vector) -> Column:
    return dot(m[:3], cross(m[3:6], m[6:9]))


def is_rotation(m: Vector, tolerance: float) -> Column:
    """Finite, orthogonal rows of length one, determinant one."""
    rows = (m[:3], m[3:6], m[6:9])
    checks = [F.abs(dot(rows[i], rows[j]) - (1 if i == j else 0)) <= tolerance for i in range(3) for j in range(i, 3)]
    ok = F.abs(determinant(m) - 1) <= tolerance
    for c in checks:
        ok = ok & c
    return F.coalesce(ok, F.lit(False))


def angle_degrees(a: Vector, b: Vector) -> Column:
    """The geodesic angle between two unit quaternions."""
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(dot(a, b)))))


def rotation_vector(q: Vector) -> Vector:
    """The logarithm: axis times angle, of a unit quaternion; zero for none."""
    s = F.when(q[3] < 0, -1.0).otherwise(1.0)
    n = norm(q[:3])
    angle = 2 * F.atan2(n, q[3] * s)
    factor = F.when(n > 1e-12, angle * s / n).otherwise(0.0)
    return tuple(x * factor for x in q[:3])


def from_rotation_vector(v: Vector) -> Vector:
    """The exponential: a unit quaternion."""
    n = norm(v)
    factor = F.when(n > 1e-12, F.sin(n / 2) / n).otherwise(0.5)
    return (*(x * factor for x in v), F.cos(n / 2))


def slerp(a: Vector, b: Vector, t: Column) -> Vector:
    """The rotation a share t of the way from a to b, the short way round."""
    d = dot(a, b)
    s = F.when(d < 0, -1.0).otherwise(1.0)
    theta = F.acos(F.least(F.lit(1.0), F.abs(d)))
    wide = F.sin(theta) > 1e-9
    p = F.when(wide, F.sin((1 - t) * theta) / F.sin(theta)).otherwise(1 - t)
    q = F.when(wide, F.sin(t * theta) / F.sin(theta)).otherwise(t) * s
    return tuple(x * p + y * q for x, y in zip(a, b, strict=True))


def euler_xyz(m: Vector) -> Vector:
    """Roll, pitch and yaw about fixed axes."""
    return (F.atan2(m[7], m[8]), F.asin(clipped(-m[6], -1.0, 1.0)), F.atan2(m[3], m[0]))


def six_numbers(m: Vector) -> Vector:
    """The first two columns of a rotation."""
    return (m[0], m[3], m[6], m[1], m[4], m[7])


def from_six_numbers(o: Vector) -> Vector:
    """A rotation from two columns, by Gram and Schmidt."""
    a = unit(o[:3])
    along = dot(a, o[3:])
    b = unit(tuple(o[3 + i] - along * a[i] for i in range(3)))
    c = cross(a, b)
    return (a[0], b[0], c[0], a[1], b[1], c[1], a[2], b[2], c[2])


def mirrored(p: Vector, q: Vector) -> tuple[Vector, Vector]:
    """A pose seen in the mirror x -> -x, its own x axis mirrored too."""
    return (-p[0], p[1], p[2]), (q[0], -q[1], -q[2], q[3])


def mirrored_intrinsics(fx: Column, fy: Column, cx: Column, cy: Column, width: Column) -> Vector:
    """The intrinsics of the mirrored image."""
    return fx, fy, width - cx, cy


def transformed(rotation: Vector, translation: Vector, point: Vector) -> Vector:
    """A point moved by a pose (quaternion, translation)."""
    return tuple(r + t for r, t in zip(rotate(rotation, point), translation, strict=True))


def seen_from(rotation: Vector, translation: Vector, point: Vector) -> Vector:
    """A point in the frame of a pose: the inverse of `transformed`."""
    return rotate(conjugate(rotation), tuple(p - t for p, t in zip(point, translation, strict=True)))


def pose_product(qa: Vector, pa: Vector, qb: Vector, pb: Vector) -> tuple[Vector, Vector]:
    """(quaternion, translation) of the pose b seen through the pose a."""
    return quaternion_product(qa, qb), transformed(qa, pa, pb)


def pose_in(qa: Vector, pa: Vector, qb: Vector, pb: Vector) -> tuple[Vector, Vector]:
    """(quaternion, translation) of the pose b in the frame of the pose a."""
    return quaternion_product(conjugate(qa), qb), seen_from(qa, pa, pb)


def projected(p: Vector, fx: float, fy: float, cx: float, cy: float, width: float, height: float) -> tuple[Column, Column, Column]:
    """Pinhole image of a point and whether it lies in front and inside; outside it is (0, 0)."""
    u, v = fx * p[0] / F.when(p[2] != 0, p[2]) + cx, fy * p[1] / F.when(p[2] != 0, p[2]) + cy
    inside = F.coalesce((p[2] > 0) & (u >= 0) & (u < width) & (v >= 0) & (v < height), F.lit(False))
    return F.when(inside, u).otherwise(0.0), F.when(inside, v).otherwise(0.0), inside


def on_ray(source: Vector, target: Vector, rotation: Vector, translation: Vector) -> dict[str, Column | Vector]:
    """The point nearest to target on the camera's ray through source, for a camera at (rotation, translation).

    depth is the source's, delta what the point lies deeper, point itself, residual its
    distance from the target. A source at depth zero (under 1e-8) is an error.
    """
    seen = seen_from(rotation, translation, source)
    depth = F.when(F.abs(seen[2]) >= 1e-8, seen[2]).otherwise(F.raise_error(F.lit("a point in the camera's plane has no ray")).cast("double"))
    ray = rotate(rotation, tuple(x / depth for x in seen))
    gap = tuple(t - o for t, o in zip(target, translation, strict=True))
    deep = dot(ray, gap) / F.greatest(dot(ray, ray), F.lit(1e-12))
    found = tuple(o + r * deep for o, r in zip(translation, ray, strict=True))
    return {"depth": depth, "delta": deep - depth, "point": found, "residual": norm(tuple(f - t for f, t in zip(found, target, strict=True)))}


def deeper(source: Vector, delta: Column, rotation: Vector, translation: Vector) -> Vector:
    """source moved along its camera ray until it lies `delta` deeper."""
    seen = seen_from(rotation, translation, source)
    depth = F.when(F.abs(seen[2]) >= 1e-8, seen[2]).otherwise(F.raise_error(F.lit("a point in the camera's plane has no ray")).cast("double"))
    return transformed(rotation, translation, tuple(x / depth * (depth + delta) for x in seen))


def pose_deviation(p: Vector, q: Vector, other_p: Vector, other_q: Vector) -> tuple[Column, Column]:
    """Distance (m) and angle (degrees) between two poses."""
    return norm(tuple(a - b for a, b in zip(p, other_p, strict=True))), angle_degrees(q, other_q)


def from_matrix(m: Vector) -> Vector:
    """The unit quaternion of a rotation (nine columns), by its largest part, w not negative; null for nulls."""
    trace = m[0] + m[4] + m[8]
    a, b, c = m[7] - m[5], m[2] - m[6], m[3] - m[1]
    xy, xz, yz = m[1] + m[3], m[2] + m[6], m[5] + m[7]
    ways = [(trace, (a, b, c), 3), (m[0] - m[4] - m[8], (xy, xz, a), 0), (m[4] - m[0] - m[8], (xy, yz, b), 1), (m[8] - m[0] - m[4], (xz, yz, c), 2)]
    largest = F.greatest(*[t for t, _, _ in ways])
    parts = []
    for k in range(4):
        value = F.lit(None).cast("double")
        for t, others, lead in ways:
            s = F.sqrt(t + 1) * 2
            own = s / 4 if k == lead else others[k if k < lead else k - 1] / s
            last = s / 4 if lead == 3 else others[2] / s
            value = F.when(t == largest, F.coalesce(value, own * F.when(last < 0, -1.0).otherwise(1.0))).otherwise(value)
        parts.append(value)
    return tuple(parts)
