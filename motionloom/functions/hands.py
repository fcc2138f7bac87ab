"""Hand geometry from 21 key points, as column algebra; gripper modes by name.

Key points are an array of [x, y, z]; their places are those of POINTS.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import Vector, clipped, cross, dot, norm, unit

# The places of the key points, and where each but the last stands in the detector's order.
POINTS = {
    "thumb_tip": 0, "index_tip": 1, "middle_tip": 2, "ring_tip": 3, "pinky_tip": 4, "wrist": 5, "thumb_mcp": 6, "thumb_ip": 7,
    "index_mcp": 8, "index_pip": 9, "index_dip": 10, "middle_mcp": 11, "middle_pip": 12, "middle_dip": 13,
    "ring_mcp": 14, "ring_pip": 15, "ring_dip": 16, "pinky_mcp": 17, "pinky_pip": 18, "pinky_dip": 19, "palm": 20,
}
DETECTED = [4, 8, 12, 16, 20, 0, 2, 3, 5, 6, 7, 9, 10, 11, 13, 14, 15, 17, 18, 19]
PALM_FROM = [0, 5, 9]
#: Wrist to middle knuckle of an average hand, in metres.
HAND_SIZE = 0.085
FINGERS = ["index", "middle", "ring", "pinky"]


def point(points: Column, name: str) -> Vector:
    p = F.get(points, POINTS[name])
    return tuple(F.get(p, k) for k in range(3))


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def mean(*points: Vector) -> Vector:
    return tuple(sum(xs[1:], xs[0]) / len(points) for xs in zip(*points, strict=True))


def midpoint(a: Vector, b: Vector) -> Vector:
    return mean(a, b)


def frame(along: Vector, side: Vector) -> tuple[Vector, Vector, Vector]:
    """Three orthogonal axes, the first along `along`, the second as near to `side` as can be (Gram and Schmidt)."""
    x = unit(along)
    d = dot(x, side)
    y = unit(tuple(s - d * a for s, a in zip(side, x, strict=True)))
    return x, y, cross(x, y)


def usable(along: Vector, side: Vector, least: float = 1e-6) -> Column:
    """Whether two directions span a frame."""
    return norm(cross(along, side)) > least


def bend(a: Vector, b: Vector) -> Column:
    """The angle between two bones."""
    return F.acos(clipped(dot(a, b) / (norm(a) * norm(b)), -1.0, 1.0))


def _degrees(a: Vector, b: Vector) -> Column:
    """The angle between two vectors, which may be zero."""
    return F.degrees(F.acos(clipped(dot(a, b) / ((norm(a) + 1e-6) * (norm(b) + 1e-6)), -1.0, 1.0)))


def _given(v: Vector, use: Callable[[Vector], Column]) -> Column:
    """use(v) with v computed once; plain columns would repeat v's expression wherever it is used."""
    return F.get(F.transform(F.array(F.array(*v)), lambda a: use(tuple(F.get(a, k) for k in range(3)))), 0)


def joint_angles(points: Column) -> Column:
    """Flexion and abduction of all joints in degrees, by name; null for fewer than 21 points."""
    wrist = point(points, "wrist")
    side = cross(minus(point(points, "index_mcp"), wrist), minus(point(points, "middle_mcp"), wrist))
    ahead = minus(point(points, "middle_pip"), point(points, "middle_mcp"))

    def turned(normal: Vector) -> Column:
        return _given(_in_palm(ahead, normal), lambda flat: _angles(points, normal, flat))

    found = _given(side, lambda s: _given(tuple(x / (norm(s) + 1e-6) for x in s), turned))
    return F.when(F.size(points) >= 21, found)


def _in_palm(v: Vector, normal: Vector) -> Vector:
    return tuple(x - dot(v, normal) * n for x, n in zip(v, normal, strict=True))


def _angles(points: Column, normal: Vector, ahead: Vector) -> Column:
    """The map of joint_angles; ahead is the middle finger's direction in the palm."""
    at = lambda name: point(points, name)
    wrist = at("wrist")
    aside = lambda v: _given(_in_palm(v, normal), lambda flat: _degrees(flat, ahead))
    found: dict[str, Column] = {}
    for finger in FINGERS:
        chain = [wrist, *[at(f"{finger}_{j}") for j in ("mcp", "pip", "dip", "tip")]]
        bones = [minus(b, a) for a, b in zip(chain, chain[1:], strict=False)]
        for joint, a, b in zip(("MCP", "PIP", "DIP"), bones, bones[1:], strict=False):
            found[f"{finger.capitalize()}_{joint}_Flex"] = _degrees(a, b)
        found[f"{finger.capitalize()}_MCP_Abd"] = F.lit(0.0) if finger == "middle" else aside(bones[1])
    thumb = [wrist, at("thumb_mcp"), at("thumb_ip"), at("thumb_tip")]
    bones = [minus(b, a) for a, b in zip(thumb, thumb[1:], strict=False)]
    found["Thumb_CMC_Flex"] = _degrees(minus(at("middle_mcp"), wrist), bones[0])
    found["Thumb_CMC_Abd"] = aside(bones[0])
    found["Thumb_MCP_Flex"], found["Thumb_IP_Flex"] = _degrees(bones[0], bones[1]), _degrees(bones[1], bones[2])
    return F.create_map(*[x for name, angle in found.items() for x in (F.lit(name), angle)])


def reordered(points: Column, order: list[int], centre: list[int] | None = None) -> Column:
    """Items of an array in another order, and behind them the mean of those of `centre` (all picked ones if None).

    Items are numbers, or points.
    """
    picked = F.array(*[F.get(points, i) for i in order])
    if centre is None:
        return F.concat(picked, F.array(F.aggregate(picked, F.lit(0.0), lambda s, x: s + x) / len(order)))
    total = [sum((F.get(F.get(points, i), k) for i in centre[1:]), F.get(F.get(points, centre[0]), k)) / len(centre) for k in range(3)]
    return F.concat(picked, F.array(F.array(*total)))


def remapped(detected: Column) -> Column:
    """21 points of the detector in the order of POINTS, the palm's centre computed."""
    return reordered(detected, DETECTED, PALM_FROM)


def recovered(flat: Column, relative: Column, fx: float, fy: float, cx: float, cy: float) -> Column:
    """Points in the camera's frame from image points and points relative to each other, both in the detector's order.

    The wrist's depth is the focal length times the size of the hand over its size in
    pixels; null for under 5 pixels or a depth outside 0.05 to 3 m. No point is nearer than 0.01.
    """
    xy = lambda i, k: F.get(F.get(flat, i), k)
    rel = lambda i, k: F.get(F.get(relative, i), k)
    size = norm(tuple(rel(9, k) - rel(0, k) for k in range(3)))
    pixels = norm(tuple(xy(9, k) - xy(0, k) for k in range(2)))
    z = (fx + fy) / 2 * F.when(size < 0.01, HAND_SIZE).otherwise(size) / F.when(pixels >= 5.0, pixels)
    wrist = ((xy(0, 0) - cx) * z / fx, (xy(0, 1) - cy) * z / fy, z)
    moved = F.transform(relative, lambda p: F.array(*[wrist[k] + F.get(p, k) - rel(0, k) for k in range(2)], F.greatest(F.lit(0.01), wrist[2] + F.get(p, 2) - rel(0, 2))))
    return F.when(z.between(0.05, 3.0), moved)


def reprojection(points: Column, flat: Column, fx: float, fy: float, cx: float, cy: float, width: float, height: float, fallback: float) -> Column:
    """Confidence from the mean pixel error of points against image points: logistic in its share of the
    diagonal, within 0.05 and 0.99; `fallback` with fewer than 5 points in front and in the image.
    """
    both = F.arrays_zip(points.alias("p"), flat.alias("f"))
    seen = F.filter(both, lambda x: (x["p"][2] > 0.01) & (x["f"][0] > 0) & (x["f"][0] < width) & (x["f"][1] > 0) & (x["f"][1] < height))
    gap = lambda x: F.sqrt(F.pow(x["p"][0] / x["p"][2] * fx + cx - x["f"][0], F.lit(2)) + F.pow(x["p"][1] / x["p"][2] * fy + cy - x["f"][1], F.lit(2)))
    error = F.aggregate(seen, F.lit(0.0), lambda s, x: s + gap(x)) / F.size(seen)
    share = error / (width * width + height * height) ** 0.5
    return F.when(F.size(seen) < 5, fallback).otherwise(clipped(1 / (1 + F.exp(200 * (share - 0.025))), 0.05, 0.99))


def principal_point_shear(fx: float, fy: float, cx: float, cy: float, width: float, height: float) -> list[list[float]]:
    """The matrix from image-centred camera coordinates to those of calibrated intrinsics."""
    return [[1.0, 0.0, (0.5 * width - cx) / fx], [0.0, 1.0, (0.5 * height - cy) / fy], [0.0, 0.0, 1.0]]


@dataclass(frozen=True)
class GripperMode:
    """How a hand becomes a gripper: the second fingertip is `index` of the index finger's and the rest of the middle finger's."""

    index: float = 1.0
    jaw_from_tips: bool = False
    forward_to: tuple[str, ...] = ("index_mcp", "middle_mcp", "ring_mcp", "pinky_mcp")

    def fingertip(self, points: Column) -> Vector:
        a, b = point(points, "index_tip"), point(points, "middle_tip")
        return a if self.index == 1.0 else tuple(self.index * x + (1 - self.index) * y for x, y in zip(a, b, strict=True))

    def position(self, points: Column) -> Vector:
        return mean(point(points, "thumb_tip"), self.fingertip(points))

    def jaw(self, points: Column, right: Column) -> Vector:
        """The axis from the thumb's side to the fingers', before it is normalised."""
        if not self.jaw_from_tips:
            return minus(point(points, "index_mcp"), point(points, "thumb_mcp"))
        sign = F.when(right, 1.0).otherwise(-1.0)
        return tuple(sign * x for x in minus(self.fingertip(points), point(points, "thumb_tip")))

    def forward(self, points: Column) -> Vector:
        ahead = self.fingertip(points) if self.jaw_from_tips else mean(*[point(points, p) for p in self.forward_to])
        return minus(ahead, point(points, "wrist"))

    def ratio(self, points: Column, least: float = 0.01) -> Column:
        """Opening over the palm's size; null for a palm of `least` or less."""
        palm = norm(minus(point(points, "middle_mcp"), point(points, "wrist")))
        return F.when(palm > least, norm(minus(point(points, "thumb_tip"), self.fingertip(points))) / palm)

    def distance(self, points: Column) -> Column:
        return norm(minus(point(points, "thumb_tip"), point(points, "index_tip")))


#: Modes by their names in configurations.
MODES: dict[str, GripperMode] = {
    "finger_center": GripperMode(),
    "humanego": GripperMode(forward_to=("thumb_mcp", "index_mcp")),
    "qwen": GripperMode(index=0.7, jaw_from_tips=True),
}


def gripper_mode(name: str) -> GripperMode:
    if name not in MODES:
        raise ValueError(f"no mode {name}; known: {', '.join(sorted(MODES))}")
    return MODES[name]


def wrist_axes(points: Column, least: float = 1e-6) -> Column:
    """(jaw, forward, up) of the wrist: forward to the palm's centre, jaw across it; null if they don't span a frame."""
    along, side = minus(point(points, "palm"), point(points, "wrist")), minus(point(points, "index_mcp"), point(points, "middle_mcp"))
    forward, jaw = unit(along), cross(unit(along), side)
    x = unit(jaw)
    z = cross(x, forward)
    ok = (norm(along) >= least) & (norm(jaw) >= least)
    return F.when(ok, F.array(F.array(*x), F.array(*cross(z, x)), F.array(*z)))


def _col(name: str) -> Vector:
    return tuple(F.col(f"{name}_{k}") for k in range(3))


def _with(df: DataFrame, **vectors: Vector) -> DataFrame:
    """df with three columns for each vector, so that what follows refers to them and does not repeat them."""
    return df.withColumns({f"{name}_{k}": v[k] for name, v in vectors.items() for k in range(3)})


def gripper_axes(df: DataFrame, by: list[str], order: str, points: str, right: str, mode: GripperMode) -> DataFrame:
    """df with axes (jaw, forward, up; an array of arrays) and position of the gripper that a hand stands for.

    A hand whose points span no frame keeps the frame before it, or at a series' beginning
    takes the first wrist's. A frame that opposes the jaw of the one before is turned half
    round its up axis; as each sign depends on the one before only, the signs are the parity
    of the opposed neighbours so far, counted anew after two jaws at right angles.
    """
    c = F.col(points)
    w = Window.partitionBy(*by).orderBy(order)
    before, now = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    along, side = minus(point(c, "palm"), point(c, "wrist")), minus(point(c, "index_mcp"), point(c, "middle_mcp"))
    raw = _with(df, _p=mode.position(c), _j=mode.jaw(c, F.col(right)), _f=mode.forward(c), _l=along, _s=side)
    raw = raw.withColumns({"_jn": norm(_col("_j")), "_fn": norm(_col("_f")), "_ln": norm(_col("_l"))})
    over = lambda name, n: tuple(x / F.nullif(F.col(n), F.lit(0.0)) for x in _col(name))
    raw = _with(raw, _u=over("_j", "_jn"), _l=over("_l", "_ln"))
    raw = raw.withColumn("_a", dot(_col("_f"), _col("_u")))
    raw = _with(raw, _c=tuple(f - F.col("_a") * u for f, u in zip(_col("_f"), _col("_u"), strict=True)), _w=cross(_col("_l"), _col("_s")))
    raw = raw.withColumns({"_cn": norm(_col("_c")), "_wn": norm(_col("_w"))})
    raw = _with(raw, _c=over("_c", "_cn"), _w=over("_w", "_wn"))
    spans = F.coalesce((F.col("_jn") > 1e-8) & (F.col("_fn") >= 1e-5) & (F.col("_cn") > 1e-8), F.lit(False))
    raw = raw.withColumns({"_own": spans, "_wrist": F.coalesce((F.col("_ln") >= 1e-6) & (F.col("_wn") >= 1e-6), F.lit(False))})
    raw = _with(raw, _up=cross(_col("_u"), _col("_c")), _z=cross(_col("_w"), _col("_l")))
    raw = raw.withColumns({"_jaw": F.when(F.col("_own"), F.array(*_col("_u"))), "_wr": F.when(F.col("_wrist"), F.array(F.array(*_col("_w")), F.array(*cross(_col("_z"), _col("_w"))), F.array(*_col("_z"))))})
    raw = raw.withColumn("_b", F.coalesce(F.last("_jaw", ignorenulls=True).over(before), F.get(F.first("_wr", ignorenulls=True).over(before), 0)))
    raw = raw.withColumn("_d", F.when(F.col("_own") & F.col("_b").isNotNull(), dot(tuple(F.get("_b", k) for k in range(3)), _col("_u"))))
    raw = raw.withColumn("_part", F.sum(F.when(F.col("_d") == 0, 1).otherwise(0)).over(now))
    flips = F.sum(F.when(F.col("_d") < 0, 1).otherwise(0)).over(Window.partitionBy(*by, "_part").orderBy(order))
    raw = raw.withColumn("_sign", F.when(F.pmod(flips, F.lit(2)) == 1, -1.0).otherwise(1.0))
    turned = lambda name: F.array(*[F.col("_sign") * v for v in _col(name)])
    raw = raw.withColumn("_frame", F.when(F.col("_own"), F.array(turned("_u"), turned("_c"), F.array(*_col("_up")))))
    axes = F.coalesce(F.last("_frame", ignorenulls=True).over(now), F.first("_wr", ignorenulls=True).over(now))
    return raw.select(*df.columns, F.array(*_col("_p")).alias("position"), axes.alias("axes"))
