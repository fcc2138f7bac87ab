"""Scalar conversions: grippers, grasp ratios, normalisation, identifiers, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import Vector, clipped, norm


def gripper_share(raw: Column, open_raw: float, closed_raw: float) -> Column:
    """0 at open_raw, 1 at closed_raw, linear between and clipped."""
    return clipped((raw - open_raw) / (closed_raw - open_raw), 0.0, 1.0)


def gripper_closed(raw: Column, threshold: float = -2.6) -> Column:
    """1 (closed) from the threshold on."""
    return F.when(raw >= threshold, 1).otherwise(0)


def grasp_ratio(tips: Vector, palm: Vector, least: float = 0.01) -> Column:
    """Distance of the finger tips over the palm's size; null for a palm of `least` or less."""
    size = norm(palm)
    return F.when(size > least, norm(tips) / size)


def standardised(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / (std + 1e-8)


def from_quantiles(a: Column, low: Column, high: Column) -> Column:
    """-1 to 1 back to the range between two quantiles."""
    return (a + 1) / 2 * (high - low + 1e-6) + low


def reprojection_confidence(error_share: Column) -> Column:
    """Logistic in the error's share of the image diagonal, within 0.05 and 0.99."""
    return clipped(1 / (1 + F.exp(200 * (error_share - 0.025))), 0.05, 0.99)


# Short names of corrections; `none` adds nothing, any other its own name.
CORRECTION_NAMES = {"xyz_mean_target_min_bending": "xyz", "xyz_mean_target_min_bending_all_anchors": "xyz_all"}


def short_variant(hand: Column, correction: Column | None = None) -> Column:
    """A variant's name without the hysteresis suffix, and its correction's short name behind a plus sign."""
    name = F.regexp_replace(hand, "_hys085$", "")
    if correction is None:
        return name
    short = F.coalesce(correction, F.lit("none"))
    for long, brief in CORRECTION_NAMES.items():
        short = F.when(short == long, brief).otherwise(short)
    return F.when(short == "none", name).otherwise(F.concat(name, F.lit("+"), short))


def checked_vector(values: Column, width: int, name: str = "vector") -> Column:
    """The first `width` values; fewer, a null or one that is not finite is an error."""
    part = F.slice(values, 1, width)
    ok = (F.size(part) == width) & F.forall(part, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(F.coalesce(ok, F.lit(False)), part).otherwise(F.raise_error(F.lit(f"{name}: not {width} finite values")).cast("array<double>"))


def policy_input(state: Column, actions: Column, mask: Column, images: list[Column], width: int = 16) -> Column:
    """A sample for a policy: state and actions of `width` finite values, the mask of [head, left, right] cameras, and their images, blank where masked.

    The head camera must be there, and the mask must have three places.
    """
    sound = F.coalesce((F.size(mask) == 3) & F.get(mask, 0), F.lit(False))
    flags = F.when(sound, mask).otherwise(F.raise_error(F.lit("the head camera must be there, in a mask of three")).cast("array<boolean>"))
    blank = lambda k, image: F.when(F.get(flags, k), image).otherwise(F.transform(image, lambda x: x * 0))
    return F.struct(checked_vector(state, width, "state").alias("state"), checked_vector(actions, width, "actions").alias("actions"), flags.alias("mask"), *[blank(k, image).alias(f"image_{k}") for k, image in enumerate(images)])


def column_of(names: list[str], wanted: list[str], values: Column) -> Column:
    """The values at the places of the wanted names, in their order; a name that is missing is an error at once."""
    if missing := [n for n in wanted if n not in names]:
        raise ValueError(f"no column named {', '.join(missing)}")
    return F.array(*[F.get(values, names.index(n)) for n in wanted])


def first_name(*candidates: Column) -> Column:
    """The first of several names that is neither null nor empty; none is an error."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.raise_error(F.lit("no frame name")).cast("string"))


def first_valid(*poses: Column) -> Column:
    """The first of several 4x4 matrices (arrays of arrays) that has that shape and finite values only; null if none has."""

    def sound(m: Column) -> Column:
        rows = F.forall(m, lambda r: (F.size(r) == 4) & F.forall(r, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
        return F.coalesce((F.size(m) == 4) & rows, F.lit(False))

    return F.coalesce(*[F.when(sound(m), m) for m in poses])


def id_list(spec: Column) -> Column:
    """`0,3,10:15` or `8-11` as the array of ids, ends included; a falling range is an error."""
    parts = F.transform(F.split(spec, ","), lambda s: F.split(F.trim(s), "[:-]"))
    one = lambda p: F.sequence(p[0].cast("long"), F.element_at(p, -1).cast("long"), F.lit(1).cast("long"))
    return F.flatten(F.transform(parts, one))


def frames_per_second(n: Column, seconds: Column) -> Column:
    """(n - 1) / seconds, halves up; 10 for fewer than two frames."""
    return F.when(n < 2, 10.0).otherwise(F.round((n - 1) / seconds))


def arm_masked(values: Column, active: list[bool], fill: float = 0.0) -> Column:
    """A feature vector whose inactive places hold `fill`."""
    flags = F.array(*[F.lit(a) for a in active])
    return F.transform(values, lambda x, i: F.when(F.get(flags, i), x).otherwise(F.lit(fill)))


def stable_seed(base: int, *parts: Column) -> Column:
    """A seed (decimal text) from sha256 of base and parts, joined by bars: the first eight bytes, little-endian."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(base)), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.concat(*[F.substring(digest, 2 * k + 1, 2) for k in range(7, -1, -1)]), 16, 10)
