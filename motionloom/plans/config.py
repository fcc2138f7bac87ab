"""Driver-side metadata: configuration, argument lists, run products, transforms, seeds."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterable, Iterator, Mapping
from pathlib import Path

import numpy as np


def merged(base: Mapping, update: Mapping) -> dict:
    """A deep copy of base with update's values; nested mappings merge, all else is replaced."""
    out = dict(base)
    for key, value in update.items():
        both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
        out[key] = merged(out[key], value) if both else value
    return out


def fingerprint(value: object) -> str:
    """sha256 of canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def names(spec: str, known: Iterable[str]) -> list[str]:
    """A comma list of known names, or `all`, in the known order."""
    known = list(known)
    wanted = known if spec.strip() == "all" else [x.strip() for x in spec.split(",") if x.strip()]
    if unknown := [x for x in wanted if x not in known]:
        raise ValueError(f"unknown: {', '.join(unknown)}")
    return [x for x in known if x in wanted]


def segment(spec: str) -> tuple[int | str | None, int | str | None]:
    """START:END, each an event's ordinal, `first` or `last` (event), or blank for the series' own end."""
    ends = spec.split(":")
    if len(ends) != 2:
        raise ValueError("a segment is START:END")
    start, end = (x if x in ("first", "last") else int(x) if x else None for x in map(str.strip, ends))
    return start, end


def run_product(first: Mapping[str, object], second: Mapping[str, object], runs: list[Mapping] | None = None) -> list[dict]:
    """Named runs of two option tables: those listed, or every pair; ids are unique, unknown names an error."""
    runs = runs or [{"first": a, "second": b} for a, b in itertools.product(first, second)]
    out, seen = [], set()
    for run in runs:
        a, b = run["first"], run["second"]
        if a not in first or b not in second:
            raise ValueError(f"unknown option in {a}, {b}")
        name = run.get("id", f"{a}+{b}")
        if name in seen:
            raise ValueError(f"two runs named {name}")
        seen.add(name)
        out.append({"id": name, "first": first[a], "second": second[b]})
    return out


def trajectory_options(raw: Mapping) -> dict:
    """arm_mode (single, dual) with as many sides, trims finite and not negative."""
    mode, sides = raw.get("arm_mode", "dual"), list(raw.get("sides", ["left", "right"]))
    if (mode == "single") != (len(sides) == 1) or mode not in ("single", "dual") or not set(sides) <= {"left", "right"}:
        raise ValueError("arm_mode and sides disagree")
    trims = {k: float(raw.get(k, 0.0)) for k in ("trim_start_s", "trim_end_s")}
    if any(not np.isfinite(v) or v < 0 for v in trims.values()):
        raise ValueError("trims must be finite and not negative")
    return {"arm_mode": mode, "sides": sides, **trims}


def _lists(value: object) -> Iterator[tuple[str, list]]:
    """(key, list) of all lists in nested mappings and lists."""
    open_ = [("", value)]
    while open_:
        key, x = open_.pop()
        if isinstance(x, list):
            yield key, x
        inner = x.items() if isinstance(x, Mapping) else (("", y) for y in x) if isinstance(x, list) else ()
        open_ += [(str(k), y) for k, y in inner]


def leaked(value: object, held_out: set[str]) -> set[str]:
    """Held-out ids in any list whose key speaks of calibration episodes (or is `calibration`) and not of ego."""
    speaks = re.compile(r"(?!.*ego)(?:calibration$|.*calibration.*episode|.*episode.*calibration)", re.IGNORECASE)
    return held_out.intersection(str(x) for key, ids in _lists(value) if speaks.match(key) for x in ids)


def first_existing(candidates: Iterable[str | Path]) -> Path:
    """The first of several places that exists."""
    tried = [Path(c) for c in candidates]
    for path in tried:
        if path.exists():
            return path
    raise FileNotFoundError(", ".join(map(str, tried)))


def intrinsics(calibration: Mapping, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """K and distortion of the profile of exactly this size; nothing is rescaled."""
    profile = calibration["profiles"].get(f"{width}x{height}")
    if profile is None:
        raise ValueError(f"no profile for {width}x{height}")
    return np.array(profile["K"], float).reshape(3, 3), np.array(profile["d"], float)


def camera_in_output(tool_in_arm: np.ndarray, camera_in_arm: np.ndarray) -> np.ndarray:
    return np.linalg.inv(tool_in_arm) @ camera_in_arm


def stable_seed(base: int, *parts: object) -> int:
    """A seed from sha256 of base and parts: the first eight bytes, little-endian."""
    text = "|".join(map(str, (base, *parts)))
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")


def sampled_target(mean: np.ndarray, covariance: np.ndarray, mode: str, seed: int, most: float, tries: int = 1000) -> np.ndarray:
    """The mean, or the first of `tries` draws within `most` Mahalanobis units of it; 0 or less means any."""
    mean = np.asarray(mean, float)
    if mode == "mean":
        return mean
    draws = np.random.default_rng(seed).multivariate_normal(mean, covariance, size=tries)
    far = np.einsum("ij,jk,ik->i", draws - mean, np.linalg.pinv(covariance), draws - mean)
    near = np.flatnonzero(np.full(tries, most <= 0) | (np.sqrt(np.maximum(far, 0)) <= most))
    if not len(near):
        raise ValueError(f"none of {tries} draws within {most}")
    return draws[near[0]]


def plain(value: object) -> object:
    """NumPy values, paths and tuples as what JSON knows, keys as text."""
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (np.ndarray, np.generic)):
        return plain(value.tolist())
    return str(value) if isinstance(value, Path) else value


def ratio_split(ids: Iterable[int], share: float, seed: int, name: str) -> tuple[set[int], set[int]]:
    """(train, eval) of episode ids, shuffled by seed and the name's characters; neither is empty."""
    if not 0 < share < 1:
        raise ValueError("the share must lie between 0 and 1")
    values = np.array(sorted(ids), np.int64)
    np.random.default_rng(seed + sum(map(ord, name))).shuffle(values)
    n = min(max(1, round(len(values) * share)), len(values) - 1)
    return set(values[:n].tolist()), set(values[n:].tolist())


def checked_split(train: set[int], held_out: set[int], ids: set[int]) -> tuple[set[int], set[int]]:
    """A split given by hand or by an artifact, which must part the ids."""
    if train & held_out or train | held_out != ids:
        raise ValueError(f"the split does not part the ids {sorted(ids)}")
    return train, held_out
