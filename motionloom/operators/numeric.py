"""Grouped numerics that no window can express: alignment, propagation, recurrences.

Each is a NumPy function of one series or pair and a grouped Arrow-batched plan around
it. A group is one trajectory, or one pair of resampled trajectories, so its size does
not grow with the data.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def dtw(a: np.ndarray, b: np.ndarray, window_ratio: float | None = None) -> tuple[float, np.ndarray]:
    """(cost, path): dynamic time warping of two point series, cost over (n + m) / 2.

    Costs are filled by anti-diagonals. Steps are diagonal, up and left, and the path back
    prefers them in that order. A band, if any, is centred on round(i * m / n), i from 1.
    """
    n, m = len(a), len(b)
    if n < 2 or m < 2:
        raise ValueError("two points at least are needed on either side")
    cost = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    if window_ratio is not None:
        reach = max(abs(n - m), int(np.ceil(window_ratio * max(n, m))))
        centre = np.rint(np.arange(1, n + 1) * m / n)
        cost = np.where(np.abs(np.arange(1, m + 1)[None, :] - centre[:, None]) <= reach, cost, np.inf)
    total = np.full((n + 1, m + 1), np.inf)
    total[0, 0] = 0.0
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        j = s - i
        total[i, j] = cost[i - 1, j - 1] + np.minimum(np.minimum(total[i - 1, j - 1], total[i - 1, j]), total[i, j - 1])
    i, j, path = n, m, []
    while i > 0 and j > 0:
        path.append((i - 1, j - 1))
        step = int(np.argmin([total[i - 1, j - 1], total[i - 1, j], total[i, j - 1]]))
        i, j = (i - 1, j - 1) if step == 0 else (i - 1, j) if step == 1 else (i, j - 1)
    return float(total[n, m] / ((n + m) / 2)), np.array(path[::-1])


def pair_distances(pa: np.ndarray, qa: np.ndarray, pb: np.ndarray, qb: np.ndarray, window_ratio: float | None = None) -> dict:
    """d_pos: alignment cost; d_rot: mean angle in degrees on its path; d_shape: cost without the centroids;

    offset: the sum of q q^T of the rotations from b to a on the path, row by row; n_path its length.
    """
    d_pos, path = dtw(pa, pb, window_ratio)
    a, b = qa[path[:, 0]], qb[path[:, 1]]
    d_rot = float(np.degrees(2 * np.arccos(np.minimum(1.0, np.abs((a * b).sum(axis=1))))).mean())
    d_shape, _ = dtw(pa - pa.mean(axis=0), pb - pb.mean(axis=0), window_ratio)
    v, w = a[:, :3], a[:, 3:]
    u, s = -b[:, :3], b[:, 3:]  # the inverse of b
    q = np.concatenate([s * v + w * u + np.cross(u, v), s * w - (u * v).sum(axis=1, keepdims=True)], axis=1)
    return {"d_pos": d_pos, "d_rot": d_rot, "d_shape": d_shape, "n_path": len(path), "offset": (q.T @ q).ravel().tolist()}


def align_pairs(pairs: DataFrame, window_ratio: float | None = None) -> DataFrame:
    """(a, b, d_pos, d_rot, d_shape, n_path, offset) of pairs (a, b, pose_a, pose_b), poses being arrays of 7 numbers.

    A pair that can't be aligned has nulls: failures are data.
    """
    columns = ["d_pos", "d_rot", "d_shape", "n_path", "offset"]

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                x, y = (np.array([list(p) for p in s], float).reshape(-1, 7) for s in (row.pose_a, row.pose_b))
                try:
                    d = pair_distances(x[:, :3], x[:, 3:], y[:, :3], y[:, 3:], window_ratio)
                except ValueError:
                    d = dict.fromkeys(columns)
                rows.append({"a": row.a, "b": row.b, **d})
            yield pd.DataFrame(rows, columns=["a", "b", *columns]).astype({"n_path": "Int64"})

    return pairs.select("a", "b", "pose_a", "pose_b").mapInPandas(run, "a long, b long, d_pos double, d_rot double, d_shape double, n_path long, offset array<double>")


def mean_rotations(sums: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, qx, qy, qz, qw): the chordal mean of each group from its count n and sum `s` of q q^T (16 numbers).

    Sums come from a shuffled aggregation; only the 4x4 eigenproblem is NumPy.
    """

    def run(batches):
        for pdf in batches:
            out = pdf[[*by, "n"]].copy()
            found = [np.linalg.eigh(np.array(s, float).reshape(4, 4))[1][:, -1] for s in pdf["s"]]
            for k, c in enumerate(("qx", "qy", "qz", "qw")):
                out[c] = [float(-q[k] if q[3] < 0 else q[k]) for q in found]
            yield out

    kinds = ", ".join(f"`{c}` {t}" for c, t in sums.select(*by).dtypes)
    return sums.select(*by, "n", "s").mapInPandas(run, f"{kinds}{', ' if by else ''}n long, qx double, qy double, qz double, qw double")


def _pentadiagonal(main: np.ndarray, next_: np.ndarray, second: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of a symmetric system with five diagonals, by an L D L^T factorisation; linear in its size."""
    n = len(main)
    d, l1, l2 = np.zeros(n), np.zeros(n), np.zeros(n)
    z = np.array(right, float)
    for i in range(n):
        d[i] = main[i] - (d[i - 1] * l1[i - 1] ** 2 if i else 0) - (d[i - 2] * l2[i - 2] ** 2 if i > 1 else 0)
        if i + 1 < n:
            l1[i] = (next_[i] - (d[i - 1] * l1[i - 1] * l2[i - 1] if i else 0)) / d[i]
        if i + 2 < n:
            l2[i] = second[i] / d[i]
        z[i] -= (l1[i - 1] * z[i - 1] if i else 0) + (l2[i - 2] * z[i - 2] if i > 1 else 0)
    z /= d[:, None]
    for i in range(n - 2, -1, -1):
        z[i] -= l1[i] * z[i + 1] + (l2[i] * z[i + 2] if i + 2 < n else 0)
    return z


def _bending(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three upper diagonals of the sum of squared second differences."""
    main, next_, second = np.zeros(n), np.zeros(max(0, n - 1)), np.ones(max(0, n - 2))
    for k, (w, v) in enumerate(((1, -2), (4, -2), (1, 0))):
        if n > 2:
            main[k : n - 2 + k] += w
            if k < 2:
                next_[k : n - 2 + k] += v
    return main, next_, second


def propagate(n: int, frames: list[int], values: np.ndarray, method: str = "linear", end_weight: float = 1.0, anchor_weight: float = 1.0, bend: float = 100.0, magnitude: float = 1e-3) -> np.ndarray:
    """Anchor values over n frames; both ends are zero unless they are anchors.

    linear joins the anchors by lines; min_bending keeps them and has the least second
    differences; smooth_spline has the least sum of weighted misfit (the ends' weight, or
    the anchors'), bending and magnitude. Two values for one frame are an error.
    """
    values = np.asarray(values, float)
    values = values if values.ndim == 2 else values.reshape(len(frames), 1)
    control: dict[int, np.ndarray] = {}
    for f, v in zip(frames, values, strict=True):
        if f in control and not np.allclose(control[f], v, atol=1e-10):
            raise ValueError(f"two values for frame {f}")
        control[f] = v
    control = {0: np.zeros(values.shape[1]), n - 1: np.zeros(values.shape[1])} | control
    at = np.array(sorted(control))
    points = np.array([control[f] for f in at])
    if method not in ("linear", "min_bending", "smooth_spline"):
        raise ValueError(f"no method {method}")
    if method == "linear" or method == "min_bending" and (n <= 2 or len(at) >= n):
        return np.stack([np.interp(np.arange(n), at, points[:, k]) for k in range(points.shape[1])], axis=1)
    main, next_, second = _bending(n)
    if method == "smooth_spline":
        weight = np.zeros(n)
        weight[at] = np.where((at == 0) | (at == n - 1), end_weight, anchor_weight)
        target = np.zeros((n, points.shape[1]))
        target[at] = weight[at, None] * points
        return _pentadiagonal(weight + bend * main + max(magnitude, 1e-12), bend * next_, bend * second, target)
    free = np.setdiff1d(np.arange(n), at)
    out = np.zeros((n, points.shape[1]))
    out[at] = points
    pull = main[:, None] * out  # the bending's gradient at the anchors' values
    pull[:-1] += next_[:, None] * out[1:]
    pull[1:] += next_[:, None] * out[:-1]
    pull[:-2] += second[:, None] * out[2:]
    pull[2:] += second[:, None] * out[:-2]
    # Among the free frames two are neighbours in the system if they are one or two apart.
    gap1, gap2 = np.diff(free), free[2:] - free[:-2]
    near = np.where(gap1 == 1, next_[np.minimum(free[:-1], n - 2)], np.where(gap1 == 2, second[np.minimum(free[:-1], n - 3)], 0.0))
    far = np.where(gap2 == 2, second[np.minimum(free[:-2], n - 3)], 0.0)
    out[free] = _pentadiagonal(main[free] + 1e-12, near, far, -pull[free])
    return out


def debounced(states: list[int | None], least: int) -> list[int | None]:
    """The first inner run shorter than `least` joins the run before it, again and again; nulls are skipped.

    A run that has joined is long enough, and none before it changes, so one pass does.
    """
    known = [k for k, s in enumerate(states) if s is not None]
    if least <= 1 or len(known) < 3:
        return list(states)
    runs = [(s, len(list(g))) for s, g in itertools.groupby(states[k] for k in known)]
    stack: list[list[int]] = []
    for k, (state, length) in enumerate(runs):
        if stack and (stack[-1][0] == state or 0 < k < len(runs) - 1 and length < least):
            stack[-1][1] += length
        else:
            stack.append([state, length])
    out: list[int | None] = list(states)
    for k, s in zip(known, (s for s, n in stack for _ in range(n)), strict=True):
        out[k] = s
    return out


def limited(values: np.ndarray, valid: np.ndarray, step: float) -> np.ndarray:
    """Each row at most `step` from the limited row before it; starts anew after an invalid row."""
    out, last = values.astype(float).copy(), None
    for k in range(len(out)):
        if not valid[k]:
            last = None
            continue
        if last is not None and step > 0:
            move = out[k] - last
            size = float(np.linalg.norm(move))
            if size > step:
                out[k] = last + move * (step / size)
        last = out[k]
    return out


def turned(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """The unit quaternion a share of the shorter way from a to b."""
    d = float(a @ b)
    b, d = (-b, -d) if d < 0 else (b, d)
    angle = np.arccos(min(1.0, d))
    if np.sin(angle) < 1e-9:
        return b if share >= 0.5 else a
    return (np.sin((1 - share) * angle) * a + np.sin(share * angle) * b) / np.sin(angle)


def limited_poses(positions: np.ndarray, quaternions: np.ndarray, valid: np.ndarray, step: float, turn: float) -> tuple[np.ndarray, np.ndarray]:
    """Each pose at most `step` away and `turn` (radians) turned from the limited one before it; starts anew after an invalid row.

    A limit of 0 or less is none.
    """
    p, q = limited(positions, valid, step), quaternions.astype(float).copy()
    for k in range(1, len(q)):
        if turn > 0 and valid[k] and valid[k - 1]:
            angle = 2 * np.arccos(min(1.0, abs(float(q[k - 1] @ q[k]))))
            if angle > turn:
                q[k] = turned(q[k - 1], q[k], turn / angle)
    return p, q


def smoothed_units(vectors: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential mean of unit vectors, each turned to the side of the mean so far."""
    out = np.empty_like(vectors, dtype=float)
    mean = None
    for k, v in enumerate(vectors):
        v = v / (float(np.linalg.norm(v)) + 1e-6)
        if mean is not None:
            v = -v if float(v @ mean) < 0 else v
            v = alpha * v + (1 - alpha) * mean
            v = v / (float(np.linalg.norm(v)) + 1e-6)
        out[k] = mean = v
    return out


def smoothed_frames(x: np.ndarray, y: np.ndarray, alpha_x: float, alpha_y: float) -> np.ndarray:
    """Rotation matrices, axes as columns, from exponential means of two axes, made orthogonal: x stays, z = x cross y, y = z cross x."""
    x, y = smoothed_units(x, alpha_x), smoothed_units(y, alpha_y)
    z = np.cross(x, y)
    z = z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-6)
    return np.stack([x, np.cross(z, x), z], axis=2)


def filled_gaps(values: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Rows that are not valid become linear between valid ones and hold the outermost ones; zeros if none is valid."""
    known = np.flatnonzero(valid)
    if not len(known):
        return np.zeros_like(values, dtype=float)
    return np.interp(np.arange(len(values)), known, np.asarray(values, float)[known])


def approach(start: np.ndarray, target: np.ndarray, step: float, most_total: float | None = None, most_steps: int = 1000, reachable=None) -> np.ndarray:
    """Even joint steps from start (left out) to target, none of which moves a joint by more than `step`.

    reachable(before, after) may refuse a step, for what only kinematics can tell; then the
    number of steps doubles, up to most_steps. Nothing to do gives no steps; a total
    change of over most_total, or too many steps, is an error.
    """
    start, target = np.asarray(start, float), np.asarray(target, float)
    change = float(np.abs(target - start).max())
    if change <= 1e-8:
        return np.zeros((0, len(start)))
    if most_total is not None and change > most_total:
        raise ValueError(f"a joint would move by {change:.4f}, over {most_total:.4f}")
    steps = max(1, int(np.ceil(change / step)))
    while steps <= most_steps:
        share = np.arange(1, steps + 1)[:, None] / steps
        path = (1 - share) * start + share * target
        if reachable is None or all(reachable(a, b) for a, b in zip([start, *path[:-1]], path, strict=True)):
            return path
        steps *= 2
    raise ValueError(f"no approach within {most_steps} steps")


def savitzky_golay(values: np.ndarray, window: int, degree: int = 2) -> np.ndarray:
    """Polynomial smoothing over an odd window of n points at most; the ends follow the outermost fits."""
    n = len(values)
    window = min(window, n if n % 2 else n - 1)
    if window < 5:
        return np.nan_to_num(values.astype(float))
    degree, half = min(degree, window - 1), window // 2
    x = np.arange(-half, half + 1, dtype=float)
    fit = np.linalg.pinv(np.vander(x, degree + 1, increasing=True))
    out = np.convolve(values, fit[0][::-1], mode="same")
    for side, block in ((slice(0, half), values[:window]), (slice(n - half, n), values[n - window :])):
        at = x[:half] if side.start == 0 else x[half + 1 :]
        out[side] = np.vander(at, degree + 1, increasing=True) @ (fit @ block)
    return out


def mean_rotation(quaternions: np.ndarray) -> np.ndarray:
    """The chordal mean: the top eigenvector of the sum of q q^T, with a non-negative last part."""
    _, vector = np.linalg.eigh(quaternions.T @ quaternions)
    q = vector[:, -1]
    return -q if q[3] < 0 else q


def flipped_short_runs(states: list[int], most: int) -> list[int]:
    """Inner runs of up to `most` rows between equal neighbours flip, in one scan that sees its own changes."""
    out, k = list(states), 0
    while k < len(out):
        end = k
        while end + 1 < len(out) and out[end + 1] == out[k]:
            end += 1
        if k > 0 and end + 1 < len(out) and end - k + 1 <= most and out[k - 1] == out[end + 1]:
            out[k : end + 1] = [out[k - 1]] * (end - k + 1)
        k = end + 1
    return out


def grasp_by_distance(distance: np.ndarray, threshold: float, size: int, most: int) -> list[int]:
    """Distances interpolated, averaged over a window with the ends repeated, compared, and short flips undone."""
    x = np.asarray(distance, float)
    known = np.flatnonzero(np.isfinite(x))
    if not len(known):
        return [0] * len(x)
    x = np.interp(np.arange(len(x)), known, x[known])
    padded = np.pad(x, (size // 2, size - 1 - size // 2), mode="edge")
    mean = np.convolve(padded, np.ones(size) / size, mode="valid")
    return flipped_short_runs((mean < threshold).astype(int).tolist(), most)


def grasp_by_state(states: list[int | None], size: int, most: int) -> list[int]:
    """States (missing ones open) averaged over a reflected window, cut at a half; short open, then short closed runs flip."""
    x = np.array([0 if s is None else s for s in states], float)
    if not len(x):
        return []
    padded = np.pad(x, (size // 2, size - 1 - size // 2), mode="symmetric") if len(x) >= size else np.pad(x, (size // 2, size - 1 - size // 2), mode="edge")
    out = (np.convolve(padded, np.ones(size) / size, mode="valid") > 0.5).astype(int).tolist()
    for value in (0, 1):
        k = 0
        while k < len(out):
            end = k
            while end + 1 < len(out) and out[end + 1] == out[k]:
                end += 1
            if out[k] == value and k > 0 and end + 1 < len(out) and end - k + 1 <= most:
                out[k : end + 1] = [1 - value] * (end - k + 1)
            k = end + 1
    return out


def per_series(df: DataFrame, by: list[str], order: str, columns: list[str], function, out: str, out_type: str) -> DataFrame:
    """A function of a series' columns (as arrays, in order) gives column `out`, row for row."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*by, order).dtypes) + f", {out} {out_type}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        result = pdf[[*by, order]].copy()
        result[out] = list(function(*[pdf[c].to_numpy() for c in columns]))
        return result

    return df.select(*by, order, *columns).groupBy(*by).applyInPandas(run, schema)
