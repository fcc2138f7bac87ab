"""SQL text of vector and sequence formulas, for oracles; a vector is a tuple of SQL expressions."""

from __future__ import annotations

W = "(PARTITION BY episode_id ORDER BY frame_idx)"


def named(*names: str) -> tuple[str, ...]:
    return names


def sub(a, b):
    return tuple(f"({x} - {y})" for x, y in zip(a, b, strict=True))


def add(a, b):
    return tuple(f"({x} + {y})" for x, y in zip(a, b, strict=True))


def scale(k, a):
    return tuple(f"({k} * {x})" for x in a)


def dot(a, b):
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def norm(a):
    return f"sqrt({dot(a, a)})"


def cross(a, b):
    return (f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})")


def mean(*points):
    return tuple("((" + " + ".join(xs) + f") / {len(points)})" for xs in zip(*points, strict=True))


def turn_matrix(q):
    """The nine numbers of a unit quaternion's matrix, row by row."""
    x, y, z, w = q
    return (
        f"(1 - 2 * ({y} * {y} + {z} * {z}))", f"(2 * ({x} * {y} - {z} * {w}))", f"(2 * ({x} * {z} + {y} * {w}))",
        f"(2 * ({x} * {y} + {z} * {w}))", f"(1 - 2 * ({x} * {x} + {z} * {z}))", f"(2 * ({y} * {z} - {x} * {w}))",
        f"(2 * ({x} * {z} - {y} * {w}))", f"(2 * ({y} * {z} + {x} * {w}))", f"(1 - 2 * ({x} * {x} + {y} * {y}))",
    )


def rotated(q, v):
    m = turn_matrix(q)
    return tuple(dot(m[3 * i : 3 * i + 3], v) for i in range(3))


def back_rotated(q, v):
    m = turn_matrix(q)
    return tuple(dot((m[i], m[3 + i], m[6 + i]), v) for i in range(3))


def times(a, b):
    """The quaternion product."""
    return (
        f"({a[3]} * {b[0]} + {a[0]} * {b[3]} + {a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[3]} * {b[1]} - {a[0]} * {b[2]} + {a[1]} * {b[3]} + {a[2]} * {b[0]})",
        f"({a[3]} * {b[2]} + {a[0]} * {b[1]} - {a[1]} * {b[0]} + {a[2]} * {b[3]})", f"({a[3]} * {b[3]} - {a[0]} * {b[0]} - {a[1]} * {b[1]} - {a[2]} * {b[2]})",
    )


def inverse(q):
    return (f"(-({q[0]}))", f"(-({q[1]}))", f"(-({q[2]}))", q[3])


def between(a, b, share):
    """Spherical interpolation, the short way round."""
    d = dot(a, b)
    angle = f"acos(least(1.0, abs({d})))"
    flip = f"(CASE WHEN {d} < 0 THEN -1.0 ELSE 1.0 END)"
    p = f"(CASE WHEN sin({angle}) > 1e-9 THEN sin((1 - {share}) * {angle}) / sin({angle}) ELSE 1 - {share} END)"
    q = f"(CASE WHEN sin({angle}) > 1e-9 THEN sin({share} * {angle}) / sin({angle}) ELSE {share} END)"
    return tuple(f"({p} * {x} + {q} * {flip} * {y})" for x, y in zip(a, b, strict=True))


def degrees_between(a, b):
    return f"degrees(2 * acos(least(1.0, abs({dot(a, b)}))))"


def rounded(values, names, digits=6):
    return ", ".join(f"round({v}, {digits}) + 0 AS {n}" for v, n in zip(values, names.split(), strict=True))


class Chain:
    """CTEs over a series table (episode_id, frame_idx, ...), each on the one before; `of` names the last one."""

    def __init__(self, of: str) -> None:
        self.of, self.parts, self.n = of, [], 0

    def step(self, sql: str) -> Chain:
        """sql has {of} for the table before."""
        self.n += 1
        name = f"chain{self.n}"
        self.parts.append(f"{name} AS ({sql.format(of=self.of)})")
        self.of = name
        return self

    def runs(self, value: str) -> Chain:
        """Adds run, run_length, run_row and last_run of equal values."""
        drop = "" if not any("run_length" in p for p in self.parts) else " EXCLUDE (ch, run, run_length, run_row, last_run)"
        self.step(f"SELECT *{drop}, CASE WHEN row_number() OVER {W} > 1 AND lag({value}) OVER {W} IS NOT DISTINCT FROM {value} THEN 0 ELSE 1 END AS ch FROM {{of}}")
        self.step(f"SELECT *, sum(ch) OVER {W} AS run FROM {{of}}")
        return self.step("SELECT *, count(*) OVER (PARTITION BY episode_id, run) AS run_length, row_number() OVER (PARTITION BY episode_id, run ORDER BY frame_idx) AS run_row, max(run) OVER (PARTITION BY episode_id) AS last_run FROM {of}")

    def replaced(self, value: str, new: str) -> Chain:
        return self.step(f"SELECT * REPLACE (({new}) AS {value}) FROM {{of}}")

    def filled(self, mask: str, most: int) -> Chain:
        return self.runs(mask).replaced(mask, f"{mask} OR (run_length <= {most} AND run > 1 AND run < last_run)")

    def dropped(self, mask: str, most: int) -> Chain:
        return self.runs(mask).replaced(mask, f"{mask} AND run_length > {most}")

    def closed(self, mask: str, size: int) -> Chain:
        a, b = size // 2, size - 1 - size // 2
        over = lambda f, x, y: f"{f}({mask}) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN {x} PRECEDING AND {y} FOLLOWING)"
        return self.replaced(mask, over("bool_or", a, b)).replaced(mask, over("bool_and", b, a))

    def vetoed(self, mask: str, yaw: str, least: int, veto: float) -> Chain:
        q = "(PARTITION BY episode_id, run ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        return self.dropped(mask, least - 1).runs(mask).replaced(mask, f"{mask} AND NOT abs(last_value({yaw}) OVER {q} - first_value({yaw}) OVER {q}) >= {veto}")

    def delayed(self, mask: str, rows: int) -> Chain:
        return self.runs(mask).replaced(mask, f"{mask} AND run_row > {rows}")

    def median(self, value: str, size: int) -> Chain:
        half = size // 2
        self.step("SELECT *, count(*) OVER (PARTITION BY episode_id) AS cnt FROM {of}" if "cnt" not in " ".join(self.parts) else "SELECT * FROM {of}")
        return self.step(f"""SELECT a.* REPLACE (m.v AS {value}) FROM {{of}} a JOIN (SELECT x.episode_id, x.frame_idx, quantile_disc(y.{value}, 0.5) AS v FROM {{of}} x
               CROSS JOIN (SELECT unnest(range(-{half}, {half} + 1)) AS d) JOIN {{of}} y ON x.episode_id = y.episode_id AND y.frame_idx = least(greatest(x.frame_idx + d, 0), x.cnt - 1)
               GROUP BY x.episode_id, x.frame_idx) m ON a.episode_id = m.episode_id AND a.frame_idx = m.frame_idx""")

    def merged(self, value: str, least: int) -> Chain:
        self.runs(value)
        return self.step(f"""SELECT a.* REPLACE (CASE WHEN run_length < {least} THEN h.other ELSE a.{value} END AS {value}) FROM {{of}} a JOIN (SELECT episode_id AS e, run AS r, coalesce(lead(own) OVER q, lag(own) OVER q, own) AS other
               FROM (SELECT episode_id, run, min({value}) AS own FROM {{of}} GROUP BY episode_id, run) WINDOW q AS (PARTITION BY episode_id ORDER BY run)) h ON a.episode_id = h.e AND a.run = h.r""")

    def modes(self, stop: str, v: str, w: str, turn: float, slow: float, least: int, size: int, first_forward: int, extend: int) -> Chain:
        self.step(f"SELECT *, CASE WHEN {stop} THEN 0 WHEN {w} >= {turn} AND {v} <= 2 * {slow} THEN 2 ELSE 1 END AS mode FROM {{of}}")
        self.median("mode", size).merged("mode", least).runs("mode")
        self.step("SELECT *, min(CASE WHEN mode <> 0 THEN run END) OVER (PARTITION BY episode_id) AS firstrun FROM {of}")
        self.replaced("mode", f"CASE WHEN run = firstrun AND mode = 1 AND run_length < {first_forward} THEN 2 ELSE mode END")
        if extend:
            self.runs("mode")
            self.step(f"""SELECT a.* REPLACE (CASE WHEN a.run > 1 AND run_row <= {extend} THEN h.before ELSE a.mode END AS mode) FROM {{of}} a JOIN (SELECT episode_id AS e, run AS r, lag(own) OVER (PARTITION BY episode_id ORDER BY run) AS before
                   FROM (SELECT episode_id, run, min(mode) AS own FROM {{of}} GROUP BY episode_id, run)) h ON a.episode_id = h.e AND a.run = h.r""")
        return self.median("mode", size).merged("mode", least)

    def refined(self, mode: str, speed: str, slow: float, wait: int, margin: int) -> Chain:
        self.runs(mode)
        at = "PARTITION BY episode_id, run ORDER BY frame_idx ROWS BETWEEN"
        self.step(f"SELECT *, run_row - 1 AS i, avg(coalesce({speed}, 99.0)) OVER ({at} CURRENT ROW AND {wait - 1} FOLLOWING) AS ahead, avg(coalesce({speed}, 99.0)) OVER ({at} {wait - 1} PRECEDING AND CURRENT ROW) AS back FROM {{of}}")
        self.step(f"SELECT *, min(CASE WHEN i < run_length - {wait} AND ahead < {slow} THEN i END) OVER (PARTITION BY episode_id, run) AS f1, max(CASE WHEN i >= {wait} AND back < {slow} THEN i END) OVER (PARTITION BY episode_id, run) AS l1 FROM {{of}}")
        moving = f"(i < run_length - {wait} AND (f1 IS NULL OR i < f1)) OR (i >= {wait} AND (l1 IS NULL OR i > l1))"
        edge = f"(f1 IS NOT NULL AND i >= f1 AND i < f1 + {margin}) OR (l1 IS NOT NULL AND i <= l1 AND i > l1 - {margin})"
        return self.replaced(mode, f"CASE WHEN {mode} = 0 AND ({moving} OR {edge}) THEN 3 ELSE {mode} END")

    def finished(self, mode: str, rows: int) -> Chain:
        self.runs(mode).step(f"SELECT *, max(CASE WHEN {mode} <> 3 THEN run END) OVER (PARTITION BY episode_id) AS lastrun FROM {{of}}")
        return self.replaced(mode, f"CASE WHEN run = lastrun AND run_length - run_row < {rows} THEN 4 ELSE {mode} END")

    def sql(self, select: str) -> str:
        return ", " + ",\n".join(self.parts) + f" {select} FROM {self.of}"
