"""SQL of the estimators for few frequencies: normal equations as sums, solved by elimination written out, step by step.

A fragment is a list of common table expressions; a pixel's key is `p`, times are `t`, bands are numbered from 0.
"""

from __future__ import annotations

from collections.abc import Sequence

YEAR_SECONDS = 365.25 * 86400

DAILY = """daily AS (SELECT l_suppkey AS p, epoch(l_shipdate) / 86400 AS t, avg(l_quantity) AS l_quantity, avg(l_extendedprice) AS l_extendedprice,
  avg(l_discount) AS l_discount, avg(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2)"""


def observed(bands: Sequence[str], name: str = "o") -> list[str]:
    """All dates of each pixel: p, t (days), y0, y1, ..."""
    return [DAILY, f"{name} AS MATERIALIZED (SELECT p, t, {', '.join(f'{b} AS y{i}' for i, b in enumerate(bands))} FROM daily)"]


def held_out(name: str, source: str = "o", least: int = 12) -> list[str]:
    """{name}_train and {name}_truth: a pixel's middle date is the truth; pixels with `least` dates or fewer are left out."""
    return [
        f"{name}_r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY p ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY p) AS c FROM {source})",
        f"{name}_train AS MATERIALIZED (SELECT * EXCLUDE (i, c) FROM {name}_r WHERE c > {least} AND i <> c // 2)",
        f"{name}_truth AS (SELECT * EXCLUDE (i, c) FROM {name}_r WHERE c > {least} AND i = c // 2)",
    ]


def _upper(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def sums(name: str, rows: str, n: int, targets: Sequence[str], weight: str = "1.0", penalty: Sequence[str] | None = None) -> str:
    """Normal equations a{i}_{j}, b{i}_{r} of columns x0, x1, ... for several targets, with a penalty on the diagonal."""
    add = lambda i, j: f" + {penalty[i]}" if penalty and i == j else ""
    a = [f"sum({weight} * x{i} * x{j}){add(i, j)} AS a{i}_{j}" for i, j in _upper(n)]
    b = [f"sum({weight} * x{i} * ({y})) AS b{i}_{r}" for i in range(n) for r, y in enumerate(targets)]
    return f"{name} AS (SELECT p, {', '.join(a + b)} FROM {rows} GROUP BY p)"


def solved(name: str, system: str, n: int, targets: int) -> list[str]:
    """Solves a symmetric system by elimination without exchange of rows: columns c{i}_{r}."""
    out, now = [], system
    for k in range(n):
        step = f"{name}_e{k}"
        columns = []
        for i, j in _upper(n):
            columns.append(f"a{i}_{j} - a{k}_{i} / a{k}_{k} * a{k}_{j} AS a{i}_{j}" if i > k else f"a{i}_{j}")
        columns += [f"b{i}_{r} - a{k}_{i} / a{k}_{k} * b{k}_{r} AS b{i}_{r}" if i > k else f"b{i}_{r}" for i in range(n) for r in range(targets)]
        out.append(f"{step} AS (SELECT p, {', '.join(columns)} FROM {now})")
        now = step
    for i in range(n - 1, -1, -1):
        step = name if i == 0 else f"{name}_s{i}"
        known = [f"c{j}_{r}" for j in range(i + 1, n) for r in range(targets)]
        rest = lambda r: "".join(f" - a{i}_{j} * c{j}_{r}" for j in range(i + 1, n))  # noqa: B023, E731
        new = [f"(b{i}_{r}{rest(r)}) / a{i}_{i} AS c{i}_{r}" for r in range(targets)]
        kept = [f"a{h}_{j}" for h in range(i) for j in range(h, n)] + [f"b{h}_{r}" for h in range(i) for r in range(targets)]
        out.append(f"{step} AS MATERIALIZED (SELECT p, {', '.join([*kept, *known, *new])} FROM {now})")
        now = step
    return out


def fitted(n: int, r: int | str, x: str = "x", c: str = "c") -> str:
    return "(" + " + ".join(f"{c}{i}_{r} * {x}{i}" for i in range(n)) + ")"


def snapped_year(name: str, rows: str, values: Sequence[str], modes: int) -> str:
    """(p, f): of the spectrum's bins next to a year, that with the most power times the squared sinc of its distance. rows: rel, span."""
    power = " + ".join(f"pow(sum({v} * cos(2 * pi() * k * rel / span)), 2) + pow(sum({v} * sin(2 * pi() * k * rel / span)), 2)" for v in values)
    u = f"(any_value(span) / {YEAR_SECONDS})"
    near = f"(SELECT *, unnest([floor(span / {YEAR_SECONDS}), floor(span / {YEAR_SECONDS}) + 1]) AS k FROM {rows})"
    z = f"abs(k - {u})"
    sinc = f"CASE WHEN {z} < 1e-8 THEN 1 ELSE sin(pi() * {z}) / (pi() * {z}) END"
    return f"{name} AS MATERIALIZED (SELECT p, arg_max(k / span, s) AS f FROM (SELECT p, k, any_value(span) AS span, ({power}) * pow({sinc}, 2) AS s FROM {near} WHERE k BETWEEN 1 AND {(modes + modes % 2) // 2 - 1} GROUP BY p, k) GROUP BY p)"


def _relative(name: str, source: str, extra: str = "") -> list[str]:
    """Rows with rel, mean and span of the time axis in seconds."""
    return [
        f"{name}_t AS (SELECT p, min(t) * 86400 AS start, avg(t * 86400 - {name}_m.a) AS m, (max(t) - min(t)) * 86400 AS span FROM {source} JOIN (SELECT p, min(t) * 86400 AS a FROM {source} GROUP BY p) {name}_m USING (p) GROUP BY p)",
        f"{name} AS MATERIALIZED (SELECT o.*, t * 86400 - start AS rel, start, m, span{extra} FROM {source} o JOIN {name}_t USING (p))",
    ]


WAVES = ["1.0", "rel - m", "cos(2 * pi() * f * rel)", "sin(2 * pi() * f * rel)"]


def vector_fit(name: str, source: str, bands: int, config, least: int | None = None) -> list[str]:
    """{name}: p, start, m, f, n, u{b} (centre), v{b} (scale), c{i}_{b}: the vector model with the bin nearest to a year, robust scales,
    shrinkage and rounds of weights. config: that of the model."""
    lam, shrink, delta = config.ridge_lam, config.multiband_shrinkage, max(config.huber_delta, 1.5)
    least = max(config.min_obs, 3) if least is None else least
    ys, zs = [f"y{b}" for b in range(bands)], [f"z{b}" for b in range(bands)]
    out = _relative(f"{name}_r", source)
    out.append(f"{name}_c AS MATERIALIZED (SELECT p, count(*) AS n, {', '.join(f'median({y}) AS u{b}, stddev_pop({y}) AS d{b}' for b, y in enumerate(ys))} FROM {source} GROUP BY p HAVING count(*) >= {least})")
    mad = ", ".join(f"1.4826 * median(abs(y{b} - u{b})) AS mad{b}" for b in range(bands))
    out.append(f"{name}_m AS (SELECT p, {mad} FROM {source} JOIN {name}_c USING (p) GROUP BY p)")
    scale = ", ".join(f"greatest(CASE WHEN mad{b} > 1e-6 THEN mad{b} ELSE d{b} END, 1e-6) AS v{b}" for b in range(bands))
    out.append(f"{name}_v AS MATERIALIZED (SELECT p, n, {', '.join(f'u{b}' for b in range(bands))}, {scale} FROM {name}_c JOIN {name}_m USING (p))")
    out.append(f"{name}_z AS MATERIALIZED (SELECT p, rel, m, span, {', '.join(f'(y{b} - u{b}) / v{b} AS z{b}' for b in range(bands))} FROM {name}_r JOIN {name}_v USING (p))")
    out.append(snapped_year(f"{name}_f", f"{name}_z", zs, config.modes))
    mean = "(" + " + ".join(zs) + f") / {bands}.0"
    out.append(f"{name}_w0 AS MATERIALIZED (SELECT p, {', '.join(zs)}, {', '.join(f'{x} AS x{i}' for i, x in enumerate(WAVES))}, 1.0 AS w FROM {name}_z JOIN {name}_f USING (p))")
    free = ["1e-12", "1e-12"]
    plain, shrunk = [f"{lam}", f"{lam}", *free], [f"{lam}", f"{lam} + {shrink}", *(f"{x} + {shrink}" for x in free)]
    for k in range(min(max(config.huber_iters, 1), 5) + 1):
        rows = f"{name}_w{k}"
        if shrink > 0 and bands > 1:
            out.append(sums(f"{name}_g{k}", rows, 4, [mean], "w", plain))
            out += solved(f"{name}_h{k}", f"{name}_g{k}", 4, 1)
            out.append(sums(f"{name}_i{k}", rows, 4, [f"{z} - {mean}" for z in zs], "w", shrunk))
            out += solved(f"{name}_j{k}", f"{name}_i{k}", 4, bands)
            theta = ", ".join(f"h.c{i}_0 + j.c{i}_{b} AS c{i}_{b}" for i in range(4) for b in range(bands))
            out.append(f"{name}_k{k} AS MATERIALIZED (SELECT p, {theta} FROM {name}_h{k} h JOIN {name}_j{k} j USING (p))")
        else:
            out.append(sums(f"{name}_g{k}", rows, 4, zs, "w", plain))
            out += solved(f"{name}_k{k}", f"{name}_g{k}", 4, bands)
        if k < min(max(config.huber_iters, 1), 5):
            miss = "sqrt((" + " + ".join(f"pow(z{b} - {fitted(4, b)}, 2)" for b in range(bands)) + f") / {bands}.0)"
            columns = ", ".join([*zs, *(f"x{i}" for i in range(4))])
            out.append(f"{name}_w{k + 1} AS MATERIALIZED (SELECT p, {columns}, greatest(0.5 * w + 0.5 * CASE WHEN e <= {delta} THEN 1 ELSE {delta} / (e + 1e-12) END, 0.03) AS w FROM (SELECT *, {miss} AS e FROM {rows} JOIN {name}_k{k} USING (p)))")
    last = f"{name}_k{min(max(config.huber_iters, 1), 5)}"
    out.append(f"{name} AS MATERIALIZED (SELECT * FROM {last} JOIN {name}_v USING (p) JOIN {name}_f USING (p) JOIN {name}_r_t USING (p))")
    return out


def vector_value(b: int, t: str) -> str:
    """The model's value of band b at t (days)."""
    rel = f"({t} * 86400 - start)"
    x = ["1.0", f"({rel} - m)", f"cos(2 * pi() * f * {rel})", f"sin(2 * pi() * f * {rel})"]
    return f"(u{b} + v{b} * (" + " + ".join(f"c{i}_{b} * {v}" for i, v in enumerate(x)) + "))"


def scalar_ridge(name: str, source: str, lam: float, modes: int, rounds: int = 0, delta: float = 0.0, least: int = 12, divisor: float = 10_000.0, period: float | None = None) -> list[str]:
    """{name}: p, start, m, f, c{i}_0 of one band y0 / divisor, by ridge on a constant, a trend and one wave (at the bin nearest to a year,
    or of a given period in days), with rounds of Huber weights."""
    out = _relative(f"{name}_r", f"(SELECT * FROM {source} WHERE p IN (SELECT p FROM {source} GROUP BY p HAVING count(*) >= {least}))", f", y0 / {divisor} AS z0")
    if period is None:
        out.append(snapped_year(f"{name}_f", f"{name}_r", ["z0"], modes))
    else:
        out.append(f"{name}_f AS (SELECT DISTINCT p, 1 / ({period} * 86400.0) AS f FROM {name}_r)")
    out.append(f"{name}_w0 AS MATERIALIZED (SELECT p, z0, {', '.join(f'{x} AS x{i}' for i, x in enumerate(WAVES))}, 1.0 AS w FROM {name}_r JOIN {name}_f USING (p))")
    for k in range(rounds + 1):
        out.append(sums(f"{name}_g{k}", f"{name}_w{k}", 4, ["z0", "1.0"] if not rounds else ["z0"], "w", [f"{lam}"] * 4))
        out += solved(f"{name}_k{k}", f"{name}_g{k}", 4, 1 if rounds else 2)
        if k < rounds:
            out.append(f"{name}_w{k + 1} AS MATERIALIZED (SELECT p, z0, x0, x1, x2, x3, CASE WHEN e <= {delta} THEN 1.0 ELSE {delta} / e END AS w FROM (SELECT *, abs(z0 - {fitted(4, 0)}) AS e FROM {name}_w{k} JOIN {name}_k{k} USING (p)))")
    out.append(f"{name} AS MATERIALIZED (SELECT * FROM {name}_k{rounds} JOIN {name}_f USING (p) JOIN {name}_r_t USING (p))")
    return out


def scalar_value(t: str, r: int = 0) -> str:
    rel = f"({t} * 86400 - start)"
    x = ["1.0", f"({rel} - m)", f"cos(2 * pi() * f * {rel})", f"sin(2 * pi() * f * {rel})"]
    return "(" + " + ".join(f"c{i}_{r} * {v}" for i, v in enumerate(x)) + ")"


def yearly(n: int, t: str = "t") -> list[str]:
    """1 and n yearly harmonics of days."""
    return ["1.0", *(f"{fn}(2 * pi() * {t} * {k} / 365.25)" for k in range(1, n + 1) for fn in ("cos", "sin"))]


def hants(name: str, source: str, bands: int, nof: int, fet: float, turns: int) -> list[str]:
    """{name}{b}: p, c{i}_0, turns of each band: least squares, without what misses by more than fet, again until none does, `turns`
    times at most."""
    out, n = [], 2 * nof - 1
    for b in range(bands):
        now = f"{name}{b}_x0"
        out.append(f"{now} AS MATERIALIZED (SELECT p, y{b} AS z, {', '.join(f'{x} AS x{i}' for i, x in enumerate(yearly(nof - 1)))} FROM {source})")
        for k in range(turns):
            out.append(sums(f"{name}{b}_g{k}", now, n, ["z"]))
            out += solved(f"{name}{b}_k{k}", f"{name}{b}_g{k}", n, 1)
            if k < turns - 1:
                nxt = f"{name}{b}_x{k + 1}"
                out.append(f"{nxt} AS MATERIALIZED (SELECT p, z, {', '.join(f'x{i}' for i in range(n))} FROM {now} JOIN {name}{b}_k{k} USING (p) WHERE abs(z - {fitted(n, 0)}) <= {fet})")
                now = nxt
        counts = " UNION ALL ".join(f"SELECT p, {k} AS k, count(*) AS c FROM {name}{b}_x{k} GROUP BY p" for k in range(turns))
        out.append(f"{name}{b} AS MATERIALIZED (SELECT * FROM {name}{b}_k{turns - 1} JOIN (SELECT p, count(DISTINCT c)::INTEGER AS turns FROM ({counts}) GROUP BY p) USING (p))")
    return out


def hants_value(nof: int, t: str) -> str:
    return "(" + " + ".join(f"c{i}_0 * {x}" for i, x in enumerate(yearly(nof - 1, t))) + ")"


def least_squares(name: str, source: str, bands: int, order: int = 3) -> list[str]:
    """{name}: p, m, c{i}_{b}, rmse{b}: a constant, a trend and `order` yearly harmonics of days by least squares."""
    n = 2 * order + 2
    out = [f"{name}_m AS (SELECT p, avg(t) AS m, count(*) AS n FROM {source} GROUP BY p)"]
    columns = [*yearly(order), "t - m"]
    out.append(f"{name}_x AS MATERIALIZED (SELECT o.*, m, {', '.join(f'{x} AS x{i}' for i, x in enumerate(columns))} FROM {source} o JOIN {name}_m USING (p))")
    out.append(sums(f"{name}_g", f"{name}_x", n, [f"y{b}" for b in range(bands)]))
    out += solved(f"{name}_k", f"{name}_g", n, bands)
    rmse = ", ".join(f"sqrt(avg(pow(y{b} - {fitted(n, b)}, 2))) AS rmse{b}" for b in range(bands))
    out.append(f"{name} AS MATERIALIZED (SELECT * FROM {name}_k JOIN {name}_m USING (p) JOIN (SELECT p, {rmse} FROM {name}_x JOIN {name}_k USING (p) GROUP BY p) USING (p))")
    return out


def least_squares_value(b: int, t: str, order: int = 3) -> str:
    return "(" + " + ".join(f"c{i}_{b} * {x}" for i, x in enumerate([*yearly(order, t), f"({t} - m)"])) + ")"


def with_all(parts: Sequence[str], select: str) -> str:
    return f"WITH {', '.join(parts)} {select}"
