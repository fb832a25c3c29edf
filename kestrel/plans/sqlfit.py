"""Least squares in plain SQL, for the oracles of the fit queries.

Successive residuals (Frisch-Waugh): the predictors, intercept first, are made
orthogonal one after the other by grouped sums, and the response loses its
projection on each.  The response's last residual is the fit's residual on
every row, training or not; coefficients and standard errors follow from the
triangular factors.  Only CTE text is made here; DuckDB runs it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The powers of ten that a double can be compared with, 1e-40 to 1e40.
_POWERS = [float(f"1e{k}") for k in range(-40, 41)]
_ONE = 41  # the 1-based place of 1e0 among them


def significant(x: Column, digits: int = 6) -> Column:
    """x rounded half up (away from zero) to significant digits.

    Only comparisons with literal powers of ten, one multiplication or
    division, `floor` and its inverse: the same IEEE steps as
    `significant_sql`, so equal doubles round alike in both, ties included.
    Zero, null, non-finite values and those beyond the powers stay as they are.
    """
    p = F.array(*[F.lit(v) for v in _POWERS])

    def rounded(v: Column) -> Column:
        place = F.lit(digits + _ONE - 1) - F.size(F.filter(p, lambda t: t <= F.abs(v)))  # decimals to keep
        up = F.element_at(p, F.lit(_ONE) + F.least(F.greatest(place, F.lit(0)), F.lit(40)))
        down = F.element_at(p, F.lit(_ONE) + F.least(F.greatest(-place, F.lit(0)), F.lit(40)))
        return F.signum(v) * (F.floor(F.abs(v) * up / down + F.lit(0.5)).cast("double") * down / up)
    return F.when(F.abs(x).between(1e-20, 1e20), F.element_at(F.transform(F.array(x), rounded), 1)).otherwise(x)


def significant_sql(x: str, digits: int = 6) -> str:
    """DuckDB twin of `significant`."""
    p = "[" + ", ".join(f"{v!r}::DOUBLE" for v in _POWERS) + "]"
    place = f"({digits + _ONE - 1} - len(list_filter({p}, lambda t: t <= abs(v))))"
    up, down = (f"{p}[{_ONE} + least(greatest({s}{place}, 0), 40)]" for s in ("", "-"))
    return (f"(list_transform([CAST({x} AS DOUBLE)], lambda v: CASE WHEN abs(v) BETWEEN 1e-20 AND 1e20 THEN "
            f"sign(v) * (floor(abs(v) * {up} / {down} + 0.5) * {down} / {up}) ELSE v END))[1]")


def residual_ctes(name: str, source: str, keys: list[str], y: str, xs: list[str], train: str = "TRUE") -> str:
    """CTEs {name}_g0 .. {name}_res; {name}_res has every column of `source`
    plus __y (the residual) and __d0.. (each predictor's own residual), and
    {name}_a<i> (keys, d<i>, c<i>, r<i>_<j>) holds the factors."""
    k = len(xs)
    cols = ["1.0::DOUBLE", *[f"({x})::DOUBLE" for x in xs]]
    out = [f"{name}_g0 AS (SELECT *, ({train}) AS __tr, ({y})::DOUBLE AS __y, "
           + ", ".join(f"{c} AS __x{i}" for i, c in enumerate(cols)) + f" FROM {source})"]
    on = f"USING ({', '.join(keys)})" if keys else "ON TRUE"
    sel = "".join(f"{x}, " for x in keys)
    grp = f" GROUP BY {', '.join(keys)}" if keys else ""
    for i in range(k + 1):
        later = "".join(f", sum(__x{i} * __x{j}) / nullif(sum(__x{i} * __x{i}), 0) AS r{i}_{j}" for j in range(i + 1, k + 1))
        out.append(f"{name}_a{i} AS (SELECT {sel}sum(__x{i} * __x{i}) AS d{i}, "
                   f"sum(__x{i} * __y) / nullif(sum(__x{i} * __x{i}), 0) AS c{i}{later} FROM {name}_g{i} WHERE __tr{grp})")
        new = [f"__y - coalesce(c{i}, 0) * __x{i} AS __y"] + \
            [f"__x{j} - coalesce(r{i}_{j}, 0) * __x{i} AS __x{j}" for j in range(i + 1, k + 1)]
        drop = [f"d{i}", f"c{i}", *[f"r{i}_{j}" for j in range(i + 1, k + 1)]]
        out.append(f"{name}_g{i + 1} AS (SELECT * EXCLUDE ({', '.join(drop)}) REPLACE ({', '.join(new)}) "
                   f"FROM {name}_g{i} JOIN {name}_a{i} {on})")
    out.append(f"{name}_res AS (SELECT * FROM {name}_g{k + 1})")
    return ",\n".join(out)


def coefficient_ctes(name: str, keys: list[str], xs: list[str]) -> str:
    """CTE {name}_coef (keys, b0.., v0.., n, rss) after `residual_ctes`: the
    coefficients (intercept b0), the diagonal of (X'X)^-1, rows and residual
    sum of squares of the training rows."""
    k = len(xs)
    on = f"USING ({', '.join(keys)})" if keys else "ON TRUE"
    sel = "".join(f"{x}, " for x in keys)
    grp = f" GROUP BY {', '.join(keys)}" if keys else ""
    joined = f"{name}_a0 " + " ".join(f"JOIN {name}_a{i} {on}" for i in range(1, k + 1))
    v = [" + ".join([f"1 / d{i}", *[f"u{i}_{j} * u{i}_{j} / d{j}" for j in range(i + 1, k + 1)]]) + f" AS v{i}"
         for i in range(k + 1)]
    steps, last = [f"{name}_f AS MATERIALIZED (SELECT * FROM {joined})"], f"{name}_f"
    for i in range(k, -1, -1):                           # one row of the triangular system a step
        new = [f"c{i}" + "".join(f" - r{i}_{j} * b{j}" for j in range(i + 1, k + 1)) + f" AS b{i}"]
        for j in range(i + 1, k + 1):
            terms = [f"r{i}_{m} * u{m}_{j}" if m < j else f"r{i}_{m}" for m in range(i + 1, j + 1)]
            new.append(f"-({' + '.join(terms)}) AS u{i}_{j}")
        steps.append(f"{name}_t{i} AS MATERIALIZED (SELECT *, {', '.join(new)} FROM {last})")
        last = f"{name}_t{i}"
    return (",\n".join(steps) + ",\n"
            f"{name}_s AS (SELECT {sel}count(*) AS n, sum(__y * __y) AS rss FROM {name}_res WHERE __tr{grp}),\n"
            f"{name}_coef AS (SELECT {sel}{', '.join(f'b{i}' for i in range(k + 1))}, {', '.join(v)}, n, rss "
            f"FROM {last} JOIN {name}_s {on})")


def t_two_sided_sql(t: str, dof: str, steps: int = 4000) -> str:
    """P(|T| > |t|) by Simpson's rule on Student's density (0 beyond 40)."""
    dens = f"pow(1 + pow(abs({t}) * i / {steps}.0, 2) / ({dof}), -(({dof}) + 1) / 2.0)"
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    norm = f"exp(lgamma((({dof}) + 1) / 2.0) - lgamma(({dof}) / 2.0)) / sqrt(({dof}) * pi())"
    return (f"CASE WHEN abs({t}) > 40 THEN 0.0 ELSE greatest(0.0, 1 - 2 * {norm} * abs({t}) / {steps}.0 / 3 * "
            f"list_sum(list_transform(range({steps} + 1), lambda i: {weight} * {dens}))) END")
