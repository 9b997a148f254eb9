"""DuckDB statement of the linear fits: moments, then elimination as a chain of tables.

The oracle side of ``operators/moments.py``: the same scaled normal equations, solved
feature by feature in SQL, so every query that fits OLS or ridge has a row-by-row check.
"""

from __future__ import annotations

from slotwise.operators.moments import CONSTANT, TOLERANCE
from slotwise.schemas import FEATURE_COLS, TARGET


def fit_ctes(name: str, source: str, group: str = "1", alpha: float = 0.0, features: list[str] = FEATURE_COLS, label: str = TARGET) -> str:
    """Tables ending in ``name`` (grp, intercept, w): a fit for every value of ``group`` in ``source``."""
    columns = [*features, label]
    size, n_f = len(columns), len(features)
    x = [f"CAST({c} AS DOUBLE)" for c in columns]
    sums = ", ".join(f"sum({c})" for c in x)
    products = ", ".join("[" + ", ".join(f"sum({a} * {b})" for b in x) + "]" for a in x)
    spread = f"list_transform(range(1, {size + 1}), lambda i: list_transform(range(1, {size + 1}), lambda j: p[i][j] - s[i] * s[j] / n))"
    flat = f"list_transform(range(1, {size + 1}), lambda i: p[i][i] - s[i] * s[i] / n <= {CONSTANT!r} * p[i][i])"
    entry = f"CASE WHEN flat[r] OR flat[j] THEN 0.0 ELSE c[r][j] END + CASE WHEN r = j THEN {float(alpha)!r} ELSE 0.0 END"
    root = f"list_transform(range(1, {n_f + 1}), lambda i: sqrt(CASE WHEN flat[i] THEN 0.0 ELSE c[i][i] END + {float(alpha)!r}))"
    out = f"""{name}_m AS MATERIALIZED (SELECT {group} AS grp, CAST(count(*) AS DOUBLE) AS n, [{sums}] AS s, [{products}] AS p FROM {source} GROUP BY 1),
{name}_c AS MATERIALIZED (SELECT grp, n, s, {spread} AS c, {flat} AS flat FROM {name}_m),
{name}_d AS MATERIALIZED (SELECT *, list_transform({root}, lambda v: CASE WHEN v > 0 THEN v ELSE 1.0 END) AS safe FROM {name}_c),
{name}_0 AS MATERIALIZED (SELECT grp, r, CAST([] AS BOOLEAN[]) AS used, list_append(
    list_transform(range(1, {n_f + 1}), lambda j: ({entry}) / (safe[r] * safe[j])),
    CASE WHEN flat[r] OR flat[{size}] THEN 0.0 ELSE c[r][{size}] END / safe[r]) AS row FROM {name}_d, range(1, {n_f + 1}) t(r)),
"""
    for k in range(1, n_f + 1):
        out += f"""{name}_{k} AS MATERIALIZED (SELECT g.grp, g.r, list_append(g.used, q.row[{k}] > {TOLERANCE!r}) AS used,
    CASE WHEN q.row[{k}] <= {TOLERANCE!r} THEN g.row
         WHEN g.r = {k} THEN list_transform(g.row, lambda v: v / q.row[{k}])
         ELSE list_transform(range(1, {n_f + 2}), lambda i: g.row[i] - g.row[{k}] * (q.row[i] / q.row[{k}])) END AS row
  FROM {name}_{k - 1} g JOIN {name}_{k - 1} q ON g.grp = q.grp AND q.r = {k}),
"""
    return (
        out
        + f"""{name}_w AS MATERIALIZED (SELECT grp, list(CASE WHEN used[r] THEN row[{n_f + 1}] / safe[r] ELSE 0.0 END ORDER BY r) AS w
  FROM {name}_{n_f} JOIN (SELECT grp, safe FROM {name}_d) USING (grp) GROUP BY grp),
{name} AS MATERIALIZED (SELECT grp, w, s[{size}] / n - list_sum(list_transform(range(1, {n_f + 1}), lambda i: w[i] * s[i] / n)) AS intercept
  FROM {name}_w JOIN {name}_m USING (grp))"""
    )


def forecast(name: str, features: list[str] = FEATURE_COLS) -> str:
    """The forecast of fit ``name`` for a row that carries the features."""
    return f"({name}.intercept + " + " + ".join(f"{name}.w[{k}] * {c}" for k, c in enumerate(features, 1)) + ")"
