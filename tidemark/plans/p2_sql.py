"""P-square folds as recursive SQL: an independent formulation that checks the Python fold."""

from __future__ import annotations

import numpy as np


def p2_sql(source: str, p: float | None = None, buckets: int | None = None) -> str:
    """A subquery over source (key, seq, x) with key, rn, q0.., n0.. after each row, from the row that fills the markers on.

    p: a quantile; buckets: a histogram.
    """
    count = 5 if p is not None else buckets + 1
    last = count - 1
    if p is not None:
        f = np.float32
        rates = [0.0, float(f(p) / f(2)), float(f(p)), float((f(1) + f(p)) / f(2)), 1.0]
        begin = [1.0, float(f(1) + f(2) * f(p)), float(f(1) + f(4) * f(p)), float(f(3) + f(2) * f(p)), 5.0]
        wanted = [f"w{i}" for i in range(1, last)]
        start_w = ", ".join(f"CAST({begin[i]!r} AS DOUBLE) AS w{i}" for i in range(1, last)) + ", "
        step_w = ", ".join(f"w{i} + {rates[i]!r} AS w{i}" for i in range(1, last)) + ", "
    else:
        wanted, start_w, step_w = [], "", ""
    qs, ns = [f"q{i}" for i in range(count)], [f"n{i}" for i in range(count)]
    state = ", ".join([*wanted, *qs, *ns])
    cell = "CASE WHEN s.x < q0 THEN 1 " + " ".join(f"WHEN s.x < q{i} THEN {i}" for i in range(1, last)) + f" ELSE {last} END"
    moved = f"(SELECT s.key, s.rn, {step_w}least(q0, s.x) AS q0, " + ", ".join(f"q{i}" for i in range(1, last)) + f", greatest(q{last}, s.x) AS q{last}, " + ", ".join(f"n{i} + CASE WHEN {i} >= {cell} THEN 1 ELSE 0 END AS n{i}" for i in range(count)) + " FROM fold JOIN s ON s.key = fold.key AND s.rn = fold.rn + 1)"
    for i in range(1, last):
        want = f"w{i}" if p is not None else f"(1 + {i} * (n{last} - 1) / {buckets})"
        step = f"(CASE WHEN {want} - n{i} >= 1 AND n{i + 1} - n{i} > 1 THEN 1.0::DOUBLE WHEN {want} - n{i} <= -1 AND n{i - 1} - n{i} < -1 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END)"
        a, b, c = (f"q{j}" for j in (i - 1, i, i + 1))
        x, y, z = (f"n{j}" for j in (i - 1, i, i + 1))
        curve = f"({b} + ((({y} - {x}) + d) * ({c} - {b}) / ({z} - {y}) + (({z} - {y}) - d) * ({b} - {a}) / ({y} - {x})) * d / ({z} - {x}))"
        line = f"(CASE WHEN d > 0 THEN {b} + ({c} - {b}) / ({z} - {y}) ELSE {b} - ({a} - {b}) / ({x} - {y}) END)"
        inner = f"(SELECT *, {step} AS d FROM {moved})"
        inner = f"(SELECT *, {curve} AS h FROM {inner})"
        moved = f"(SELECT * REPLACE (CASE WHEN d = 0 THEN {b} WHEN {a} < h AND h < {c} THEN h ELSE {line} END AS q{i}, n{i} + d AS n{i}) FROM {inner})"
        moved = f"(SELECT key, rn, {state} FROM {moved})"
    firsts = ", ".join(f"f[{i + 1}] AS q{i}" for i in range(count)) + ", " + ", ".join(f"CAST({i + 1} AS DOUBLE) AS n{i}" for i in range(count))
    return f"""(WITH RECURSIVE s AS (SELECT key, CAST(x AS DOUBLE) AS x, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM {source}),
 fold AS (SELECT key, CAST({count} AS BIGINT) AS rn, {start_w}{firsts} FROM (SELECT key, list_sort(list(x)) AS f FROM s WHERE rn <= {count} GROUP BY key HAVING count(*) = {count}) UNION ALL SELECT key, rn, {state} FROM {moved})
 SELECT key, rn, {", ".join([*qs, *ns])} FROM fold)"""
