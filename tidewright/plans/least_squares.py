"""Least squares in SQL: sums of products by term, then Gauss-Jordan elimination in a recursive table."""

from __future__ import annotations

from collections.abc import Sequence

from ..operators.regression import Terms


def ols_sql(p: str, source: str, keys: Sequence[str], y: str, models: Sequence[Terms]) -> str:
    """Tables of the fits of ``y`` in the table ``source``: ``{p}fit`` (keys, model, n, r2) and ``{p}effect`` (keys, model, t, beta).

    Terms are called ``(1)``, ``factor=level``, the numeric column, or ``column^k``; the first level of a factor in text order is the
    baseline and has no row. A term that the ones before it explain is left out, which changes neither the fit nor r2.
    Polynomials are in hundreds. The text holds a recursive table and so must stand in a WITH RECURSIVE.
    """
    by = "".join(f"{k}, " for k in keys)
    factors = sorted({f for m in models for f in m.factors})
    numeric = sorted({c for m in models for c in m.numeric})
    poly = {c: max(deg for m in models for d, deg in m.poly if d == c) for m in models for c, _ in m.poly}
    terms = ["{'label': '(1)', 't': '(1)', 'v': 1.0::DOUBLE}", f"{{'label': '~y', 't': '~y', 'v': {y}::DOUBLE}}"]
    terms += [f"{{'label': '{f}', 't': '{f}=' || {f}, 'v': 1.0::DOUBLE}}" for f in factors]
    terms += [f"{{'label': '{c}', 't': '{c}', 'v': {c}::DOUBLE}}" for c in numeric]
    terms += [f"{{'label': '{c}^{k}', 't': '{c}^{k}', 'v': pow({c}/100.0, {k})::DOUBLE}}" for c, deg in poly.items() for k in range(1, deg + 1)]
    names = {m.name: ["(1)", "~y", *m.factors, *m.numeric, *[f"{c}^{k}" for c, deg in m.poly for k in range(1, deg + 1)]] for m in models}
    members = ", ".join(f"('{name}', '{label}')" for name, labels in names.items() for label in labels)
    dummies = ", ".join(f"'{f}'" for f in factors) or "''"
    cell = "CASE WHEN i = k THEN m[k][j]/m[k][k] ELSE m[i][j] - m[i][k]*m[k][j]/m[k][k] END"
    return f"""{p}row AS (SELECT *, row_number() OVER () AS rid FROM {source}),
  {p}long AS (SELECT {by}rid, u.label, u.t, u.v FROM (SELECT {by}rid, unnest([{', '.join(terms)}]) AS u FROM {p}row)),
  {p}gram AS (SELECT {', '.join(f'a.{k}' for k in keys)}{', ' if keys else ''}a.t AS ta, b.t AS tb, sum(a.v*b.v) AS p FROM {p}long a JOIN {p}long b USING (rid) GROUP BY ALL),
  {p}term AS (SELECT {by}label, t FROM (SELECT DISTINCT {by}label, t FROM {p}long) QUALIFY label NOT IN ({dummies}) OR row_number() OVER (PARTITION BY {by}label ORDER BY t) > 1),
  {p}place AS (SELECT {by}model, t, row_number() OVER (PARTITION BY {by}model ORDER BY label = '~y', t) AS i FROM {p}term JOIN (VALUES {members}) v(model, label) USING (label)),
  {p}cell AS (SELECT {by}model, x.i AS i, z.i AS j, x.t AS ta, z.t AS tb FROM {p}place x JOIN {p}place z USING ({by}model)),
  {p}line AS (SELECT {by}model, i, list(coalesce(p, 0) ORDER BY j) AS r FROM {p}cell LEFT JOIN {p}gram USING ({by}ta, tb) GROUP BY {by}model, i),
  {p}start AS (SELECT {by}model, len(list(i)) AS size, list(r ORDER BY i) AS m FROM {p}line GROUP BY {by}model),
  {p}step AS (SELECT {by}model, size, m AS m0, m, 1 AS k, []::INT[] AS used FROM {p}start UNION ALL
    SELECT {by}model, size, m0, CASE WHEN m[k][k] > 1e-9*m0[k][k] THEN list_transform(range(1, size + 1), lambda i: list_transform(range(1, size + 1), lambda j: {cell})) ELSE m END, k + 1,
      CASE WHEN m[k][k] > 1e-9*m0[k][k] THEN list_append(used, k) ELSE used END FROM {p}step WHERE k < size),
  {p}done AS (SELECT * FROM {p}step WHERE k = size),
  {p}fit AS (SELECT {by}model, round(m0[1][1]) AS n, 1 - m[size][size]/(m0[size][size] - m0[1][size]*m0[1][size]/m0[1][1]) AS r2 FROM {p}done),
  {p}effect AS (SELECT {by}model, t, CASE WHEN list_contains(used, i) THEN m[i][size] ELSE 0 END AS beta FROM {p}done JOIN {p}place USING ({by}model) WHERE t <> '~y')"""
