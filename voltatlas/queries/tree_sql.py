"""SQL that grows the ensembles of ``operators.trees`` level by level, written on its own terms."""

from __future__ import annotations

from voltatlas.operators.trees import PRIME, STEP, Params, poisson_limits

_NODE = "CASE WHEN c.f IS NULL THEN w.node ELSE 2 * w.node + (l.b > c.b)::BIGINT END"


def _cuts(p: Params, by: str) -> str:
    """The best cut of each node, from the rows ``w`` with their weights."""
    return f"""hist AS (
      SELECT {by}, f, b, sum(w) AS n, sum(r * w) AS s FROM w JOIN long USING (id) WHERE w > 0 GROUP BY ALL),
    cum AS (
      SELECT {by}, f, b, sum(n) OVER upto AS ln, sum(s) OVER upto AS ls, sum(n) OVER every AS tn, sum(s) OVER every AS ts
      FROM hist WINDOW upto AS (PARTITION BY {by}, f ORDER BY b), every AS (PARTITION BY {by}, f)),
    valued AS (
      SELECT {by}, f, b, tn, ts::DOUBLE * ts::DOUBLE / (tn + {p.l2}::DOUBLE) AS alone,
        ls::DOUBLE * ls::DOUBLE / (ln + {p.l2}::DOUBLE)
        + (ts - ls)::DOUBLE * (ts - ls)::DOUBLE / (tn - ln + {p.l2}::DOUBLE) AS gain
      FROM cum WHERE ln >= {max(p.min_leaf, 1)} AND tn - ln >= {max(p.min_leaf, 1)}),
    cut AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY gain DESC, f, b) AS place FROM valued)
      WHERE place = 1 AND tn >= {p.min_split} AND gain > alone)"""


def points(features: list[str], rows: str = "rows") -> str:
    """``long`` and ``points`` of a query ``rows(id, g, train, y, features)``."""
    names = ", ".join(features)
    return f"""long AS (
      SELECT id, f, dense_rank() OVER (PARTITION BY f ORDER BY v) - 1 AS b FROM (
        SELECT id, unnest(range({len(features)})) AS f, unnest([{names}]::DOUBLE[]) AS v FROM {rows})),
    numbered AS (SELECT id, string_agg(b::VARCHAR, '|' ORDER BY f) AS bins FROM long GROUP BY id),
    points AS (
      SELECT id, train, y::BIGINT AS y,
        1 + ('0x' || substr(md5(g || '|' || bins), 1, 13))::BIGINT % {PRIME - 1} AS h
      FROM {rows} JOIN numbered USING (id)),
    powers AS (
      SELECT t, list_reduce(list_prepend(1::BIGINT, list_transform(range(t + 1), lambda x: {STEP}::BIGINT)),
                            lambda a, b: a * b % {PRIME}) AS m FROM range(400) AS r(t))"""


def boosted(p: Params) -> str:
    """``fitted(id, units)`` of all rows after the last tree."""
    drawn = f"c.h * m % {PRIME} < {p.subsample}::DOUBLE * {PRIME}" if p.subsample < 1 else "true"
    return f"""grown(k, id, units, node) AS (
    SELECT 0, id, (SELECT floor(sum(y)::DOUBLE / count(*) + 0.5)::BIGINT FROM points WHERE train), 1::BIGINT FROM points
    UNION ALL (
    WITH w AS (
      SELECT g.k, g.id, g.units, g.node, c.y - g.units AS r, (c.train AND {drawn})::BIGINT AS w
      FROM grown g JOIN points c USING (id) JOIN powers ON t = g.k // {p.depth}
      WHERE g.k < {p.trees * p.depth}),
    {_cuts(p, "node")},
    child AS (
      SELECT w.*, {_NODE} AS child FROM w LEFT JOIN cut c USING (node) LEFT JOIN long l ON l.id = w.id AND l.f = c.f),
    leaf AS (
      SELECT child, floor({p.rate}::DOUBLE * sum(r * w)::DOUBLE / (sum(w) + {p.l2}::DOUBLE) + 0.5)::BIGINT AS v
      FROM child WHERE w > 0 GROUP BY child)
    SELECT k + 1, id, CASE WHEN (k + 1) % {p.depth} = 0 THEN units + coalesce(v, 0) ELSE units END,
           CASE WHEN (k + 1) % {p.depth} = 0 THEN 1 ELSE child END
    FROM child LEFT JOIN leaf USING (child))),
    fitted AS (SELECT id, units::DOUBLE AS units FROM grown WHERE k = {p.trees * p.depth})"""


def forest(p: Params) -> str:
    """``fitted(id, units)`` of all rows: the mean of the trees, which grow side by side.

    ``grown`` keeps for each row and level the feature (-1: none) and the gain of the cut it took.
    """
    limits = "[" + ", ".join(map(str, poisson_limits())) + "]"
    return f"""drawn AS (
      SELECT t, id, y AS r, CASE WHEN train THEN len(list_filter({limits}, lambda x: x <= h * m % {PRIME})) ELSE 0 END AS w
      FROM points, powers WHERE t < {p.trees}),
    grown(k, t, id, node, cut, gain) AS (
    SELECT 0, t, id, 1::BIGINT, -1::BIGINT, 0::DOUBLE FROM drawn
    UNION ALL (
    WITH w AS (
      SELECT g.k, g.t, g.id, g.node, d.r, d.w FROM grown g JOIN drawn d ON d.t = g.t AND d.id = g.id
      WHERE g.k < {p.depth}),
    {_cuts(p, "t, node")}
    SELECT k + 1, w.t, w.id, {_NODE}, coalesce(c.f, -1), coalesce(gain - alone, 0)
    FROM w LEFT JOIN cut c ON c.t = w.t AND c.node = w.node LEFT JOIN long l ON l.id = w.id AND l.f = c.f)),
    leaf AS (
      SELECT g.t, node, floor(sum(r * w)::DOUBLE / sum(w) + 0.5)::BIGINT AS v
      FROM grown g JOIN drawn d ON d.t = g.t AND d.id = g.id WHERE k = {p.depth} AND w > 0 GROUP BY ALL),
    fitted AS (
      SELECT id, sum(coalesce(v, 0))::DOUBLE / {p.trees} AS units
      FROM grown g LEFT JOIN leaf l ON l.t = g.t AND l.node = g.node WHERE k = {p.depth} GROUP BY id)"""
