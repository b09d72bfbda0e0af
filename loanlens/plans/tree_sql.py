"""DuckDB texts of level-wise trees: the split rule of ``operators.trees`` as one group of CTEs per level.

Input: a CTE ``d`` (k, split, y and the features). Bins are the distinct values of a feature on the
training rows (at most ``bins``) or the values at ranks ceil(i n / bins); a level counts rows and sums
targets per (node, feature, cut), takes the cut with the largest variance gain (first feature, lowest cut
on ties up to rounding) and moves the rows to its children (heap numbers)."""

from __future__ import annotations


def bin_ctes(features: list[str], bins: int = 256) -> list[str]:
    values = ", ".join(f"CAST({f} AS DOUBLE)" for f in features)
    return [
        f"x AS MATERIALIZED (SELECT k, split, unnest(range(0, {len(features)})) AS f, unnest([{values}]) AS x FROM d)",
        "v AS (SELECT f, x, count(*) AS c FROM x WHERE split = 'train' GROUP BY f, x)",
        "vr AS (SELECT f, x, sum(c) OVER (PARTITION BY f ORDER BY x) AS hi, c, count(*) OVER (PARTITION BY f) AS nd, "
        "sum(c) OVER (PARTITION BY f) AS n FROM v)",
        f"cuts AS MATERIALIZED (SELECT f, x AS cut FROM vr WHERE nd <= {bins} OR (hi * {bins}) // n > ((hi - c) * {bins}) // n)",
        "b AS MATERIALIZED (SELECT x.k, x.f, cuts.cut FROM x ASOF JOIN cuts ON x.f = cuts.f AND x.x <= cuts.cut WHERE split = 'train')",
    ]


def tree_ctes(name: str, target: str, depth: int, least: int = 1) -> list[str]:
    """CTEs of one tree on ``target`` (k, y of training rows): <name>_nodes and <name>_leaf (k, split, value)."""
    out = [f"{name}_n0 AS (SELECT k, split, 0 AS node FROM d)"]
    for level in range(depth):
        at, low = f"{name}_n{level}", f"{name}_{level}"
        out += [
            f"{low}h AS (SELECT node, f, cut, count(*) AS n, sum(y) AS s FROM {at} JOIN {target} t USING (k) JOIN b USING (k) GROUP BY node, f, cut)",
            f"{low}c AS (SELECT node, f, cut, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER p AS nt, sum(s) OVER p AS st "
            f"FROM {low}h WINDOW w AS (PARTITION BY node, f ORDER BY cut), p AS (PARTITION BY node, f))",
            f"{low}g AS (SELECT *, nl * (nt - nl) / nt * power(sl / nl - (st - sl) / (nt - nl), 2) AS gain FROM {low}c "
            f"WHERE nl >= {least} AND nt - nl >= {least})",
            f"{low}m AS (SELECT *, max(gain) OVER (PARTITION BY node) AS top FROM {low}g WHERE gain > 1e-12 * greatest(1, power(st / nt, 2)) * nt)",
            f"{low}s AS MATERIALIZED (SELECT node, f, cut, gain FROM {low}m WHERE gain >= top * (1 - 1e-10) "
            f"QUALIFY row_number() OVER (PARTITION BY node ORDER BY f, cut) = 1)",
            f"{name}_n{level + 1} AS MATERIALIZED (SELECT n.k, n.split, 2 * n.node + 1 + CASE WHEN x.x > s.cut THEN 1 ELSE 0 END AS node "
            f"FROM {at} n JOIN {low}s s ON s.node = n.node JOIN x ON x.k = n.k AND x.f = s.f)",
        ]
    rows = " UNION ALL ".join(f"SELECT * FROM {name}_n{i}" for i in range(depth + 1))
    splits = " UNION ALL ".join(f"SELECT * FROM {name}_{i}s" for i in range(depth))
    return out + [
        f"{name}_all AS MATERIALIZED ({rows})",
        f"{name}_nodes AS MATERIALIZED (SELECT a.node, a.samples, a.value, s.f, s.cut, s.gain FROM (SELECT node, count(*) AS samples, sum(y) / count(*) AS value "
        f"FROM {name}_all JOIN {target} t USING (k) GROUP BY node) a LEFT JOIN ({splits}) s ON s.node = a.node)",
        f"{name}_leaf AS MATERIALIZED (SELECT l.k, l.split, n.value FROM (SELECT k, split, max(node) AS node FROM {name}_all GROUP BY k, split) l "
        f"JOIN {name}_nodes n ON n.node = l.node)",
    ]
