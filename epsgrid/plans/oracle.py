"""DuckDB SQL builders for the correctness oracle.

The detection oracle is a brute-force self-join that does *not* use the
engine's grid: points are bucketed by ``floor(x / eps)`` on up to two axes
(an equi-key so DuckDB hash-joins), every pair of adjacent buckets is
checked with the exact distance, core = at least ``min_pts`` near points
(self included), outlier = not core and no near core point.  Cell-level
queries (cell counts, adjacency, cell types) use the grid's defining formula
directly.
"""

from __future__ import annotations

import math


def num(v: float) -> str:
    """A DOUBLE literal with exactly the value of the Python float."""
    return f"CAST('{float(v)!r}' AS DOUBLE)"


class BruteForce:
    def __init__(self, point_sql: str, keys: list[str], feats: list[str], eps: float,
                 min_pts: int, inclusive: bool = False, prefix: str = ""):
        self.point_sql, self.keys, self.feats = point_sql, keys, feats
        self.eps, self.min_pts, self.inclusive, self.p = eps, min_pts, inclusive, prefix
        self.dim = len(feats)

    def t(self, name: str) -> str:
        return f"{self.p}{name}"

    # ---------------------------------------------------------------- points
    def ctes(self, grid: bool = False) -> list[str]:
        p, E, d = self.t, num(self.eps), self.dim
        pid = self.keys[0] if len(self.keys) == 1 else \
            f"row_number() OVER (ORDER BY {', '.join(self.keys)})"
        m = min(2, d)
        ks = ", ".join(f"CAST(floor({self.feats[i]} / {E}) AS BIGINT) AS k{i}" for i in range(m))
        fs = ", ".join(self.feats)
        offs = " CROSS JOIN ".join(f"(SELECT unnest([-1, 0, 1]) AS o{i}) t{i}" for i in range(m))
        on = " AND ".join(f"c.k{i} = a.k{i} + o.o{i}" for i in range(m))
        dist = " + ".join(f"(a.{f} - c.{f}) * (a.{f} - c.{f})" for f in self.feats)
        cmp = "<=" if self.inclusive else "<"
        out = [
            f"{p('pts')} AS (SELECT *, {pid} AS pid FROM ({self.point_sql}) s)",
            f"{p('b')} AS (SELECT pid, {fs}, {ks} FROM {p('pts')})",
            f"{p('offs')} AS (SELECT * FROM {offs})",
            f"{p('pairs')} AS (SELECT a.pid AS aid, c.pid AS bid, sqrt({dist}) AS dist "
            f"FROM {p('b')} a CROSS JOIN {p('offs')} o JOIN {p('b')} c ON {on} "
            f"WHERE sqrt({dist}) {cmp} {E})",
            f"{p('cnt')} AS (SELECT aid AS pid, count(*) AS cnt FROM {p('pairs')} GROUP BY aid)",
            f"{p('core')} AS (SELECT pid FROM {p('cnt')} WHERE cnt >= {int(self.min_pts)})",
            f"{p('nearcore')} AS (SELECT DISTINCT pr.aid AS pid FROM {p('pairs')} pr "
            f"JOIN {p('core')} k ON pr.bid = k.pid)",
            f"{p('lab')} AS (SELECT x.*, CASE WHEN k.pid IS NOT NULL THEN 'core' "
            f"WHEN nc.pid IS NOT NULL THEN 'border' ELSE 'outlier' END AS label "
            f"FROM {p('pts')} x LEFT JOIN {p('core')} k ON x.pid = k.pid "
            f"LEFT JOIN {p('nearcore')} nc ON x.pid = nc.pid)",
        ]
        if grid:
            out += self.grid_ctes()
        return out

    # ---------------------------------------------------------------- grid
    def C(self, alias: str = "") -> list[str]:
        a = f"{alias}." if alias else ""
        return [f"{a}c{i}" for i in range(self.dim)]

    def grid_ctes(self) -> list[str]:
        p, E, d = self.t, num(self.eps), self.dim
        S = num(math.sqrt(d))
        cs = ", ".join(f"CAST(floor({f} / {E} * {S}) AS BIGINT) AS c{i}" for i, f in enumerate(self.feats))
        C = ", ".join(self.C())
        delta = int(math.ceil(math.sqrt(d)))
        box = " AND ".join(f"b.c{i} BETWEEN a.c{i} - {delta} AND a.c{i} + {delta}" for i in range(d))
        gap = " + ".join(f"greatest(abs(a.c{i} - b.c{i}) - 1, 0) * greatest(abs(a.c{i} - b.c{i}) - 1, 0)"
                         for i in range(d))
        return [
            f"{p('g')} AS (SELECT pid, {', '.join(self.feats)}, {cs} FROM {p('pts')})",
            f"{p('cells')} AS (SELECT {C}, count(*) AS n FROM {p('g')} GROUP BY {C})",
            f"{p('adj')} AS (SELECT {', '.join(self.C('a'))}, "
            f"{', '.join(f'b.c{i} AS n{i}' for i in range(d))}, b.n AS n_nb, ({gap}) AS gap "
            f"FROM {p('cells')} a JOIN {p('cells')} b ON {box} WHERE ({gap}) < {d})",
            f"{p('corecells')} AS (SELECT DISTINCT {', '.join(self.C('g'))}, 1 AS has_core "
            f"FROM {p('g')} g JOIN {p('core')} k ON g.pid = k.pid)",
            f"{p('typed')} AS (SELECT c.*, CASE WHEN c.n >= {int(self.min_pts)} THEN 'DENSE' "
            f"WHEN cc.has_core IS NOT NULL THEN 'CORE' ELSE 'OTHER' END AS cell_type "
            f"FROM {p('cells')} c LEFT JOIN {p('corecells')} cc ON "
            + " AND ".join(f"c.c{i} = cc.c{i}" for i in range(d)) + ")",
        ]


def with_ctes(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
