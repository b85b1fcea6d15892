"""Oracle SQL for eigenvalues."""

from __future__ import annotations


def spectrum(name: str, matrix: str, keys: str = "", squarings: int = 26) -> str:
    """CTEs that square the positive matrix ``matrix`` (i, j, m) until its first eigenvector is left.

    ``{name}_v`` is its projector, ``{name}_l`` the eigenvalue and ``{name}_d`` the matrix without them.
    """
    k, on = (f"{keys}, ", f" AND a.{keys} = b.{keys}") if keys else ("", "")
    using = f"USING ({keys})" if keys else "ON true"
    by = f"GROUP BY {keys}" if keys else ""
    own = f"a.{keys}, " if keys else ""
    out, last = [], matrix
    for n in range(squarings):
        out.append(f"{name}_t{n} AS MATERIALIZED (SELECT {k}sum(m) FILTER (i = j) AS t FROM {last} {by})")
        out.append(f"{name}_{n} AS MATERIALIZED (SELECT {own}a.i, b.j, sum(a.m / t.t * b.m / t.t) AS m FROM {last} a JOIN {last} b ON a.j = b.i{on} JOIN {name}_t{n} t {using if not keys else f'ON t.{keys} = a.{keys}'} WHERE t.t > 1e-300 GROUP BY ALL)")
        last = f"{name}_{n}"
    out.append(f"{name}_t AS MATERIALIZED (SELECT {k}sum(m) FILTER (i = j) AS t FROM {last} {by})")
    out.append(f"{name}_v AS MATERIALIZED (SELECT {own}i, j, m / t AS m FROM {last} a JOIN {name}_t t {'ON t.' + keys + ' = a.' + keys if keys else 'ON true'})")
    out.append(f"{name}_l AS MATERIALIZED (SELECT {own}sum(a.m * b.m) AS l FROM {name}_v a JOIN {matrix} b ON a.i = b.j AND a.j = b.i{on} {'GROUP BY a.' + keys if keys else ''})")
    out.append(f"{name}_d AS MATERIALIZED (SELECT {own}a.i, a.j, a.m - coalesce(l.l * b.m, 0) AS m FROM {matrix} a LEFT JOIN {name}_v b ON a.i = b.i AND a.j = b.j{on} LEFT JOIN {name}_l l {'ON l.' + keys + ' = a.' + keys if keys else 'ON true'})")
    return ",\n".join(out)
