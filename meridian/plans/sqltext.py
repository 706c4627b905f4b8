"""Pieces of SQL that the oracles share."""

from __future__ import annotations

from meridian.functions.xxhash import P1, P2, P3, P4, P5
from meridian.operators import placement

M = "18446744073709551616::UHUGEINT"


def l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda p: p[1] * p[2]))"


def cosine(a: str, b: str) -> str:
    den = f"(sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"
    return f"CASE WHEN {den} = 0 THEN 1.0 ELSE 1.0 - greatest(-1.0, least(1.0, {dot(a, b)} / {den})) END"


def _u(x: int) -> str:
    return f"{x}::UHUGEINT"


def hashed(source: str, name: str = "h") -> str:
    """CTEs that end in {name}(id, h): XXH64 with seed 0 of the distinct ids of a source query."""
    steps = [
        ("k", f"(v * {_u(P2)}) % {M}"),
        ("k", f"((k * {_u(1 << 31)}) % {M} + k // {_u(1 << 33)}) * {_u(P1)} % {M}"),
        ("x", f"xor({_u((P5 + 8) % (1 << 64))}, k)"),
        ("x", f"(((x * {_u(1 << 27)}) % {M} + x // {_u(1 << 37)}) * {_u(P1)} % {M} + {_u(P4)}) % {M}"),
        ("x", f"xor(x, x // {_u(1 << 33)}) * {_u(P2)} % {M}"),
        ("x", f"xor(x, x // {_u(1 << 29)}) * {_u(P3)} % {M}"),
        ("x", f"xor(x, x // {_u(1 << 32)})"),
    ]
    out = [f"{name}0 AS (SELECT DISTINCT id, id::UHUGEINT AS v FROM ({source}))"]
    for i, (col, e) in enumerate(steps):
        keep = {0: "id", 1: "id", 2: "id"}.get(i, "id")
        out.append(f"{name}{i + 1} AS (SELECT {keep}, {e} AS {col} FROM {name}{i})")
    out.append(f"{name} AS (SELECT id, x AS h FROM {name}{len(steps)})")
    return ", ".join(out)


LOG = (
    "wlog AS (SELECT event_id AS seq, user_id AS id, (epoch_us(ts) // 1000) * 65536 + event_id % 65536 AS hlc, "
    "event_type = 'error' AS tombstone, props AS payload, event_id % 3 AS node_id FROM events)"
)
#: The log with its arrival shuffled and its stamps coarsened, so that writes arrive late and tie.
LATE = LOG + ", late AS (SELECT (seq * 7919) % (SELECT count(*) FROM events) AS seq, id, hlc // 17592186044416 AS hlc, tombstone, payload, node_id FROM wlog)"


def winners(log: str, key: str = "id") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY hlc DESC, seq) AS rn FROM {log}) WHERE rn = 1)"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    def lit(x):
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else str(x)

    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


def ring(name: str, nodes: list[int]) -> str:
    rows = ", ".join(f"({n}, {p}::UHUGEINT)" for p, n in placement.ring(nodes))
    return f"{name}(node_id, pos) AS (VALUES {rows})"


def homes(collections: list[tuple[str, int, int]]) -> str:
    rows = ", ".join(f"('{c}', {s}, {n}, {placement.shard_home(c, s)}::UHUGEINT)" for c, k, n in collections for s in range(k))
    return f"homes(collection, shard_idx, n, home) AS (VALUES {rows})"


def placed(name: str, ring_name: str) -> str:
    """CTE of the replicas by clockwise distance."""
    return (
        f"{name}_d AS (SELECT collection, shard_idx, n, node_id, min((pos + {M} - home) % {M}) AS gap FROM homes, {ring_name} GROUP BY ALL), "
        f"{name} AS (SELECT collection, shard_idx, rank, node_id FROM (SELECT *, row_number() OVER (PARTITION BY collection, shard_idx ORDER BY gap, node_id) - 1 AS rank FROM {name}_d) WHERE rank < n)"
    )
