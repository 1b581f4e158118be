"""Clusters of one project at a time, for projects whose findings are few. Pure Python: it travels to the workers by value.

The steps and their order are those of ``converge.cluster_findings``; a unit is [uid, agents, members, *keys].
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa

MODES = ("exact", "semantic_tuple", "location", "rule")
ROWS = 20_000


def _merged(units: list[list], pairs: list[tuple]) -> list[list]:
    """Move each joining unit into the unit it joins; a key stays where all agree on it."""
    to: dict = {}
    for uid, joins in pairs:
        to.setdefault(joins, []).append(uid)
    groups: dict = {}
    for u in units:
        for uid in to.get(u[0], (u[0],)):
            groups.setdefault(uid, []).append(u)
    out = []
    for uid, g in groups.items():
        keys = [k[0] if k.count(k[0]) == len(k) else None for k in zip(*(u[3:] for u in g))]
        out.append([uid, [a for u in g for a in u[1]], sorted(m for u in g for m in u[2]), *keys])
    return out


def _by_rank(units: list[list], key: int, route: str) -> list[tuple]:
    """Of each key, the i-th unit without the route and the i-th single finding of it."""
    lacking: dict = {}
    single: dict = {}
    for u in units:
        if u[key] is not None:
            if route not in u[1]:
                lacking.setdefault(u[key], []).append(u[0])
            elif len(u[1]) == 1:
                single.setdefault(u[key], []).append(u[0])
    return [p for k, uids in lacking.items() if k in single for p in zip(sorted(uids), sorted(single[k]))]


def _by_links(units: list[list], edges: list[tuple], route: str, agent_of: dict) -> list[tuple]:
    """Going through the units without the route in order, each takes its first free finding that all its members are linked to."""
    reach: dict = {}
    for left, right in edges:
        for m, v in ((left, right), (right, left)):
            if agent_of[v] == route:
                reach.setdefault(m, []).append(v)
    free = {u[0] for u in units if len(u[1]) == 1 and route in u[1]}
    pairs = []
    for u in sorted(units, key=lambda u: u[0]):
        if route not in u[1]:
            met = Counter(v for m in u[2] for v in reach.get(m, ()) if v in free)
            v = min((v for v, n in met.items() if n == len(u[2])), default=None)
            if v is not None:
                free.remove(v)
                pairs.append((u[0], v))
    return pairs


def settle(findings: list[tuple], routes: list[str]) -> list[tuple]:
    """(ord, cluster_id, match_mode) of each member. ``findings``: (ord, agent, four keys, ords of linked findings before it,
    names of these links)."""
    agent_of = {f[0]: f[1] for f in findings}
    units = [[f[0], [f[1]], [f[0]], *f[2]] for f in findings]
    out = []
    whole = len(agent_of) == len(units)
    for k, mode in enumerate(MODES, 3):
        for s in routes[1:]:
            pairs = _by_rank(units, k, s)
            if pairs or not whole:
                units, whole = _merged(units, pairs), True
        if mode == "exact":
            # clusters of equal keys are complete; only findings that stayed alone go on
            out += [(m, u[0], mode) for u in units if len(u[1]) > 1 for m in u[2]]
            units = [u for u in units if len(u[1]) == 1]
    lacking = {m for u in units if len(u[1]) < len(routes) for m in u[2]}
    # a link counts once for each pair of ids and each score, also where several findings have one position
    edges = [e[:2] for e in {(left, f[0], name) for f in findings if f[0] in lacking for left, name in zip(f[3], f[4]) if left in lacking}]
    for s in routes[1:]:
        pairs = _by_links(units, edges, s, agent_of)
        if pairs:
            units = _merged(units, pairs)
    return out + [(m, u[0], "similarity" if len(u[2]) > 1 else "single") for u in units for m in u[2]]


def settled(routes: list[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: rows (project, ord, agent, keys, links, names), of which those of a project follow each other."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = [[] for _ in schema]
        project, held = None, []

        def close() -> None:
            for row in settle(held, routes):
                for column, value in zip(done, (project, *row)):
                    column.append(value)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(done, schema)], schema=schema)

        for b in batches:
            names, *cols = (c.to_pylist() for c in b.columns)
            for name, ord_, agent, k1, k2, k3, k4, links, same in zip(names, *cols):
                if held and name != project:
                    close()
                    held = []
                    if len(done[0]) >= ROWS:
                        yield batch()
                        done = [[] for _ in schema]
                project = name
                held.append((ord_, agent, (k1, k2, k3, k4), links, same))
        if held:
            close()
        yield batch()

    return work
