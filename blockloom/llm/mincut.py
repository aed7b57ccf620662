"""Binary labelling by minimum cut: terminal capacities from a classifier, smoothness edges between neighbours."""

from __future__ import annotations

from collections import deque


def _max_flow(n: int, arcs: list[tuple[int, int, float, float]], s: int, t: int) -> list[bool]:
    """Which nodes stay on the side of ``s`` after a maximum flow (Dinic)."""
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b, forth, back in arcs:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)
    while True:
        level = [-1] * n
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level]
        at = [0] * n
        path: list[int] = []
        a = s
        while True:
            if a == t:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                path, a = [], s
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if cap[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(out[a]):
                path.append(out[a][at[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break


def alone(costs: list[tuple[float, float]]) -> list[bool]:
    """The labels that nodes would take without edges; ties go to the second label."""
    return [a < b for a, b in costs]


def label(costs: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it takes the first label, so that the sum of the costs of the labels taken and of the
    edges between different labels is least. Ties go to the second label.

    A node whose costs differ by more than the weight of its edges takes the cheaper label in any least cut; it is
    fixed, and its edges become costs of its neighbours, which may fix them in turn. The components of what is left are
    cut by a maximum flow.
    """
    near: list[list[tuple[int, float]]] = [[] for _ in costs]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    gain = [b - a for a, b in costs]  # above 0: the first label is cheaper
    slack = [sum(w for _, w in e) for e in near]
    fixed: list[bool | None] = [None] * len(costs)
    todo = [k for k in range(len(costs)) if abs(gain[k]) > slack[k] or not near[k]]
    while todo:
        a = todo.pop()
        if fixed[a] is not None:
            continue
        fixed[a] = gain[a] > 0
        for b, w in near[a]:
            if fixed[b] is None:
                gain[b] += w if fixed[a] else -w
                slack[b] -= w
                if abs(gain[b]) > slack[b] + 1e-9:
                    todo.append(b)
    for start in range(len(costs)):
        if fixed[start] is not None:
            continue
        part, at, stack = [], {start: 0}, [start]
        while stack:
            a = stack.pop()
            part.append(a)
            for b, _ in near[a]:
                if fixed[b] is None and b not in at:
                    at[b] = 0
                    stack.append(b)
        at = {a: i for i, a in enumerate(part)}
        s, t = len(part), len(part) + 1
        arcs = [(at[a], at[b], w, w) for a in part for b, w in near[a] if b in at and at[a] < at[b]]
        arcs += [(s, i, max(gain[a], 0.0), 0.0) for a, i in at.items()] + [(i, t, max(-gain[a], 0.0), 0.0) for a, i in at.items()]
        side = _max_flow(len(part) + 2, arcs, s, t)
        for a, i in at.items():
            fixed[a] = side[i]
    return [bool(x) for x in fixed]
