"""Minimum cuts of labelling graphs: which of two labels each node gets, given costs of nodes and of edges between them."""

from __future__ import annotations

from collections import deque


def labelled(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The labels with the greatest sum of ``gain`` of the true nodes, less the weights of ``edges`` (a, b, weight) whose ends differ.

    A node whose gain outweighs all its open edges has the same label in some best labelling, so it is settled at once and
    its edges become gains of its neighbours; what stays open is told by a maximum flow. Of several best labellings the
    one is given that settles first, the same on every run.
    """
    n = len(gain)
    gain = list(gain)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    held = [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(gain[i]) >= held[i]:
            label[i] = gain[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    gain[j] += w if label[i] else -w
                    held[j] -= w
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        place = {i: k for k, i in enumerate(rest)}
        inner = [(place[i], place[j], w) for i in rest for j, w in near[i].items() if j > i and label[j] is None]
        for i, side in zip(rest, source_side([gain[i] for i in rest], inner)):
            label[i] = side
    return [bool(x) for x in label]


def source_side(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Nodes on the source's side of a minimum cut: gains above 0 are capacities from the source, those below to the sink.

    Flows go along shortest paths, blocked level by level.
    """
    n = len(gain)
    source, sink = n, n + 1
    out: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def join(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, g in enumerate(gain):
        if g > 0:
            join(source, i, g, 0)
        elif g < 0:
            join(i, sink, -g, 0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        line = deque([source])
        while line:
            a = line.popleft()
            for e in out[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    line.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        tried = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                full = next(k for k, e in enumerate(path) if not room[e])
                at = to[path[full] ^ 1]
                del path[full:]
                continue
            edges_of = out[at]
            while tried[at] < len(edges_of):
                e = edges_of[tried[at]]
                if room[e] and level[to[e]] == level[at] + 1:
                    break
                tried[at] += 1
            if tried[at] < len(edges_of):
                path.append(edges_of[tried[at]])
                at = to[path[-1]]
            elif path:
                at = to[path.pop() ^ 1]
                tried[at] += 1
            else:
                break
