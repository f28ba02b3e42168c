"""Minimum cut of a labelling problem by blocking flows."""

from __future__ import annotations


def content_side(gains: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of least cost, as the source side of a minimum cut.

    A node with gain g > 0 costs g if it is not on the source side, one with
    g < 0 costs -g if it is.  An edge (i, j, w) costs w if its ends differ.
    Of several minimum cuts, the one with the smallest source side.
    """
    n = len(gains)
    spare = list(gains)                     # what the source can still send, or the sink take (below 0)
    edges = _settle(spare, edges)
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for i, j, w in edges:
        if w > 0 and i != j:
            out[i].append(len(to))
            to.append(j)
            room.append(w)
            out[j].append(len(to))
            to.append(i)
            room.append(w)
    while True:
        # Distances from the nodes that the source still feeds.
        level = [-1] * n
        layer = [i for i in range(n) if spare[i] > 0]
        for i in layer:
            level[i] = 0
        sink = False
        depth = 0
        while layer and not sink:
            depth += 1
            ahead = []
            for i in layer:
                for e in out[i]:
                    j = to[e]
                    if room[e] and level[j] < 0:
                        level[j] = depth
                        ahead.append(j)
                        sink = sink or spare[j] < 0
            layer = ahead
        if not sink:
            break
        _blocking_flow(spare, to, room, out, level, depth)
    side = [g > 0 for g in spare]
    reach = [i for i in range(n) if side[i]]
    while reach:
        i = reach.pop()
        for e in out[i]:
            if room[e] and not side[to[e]]:
                side[to[e]] = True
                reach.append(to[e])
    return side


def _settle(spare: list[int], edges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Decide nodes that gain more than all their edges can cost; the edges left between the others.

    A decided node's edges become gains of its neighbours, which may decide
    them in turn.  Most pages are settled whole.
    """
    near: list[list[tuple[int, int]]] = [[] for _ in spare]
    pull = [0] * len(spare)
    for i, j, w in edges:
        near[i].append((j, w))
        near[j].append((i, w))
        pull[i] += w
        pull[j] += w
    done = [False] * len(spare)
    ready = [i for i, g in enumerate(spare) if abs(g) > pull[i]]
    while ready:
        i = ready.pop()
        if done[i]:
            continue
        done[i] = True
        for j, w in near[i]:
            if not done[j]:
                spare[j] += w if spare[i] > 0 else -w
                pull[j] -= w
                if abs(spare[j]) > pull[j]:
                    ready.append(j)
    return [(i, j, w) for i, j, w in edges if not done[i] and not done[j]]


def _blocking_flow(spare, to, room, out, level, depth) -> None:
    """Send flow along shortest ways from fed nodes to nodes that the sink drains until none is left."""
    at = [0] * len(spare)
    for start in range(len(spare)):
        if level[start] != 0:
            continue
        way: list[int] = []
        i = start
        while spare[start] > 0:
            if spare[i] < 0 and level[i] == depth:
                amount = min(spare[start], -spare[i], *(room[e] for e in way))
                spare[start] -= amount
                spare[i] += amount
                for e in way:
                    room[e] -= amount
                    room[e ^ 1] += amount
                # Go on from the first full edge of the way.
                for k, e in enumerate(way):
                    if not room[e]:
                        i = to[e ^ 1]
                        del way[k:]
                        break
                continue
            edges = out[i]
            while at[i] < len(edges):
                e = edges[at[i]]
                if room[e] and level[to[e]] == level[i] + 1 <= depth:
                    break
                at[i] += 1
            if at[i] < len(edges):
                way.append(edges[at[i]])
                i = to[way[-1]]
            elif way:
                back = way.pop()
                i = to[back ^ 1]
                at[i] += 1
            else:
                break
