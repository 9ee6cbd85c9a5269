"""Minimum-cost flow on small integer networks (successive shortest paths with potentials)."""

from __future__ import annotations

import heapq
from collections import defaultdict


class Network:
    """A directed network; nodes are any hashable values, capacities integers, costs non-negative integers."""

    def __init__(self) -> None:
        self.arcs: list[list] = []  # to, free capacity, cost; arc k ^ 1 is the reverse of arc k
        self.out: dict = defaultdict(list)

    def arc(self, a, b, capacity: int, cost: int = 0) -> int:
        """Add an arc; its number is used to ask for its flow."""
        self.out[a].append(len(self.arcs))
        self.arcs.append([b, capacity, cost])
        self.out[b].append(len(self.arcs))
        self.arcs.append([a, 0, -cost])
        return len(self.arcs) - 2

    def flow(self, number: int) -> int:
        return self.arcs[number ^ 1][1]

    def send(self, source, sink, most: int) -> int:
        """Send up to `most` units at the least cost; returns how many could be sent."""
        sent, potential = 0, defaultdict(int)
        while sent < most:
            distance, via, heap, tie = {source: 0}, {}, [(0, 0, source)], 1
            while heap:
                d, _, a = heapq.heappop(heap)
                if d > distance[a]:
                    continue
                for k in self.out[a]:
                    b, free, cost = self.arcs[k]
                    if free > 0 and (new := d + cost + potential[a] - potential[b]) < distance.get(b, float("inf")):
                        distance[b], via[b] = new, k
                        heapq.heappush(heap, (new, tie, b))
                        tie += 1
            if sink not in distance:
                break
            # nodes that weren't reached stay as far away as the sink at least
            for node in list(self.out):
                potential[node] += min(distance.get(node, distance[sink]), distance[sink])
            path, node = [], sink
            while node != source:
                path.append(via[node])
                node = self.arcs[via[node] ^ 1][0]
            push = min(most - sent, *(self.arcs[k][1] for k in path))
            for k in path:
                self.arcs[k][1] -= push
                self.arcs[k ^ 1][1] += push
            sent += push
        return sent
