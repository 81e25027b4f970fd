"""Karmarkar-Karp multiway differencing on numpy arrays."""

from __future__ import annotations

import heapq

import numpy as np


def differencing(sizes: np.ndarray, ways: int) -> np.ndarray:
    """A way below `ways` for every size, so that the ways' sums are near equal.

    Each size begins as a partial partition with one filled way. The two
    partial partitions with the largest spread are combined again and again,
    the fullest ways of one meeting the emptiest of the other, until one is
    left. A partial partition stores only its spread profile (sums less the
    smallest sum); walking the combinations back gives each size its way.
    """
    n = len(sizes)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    if ways == 1:
        return np.zeros(n, dtype=np.int64)
    profiles: dict[int, np.ndarray] = {}
    heap = []
    for i, size in enumerate(sizes.tolist()):
        heap.append((-size, i))
    heapq.heapify(heap)

    def profile(node: int) -> np.ndarray:
        if node < n:
            one = np.zeros(ways, dtype=np.int64)
            one[0] = sizes[node]
            return one
        return profiles.pop(node)

    merged: list[tuple[int, int, np.ndarray]] = []
    kind = np.int16 if ways < 32768 else np.int32
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = profile(a) + profile(b)[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        total -= total[-1]
        node = n + len(merged)
        merged.append((a, b, order.astype(kind)))
        profiles[node] = total
        heapq.heappush(heap, (-int(total[0]), node))

    way = np.zeros(n, dtype=np.int64)
    places: dict[int, np.ndarray] = {heap[0][1]: np.arange(ways, dtype=kind)}
    for k in range(len(merged) - 1, -1, -1):
        a, b, order = merged[k]
        merged[k] = None  # frees the order
        place = places.pop(n + k)
        mine = np.empty(ways, dtype=kind)
        mine[order] = place
        for node, its in ((a, mine), (b, mine[::-1])):
            if node < n:
                way[node] = its[0]
            else:
                places[node] = its
    if n == 1:
        way[0] = 0
    return way
