"""A suffix tree of a sequence of numbers, with longest common extensions in constant time.

Ukkonen's construction, left to right with suffix links. Edges live in one dictionary
keyed by (node, first symbol), so the alphabet may be as large as the sequence. After the
construction one walk over the tree, children in the order of their symbols, writes the Euler
tour of string depths; the common prefix of two suffixes is the depth of their
leaves' lowest common ancestor: the minimum of the tour between them, told by a sparse table.

Memory is about 600 bytes per symbol while a tree stands.
"""

from __future__ import annotations

import numpy as np


def _construct(s: list[int]) -> tuple[dict[int, int], list[int], list[int], int]:
    """(edges, starts, ends, shift) of the suffix tree of ``s``, whose last symbol occurs once.

    ``edges[(node << shift) + symbol]`` is the child; its edge is s[starts[child]:ends[child]].
    """
    n = len(s)
    shift = max(s).bit_length() + 1
    starts, ends, links = [0], [0], [0]  # node 0 is the root
    edges: dict[int, int] = {}
    node = edge = length = 0  # where the longest suffix that is still implicit ends
    remaining = 0
    for i in range(n):
        symbol = s[i]
        remaining += 1
        last = 0
        while remaining:
            if not length:
                edge = i
            key = (node << shift) + s[edge]
            child = edges.get(key)
            if child is None:
                edges[key] = len(starts)
                starts.append(i)
                ends.append(n)
                links.append(0)
                if last:
                    links[last] = node
                last = 0
            else:
                span = ends[child] - starts[child]
                if length >= span:
                    edge += span
                    length -= span
                    node = child
                    continue
                at = starts[child] + length
                if s[at] == symbol:
                    if last:
                        links[last] = node
                    length += 1
                    break
                fork = len(starts)
                starts += (starts[child], i)
                ends += (at, n)
                links += (0, 0)
                edges[key] = fork
                edges[(fork << shift) + symbol] = fork + 1
                starts[child] = at
                edges[(fork << shift) + s[at]] = child
                if last:
                    links[last] = fork
                last = fork
            remaining -= 1
            if node:
                node = links[node]
            elif length:
                length -= 1
                edge = i - remaining + 1
    return edges, starts, ends, shift


class SuffixTree:
    """The suffix tree of ``sequence`` (numbers from 1 on; the end is marked by 0, the smallest symbol)."""

    def __init__(self, sequence: np.ndarray):
        self.size = len(sequence)
        edges, starts, ends, shift = _construct([*np.asarray(sequence, dtype=np.int64).tolist(), 0])
        nodes = len(starts)
        keys = np.fromiter(edges.keys(), dtype=np.int64, count=len(edges))
        order = np.argsort(keys)
        children = np.fromiter(edges.values(), dtype=np.int64, count=len(edges))[order].tolist()
        first = np.searchsorted(keys[order] >> shift, np.arange(nodes + 1)).tolist()
        self._children, self._first = children, first
        self._depth = depth = [0] * nodes
        lengths = (np.array(ends) - np.array(starts)).tolist()
        tour: list[int] = [0]  # string depths in the order of the walk
        visit = [0] * (self.size + 1)  # suffix -> place of its leaf in the tour
        suffixes: list[int] = []  # in lexicographic order
        at = first[:-1]
        path = [0]
        end = self.size + 1
        while path:
            node = path[-1]
            i = at[node]
            if i < first[node + 1]:
                at[node] = i + 1
                child = children[i]
                below = depth[node] + lengths[child]
                depth[child] = below
                if first[child] == first[child + 1]:  # a leaf: there and back
                    suffix = end - below
                    visit[suffix] = len(tour)
                    suffixes.append(suffix)
                    tour += (below, depth[node])
                else:
                    tour.append(below)
                    path.append(child)
            else:
                path.pop()
                if path:
                    tour.append(depth[path[-1]])
        self._visit = np.array(visit)
        self._suffixes = suffixes
        self._table = [np.array(tour, dtype=np.int32)]
        width = 1
        while 2 * width <= len(tour):
            row = self._table[-1]
            self._table.append(np.minimum(row[:-width], row[width:]))
            width *= 2

    def ranks(self, descending: bool = False) -> np.ndarray:
        """Suffix -> its place among all suffixes, symbols compared upwards or downwards;
        an end of the sequence comes before every symbol either way."""
        out = np.empty(self.size + 1, dtype=np.int64)
        out[self._downwards() if descending else self._suffixes] = np.arange(self.size + 1)
        return out

    def _downwards(self) -> list[int]:
        children, first, depth, out, open_ = self._children, self._first, self._depth, [], [0]
        end = self.size + 1
        while open_:
            node = open_.pop()
            low, high = first[node], first[node + 1]
            if low == high:
                out.append(end - depth[node])
                continue
            open_ += children[low:high]
            # The end's leaf is the first child wherever there is one: its edge is the end alone.
            leaf = children[low]
            if first[leaf] == first[leaf + 1] and depth[leaf] == depth[node] + 1 and end - depth[leaf] + depth[node] == self.size:
                del open_[low - high]
                open_.append(leaf)
        return out

    def extensions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes a[i] and b[i], a[i] != b[i]; places up to the size."""
        x, y = self._visit[a], self._visit[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for k in np.unique(level):
            mine = level == k
            row = self._table[k]
            out[mine] = np.minimum(row[low[mine]], row[high[mine] - (1 << int(k)) + 1])
        return out
