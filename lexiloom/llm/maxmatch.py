"""Longest-match subword counts in linear time.

A trie over the vocabulary gets failure links: when a node has no edge for the next character, the
link leads to the node where the rest of what was read continues, and the number of tokens that
leave on the way is stored with the link. Counting a word is then one walk, each character read
once. Two roots tell word starts from continuations.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable


class MaxMatchTrie:
    """Counts of greedy longest matches. ``tokens`` start a word, ``continuations`` go on in one (by default the same)."""

    def __init__(self, tokens: Iterable[str], continuations: Iterable[str] | None = None) -> None:
        first = [t for t in tokens if t]
        inner = first if continuations is None else [t for t in continuations if t]
        self.edges: list[dict[str, int]] = [{}, {}]
        depth, final = [0, 0], [False, False]
        for root, words in ((0, first), (1, inner)):
            for w in words:
                v = root
                for c in w:
                    nxt = self.edges[v].get(c)
                    if nxt is None:
                        nxt = self.edges[v][c] = len(self.edges)
                        self.edges.append({})
                        depth.append(depth[v] + 1)
                        final.append(False)
                    v = nxt
                final[v] = True
        n = len(self.edges)
        self.link, self.emits, self.final = [-1] * n, [0] * n, final
        queue = deque((p, c, v) for p in (0, 1) for c, v in self.edges[p].items())
        while queue:
            parent, char, v = queue.popleft()
            queue.extend((v, c, w) for c, w in self.edges[v].items())
            if final[v]:
                self.link[v], self.emits[v] = 1, 1
                continue
            z, out = self.link[parent], self.emits[parent]
            while z >= 0 and char not in self.edges[z]:
                out += self.emits[z]
                z = self.link[z]
            if z >= 0:
                self.link[v], self.emits[v] = self.edges[z][char], out

    def count(self, word: str) -> int | None:
        """Number of tokens of a word, or null if no segmentation by longest match exists."""
        v, out = 0, 0
        for c in word:
            while (nxt := self.edges[v].get(c)) is None:
                if self.link[v] < 0:
                    return None
                out += self.emits[v]
                v = self.link[v]
            v = nxt
        while v != 1:
            if self.link[v] < 0:
                return None if v else out
            out += self.emits[v]
            v = self.link[v]
        return out
