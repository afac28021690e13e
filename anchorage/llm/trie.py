"""Counts of word sequences in a burstable trie with hash containers as leaves.

A key is a sequence of four-byte numbers. The first ``HEAD`` bytes choose a subtree; a
subtree starts as one hash container, and a container that grows beyond ``BURST``
entries bursts into a node with a container for every next number. When the trie holds
``LIMIT`` entries, whole subtrees leave it, largest first, until half of it is free.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

STEP = 4
#: A subtree holds one language and first word.
HEAD = 2 * STEP
BURST = 8_192
LIMIT = 500_000


class Node(dict):
    """Children by the next number of the key; the child of b"" holds the key that ends here."""


class HatTrie:
    def __init__(self, burst: int = BURST):
        self.burst = burst
        self.root: dict[bytes, dict] = {}
        self.sizes: Counter = Counter()
        self.entries = 0

    def add(self, keys: Iterable[bytes], counts: Iterable[int]) -> None:
        for key, n in zip(keys, counts):
            head = key[:HEAD]
            parent, name, at = self.root, head, HEAD
            child = parent.get(head)
            if child is None:
                child = parent[head] = {}
            while type(child) is Node:
                parent, name = child, key[at : at + STEP]
                at += STEP
                child = parent.get(name)
                if child is None:
                    child = parent[name] = {}
            rest = key[at:]
            seen = child.get(rest)
            if seen is None:
                child[rest] = n
                self.sizes[head] += 1
                self.entries += 1
                if len(child) > self.burst:
                    parent[name] = self._burst(child)
            else:
                child[rest] = seen + n

    @staticmethod
    def _burst(container: dict[bytes, int]) -> Node:
        node = Node()
        for rest, n in container.items():
            child = node.setdefault(rest[:STEP], {})
            child[rest[STEP:]] = n
        return node

    def _walk(self, prefix: bytes, child: dict) -> Iterator[tuple[bytes, int]]:
        if type(child) is Node:
            for name, below in child.items():
                yield from self._walk(prefix + name, below)
        else:
            for rest, n in child.items():
                yield prefix + rest, n

    def spill(self, left: int) -> Iterator[list[tuple[bytes, int]]]:
        """Take out whole subtrees, largest first, until at most ``left`` entries remain."""
        for head, n in self.sizes.most_common() if self.entries > left else ():
            if self.entries <= left:
                break
            yield list(self._walk(head, self.root.pop(head)))
            del self.sizes[head]
            self.entries -= n
