"""A Patricia (compressed radix) trie over byte strings whose terminal nodes hold the owner of each
string and the number of its rows. When nodes and strings exceed a memory budget, the largest subtree goes
to a task-local scratch file and is finished from there after the rest."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator


#: Bytes that a node takes beside its edge: the object, its table of children, its place in its parent's.
NODE = 300


class _Node:
    __slots__ = ("below", "edge", "file", "owner", "rows", "size")

    def __init__(self, edge: bytes) -> None:
        self.edge, self.below, self.owner, self.rows, self.file, self.size = edge, {}, None, 0, None, NODE + len(edge)


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``: the span doubles, then halves, so that
    bytes are compared in bulk."""
    top = min(len(a), len(b) - at)
    if a[:top] == b[at : at + top]:
        return top
    lo, step = 0, 16
    while a[lo : lo + step] == b[at + lo : at + lo + step]:
        lo, step = lo + step, step * 2
    hi = min(lo + step, top)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _load(file) -> Iterator[tuple[bytes, object, int]]:
    """The items of a scratch file, which is closed behind them."""
    file.seek(0)
    with file:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


class OwnerTrie:
    """``better(new, old)`` tells if an identifier takes a string over from the one that owns it."""

    def __init__(self, better, budget: int = 64 << 20) -> None:
        self.better, self.budget, self.held, self.spills = better, budget, 0, 0
        self.root = _Node(b"")

    def insert(self, key: bytes, owner: object, rows: int = 1) -> None:
        node, at, path = self.root, 0, [self.root]
        while at < len(key):
            child = node.below.get(key[at])
            if child is None:
                leaf = _Node(key[at:])
                node.below[key[at]] = leaf
                self._grew(path, leaf.size)
                node, at = leaf, len(key)
                break
            if child.file is not None:
                pickle.dump((key, owner, rows), child.file, -1)
                return
            same = _common(child.edge, key, at)
            if same < len(child.edge):
                upper = _Node(child.edge[:same])
                upper.size = NODE + child.size
                self._grew(path, NODE)
                child.edge = child.edge[same:]
                child.size -= same
                upper.below[child.edge[0]] = child
                node.below[key[at]] = upper
                child = upper
            node, at = child, at + same
            path.append(node)
        if not node.rows or self.better(owner, node.owner):
            node.owner = owner
        node.rows += rows
        if self.held > self.budget:
            self._spill()

    def _grew(self, path: list[_Node], by: int) -> None:
        self.held += by
        for node in path:
            node.size += by

    def _spill(self) -> None:
        path, top = [self.root], b""
        while len(path[-1].below) == 1 and not path[-1].rows:
            (only,) = path[-1].below.values()
            if only.file is not None:
                return
            top += only.edge
            path.append(only)
        inner = [c for c in path[-1].below.values() if c.file is None]
        if len(path[-1].below) + bool(path[-1].rows) < 2 or not inner:
            return
        child = max(inner, key=lambda c: c.size)
        file = tempfile.TemporaryFile()  # scratch of this task alone; a lost task starts over
        for item in self._walk(child, top):
            pickle.dump(item, file, -1)
        stack = list(child.below.values())
        while stack:  # what lies spilled further down moves along
            node = stack.pop()
            stack += node.below.values()
            if node.file is not None:
                for item in _load(node.file):
                    pickle.dump(item, file, -1)
        child.file = file
        for node in path:
            node.size -= child.size
        self.held -= child.size
        child.below, child.size, child.rows, child.owner = {}, 0, 0, None
        self.spills += 1

    def _walk(self, node: _Node, above: bytes) -> Iterator[tuple[bytes, object, int]]:
        stack = [(node, above)]
        while stack:
            node, above = stack.pop()
            key = above + node.edge
            if node.file is None and node.rows:
                yield key, node.owner, node.rows
            stack += [(c, key) for c in node.below.values() if c.file is None]

    def items(self) -> Iterator[tuple[bytes, object, int]]:
        """(string, owner, rows) once per distinct string; spilled subtrees come last."""
        yield from self._walk(self.root, b"")
        stack = [self.root]
        while stack:
            node = stack.pop()
            stack += node.below.values()
            if node.file is not None:
                inner = OwnerTrie(self.better, self.budget)
                for item in _load(node.file):
                    inner.insert(*item)
                yield from inner.items()
                self.spills += inner.spills
