"""An adaptive radix tree over keys of fixed-width big-endian numbers.

A node holds the bytes of its compressed path and its children in one of four layouts: two
short sorted arrays of up to 4 or 16 keys, an index of 256 places to up to 48 children, or
256 children. A layout grows when it is full. Keys are whole numbers of ``width`` bytes;
only byte depths that are multiples of ``width`` are depths of the trie of numbers, so a
branch inside a number makes no node of that trie, and a long compressed path makes several."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Children:
    """Children by next byte, in byte order; the layout grows with their number."""

    __slots__ = ("keys", "index", "slots", "count")

    def __init__(self):
        self.keys: bytearray | None = bytearray()  # sorted keys of the layouts of 4 and 16
        self.index: bytearray | None = None  # place + 1 for each byte, of the layout of 48
        self.slots: list = []
        self.count = 0

    @property
    def layout(self) -> int:
        if self.keys is not None:
            return 4 if self.count <= 4 else 16
        return 48 if self.index is not None else 256

    def get(self, byte: int):
        if self.keys is not None:
            at = self.keys.find(byte)
            return self.slots[at] if at >= 0 else None
        if self.index is not None:
            at = self.index[byte]
            return self.slots[at - 1] if at else None
        return self.slots[byte]

    def put(self, byte: int, child) -> None:
        """Add or replace one child."""
        if self.get(byte) is None:
            self.count += 1
            if self.keys is not None and self.count > 16:
                self._grow_to_48()
            elif self.index is not None and self.count > 48:
                self._grow_to_256()
            if self.keys is not None:
                at = bisect_left(self.keys, byte)
                self.keys.insert(at, byte)
                self.slots.insert(at, child)
                return
            if self.index is not None:
                self.slots.append(child)
                self.index[byte] = len(self.slots)
                return
            self.slots[byte] = child
        elif self.keys is not None:
            self.slots[self.keys.find(byte)] = child
        elif self.index is not None:
            self.slots[self.index[byte] - 1] = child
        else:
            self.slots[byte] = child

    def _grow_to_48(self) -> None:
        index = bytearray(256)
        for place, byte in enumerate(self.keys):
            index[byte] = place + 1
        self.keys, self.index = None, index

    def _grow_to_256(self) -> None:
        wide = [None] * 256
        for byte, place in enumerate(self.index):
            if place:
                wide[byte] = self.slots[place - 1]
        self.index, self.slots = None, wide

    def items(self) -> Iterator[tuple[int, object]]:
        if self.keys is not None:
            yield from zip(self.keys, self.slots)
        elif self.index is not None:
            yield from ((byte, self.slots[place - 1]) for byte, place in enumerate(self.index) if place)
        else:
            yield from ((byte, child) for byte, child in enumerate(self.slots) if child is not None)

    def keep(self, wanted: set[int]) -> None:
        """Only the children under the wanted bytes, in the smallest layout that holds them."""
        left = [(b, c) for b, c in self.items() if b in wanted]
        self.__init__()
        for byte, child in left:
            self.put(byte, child)


class Node:
    """A node that starts at byte ``start`` of its keys, ends after ``path`` and counts the
    members below it. ``ends`` is whatever the tree's owner keeps for keys that end here;
    ``heads``, ``leaves`` and ``saved`` sum what was removed below it, and ``via`` is then a
    key that passes through it."""

    __slots__ = ("start", "path", "weights", "children", "count", "low", "ends", "heads", "leaves", "saved", "via")

    def __init__(self, start: int, path: bytes, weights: list[int]):
        self.start, self.path, self.weights = start, path, weights
        self.children: Children | None = None
        self.count, self.low = 0, None
        self.ends = self.via = None
        self.heads = self.leaves = self.saved = 0

    @property
    def stop(self) -> int:
        return self.start + len(self.path)


class RadixTree:
    """Keys are added with a weight per number and a member id; every node on the way
    counts the member and keeps the smallest id."""

    def __init__(self, width: int):
        self.width = width
        self.root = Node(0, b"", [])

    def add(self, key: bytes, weights: list[int], member: int) -> Node:
        """The node at which the key ends."""
        width, node = self.width, self.root
        while True:
            node.count += 1
            if node.low is None or member < node.low:
                node.low = member
            at = node.stop
            if at == len(key):
                return node
            if node.children is None:
                node.children = Children()
            child = node.children.get(key[at])
            if child is None:
                child = Node(at, key[at:], weights[at // width :])
                node.children.put(key[at], child)
            elif not key.startswith(child.path, at):
                child = self._split(node, child, key)
            node = child

    def _split(self, above: Node, child: Node, key: bytes) -> Node:
        """Cut the child's path where the key leaves it."""
        at, path = child.start, child.path
        low, high = 0, min(len(path), len(key) - at)
        while low < high:  # length of the common part
            mid = (low + high + 1) // 2
            if key.startswith(path[:mid], at):
                low = mid
            else:
                high = mid - 1
        passed = (at + low) // self.width - at // self.width  # numbers that end within the common part
        middle = Node(at, path[:low], child.weights[:passed])
        middle.count, middle.low, middle.via = child.count, child.low, child.via
        child.start, child.path, child.weights = at + low, path[low:], child.weights[passed:]
        middle.children = Children()
        middle.children.put(path[low], child)
        above.children.put(key[at], middle)
        return middle

    def path_to(self, key: bytes) -> list[Node]:
        """The nodes on the way to a key that was added."""
        nodes = [self.root]
        while nodes[-1].stop < len(key):
            nodes.append(nodes[-1].children.get(key[nodes[-1].stop]))
        return nodes
