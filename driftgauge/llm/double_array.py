"""Double-array tries: built and walked with numpy, all positions of a text at once.

A state is a slot of two arrays; from state ``s`` symbol ``c`` leads to slot ``base[s] + c`` if ``check`` of that slot is
``s``. The root is slot 0. Symbols are small numbers (word codes come as digits), so a node has few children: nodes with
many are given stretches of their own, the next are thrown at random places, all of a size at once, until none collide,
and single children fill the holes. The draw is seeded by the trie's size: the same keys give the same arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MANY = 32  # children of a node that gets a stretch of its own


@dataclass(frozen=True)
class DoubleArray:
    base: np.ndarray
    check: np.ndarray

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots that the symbols lead to, and whether they are states."""
        slots = self.base[states] + symbols
        return slots, self.check[slots] == states


def prefixes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the trie of distinct ``keys`` (rows of symbols): parent and symbol of each node, and each key's node.

    Nodes are numbered from 1, level by level, siblings in order of their symbols; 0 is the root.
    """
    n, depth = keys.shape
    order = np.lexsort(keys.T[::-1])
    rows = keys[order]
    new = np.zeros(n, bool)
    own, parents, symbols, numbered = np.zeros(n, np.int64), [], [], 0
    if n:
        new[0] = True
    for level in range(depth):
        new[1:] |= rows[1:, level] != rows[:-1, level]
        first = np.flatnonzero(new)
        parents.append(own[first])
        symbols.append(rows[first, level])
        own = numbered + np.cumsum(new)
        numbered += len(first)
    leaf = np.empty(n, np.int64)
    leaf[order] = own
    return np.concatenate(parents or [own]), np.concatenate(symbols or [own]), leaf


def build(parent: np.ndarray, symbol: np.ndarray, width: int) -> tuple[DoubleArray, np.ndarray]:
    """The arrays and the slot of every node, from nodes as ``prefixes`` gives them.

    Symbols lie in [0, width). The arrays end with room for any symbol, so a step never leaves them.
    """
    n = len(parent)
    size = np.bincount(parent, minlength=n + 1)
    first = np.cumsum(size) - size
    base = np.zeros(n + 1, np.int64)
    large, small = np.flatnonzero(size > MANY), np.flatnonzero((size > 0) & (size <= MANY))
    low, high = symbol[first[large]], symbol[first[large] + size[large] - 1]
    stretch_ends = width + np.cumsum(high - low + 1)
    base[large] = stretch_ends - high - 1
    end = int(stretch_ends[-1]) if len(large) else width
    some, single = small[size[small] > 1], small[size[small] == 1]
    room = end + int(size[some].sum()) + width
    taken = np.zeros(room + width, bool)
    taken[0] = True

    def slots_of(nodes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(nodes)), size[nodes])
        within = np.arange(len(owner)) - np.repeat(np.cumsum(size[nodes]) - size[nodes], size[nodes])
        return owner, at[owner] + symbol[first[nodes][owner] + within]

    taken[slots_of(large, base[large])[1]] = True
    draw = np.random.default_rng(n)
    for least, most in ((9, MANY), (5, 8), (3, 4), (2, 2)):  # the larger a node, the emptier the arrays at its turn
        todo, rounds = some[(size[some] >= least) & (size[some] <= most)], 0
        while len(todo):
            at = draw.integers(1, room, len(todo))
            owner, slots = slots_of(todo, at)
            bad = taken[slots]
            order = np.argsort(slots, kind="stable")
            bad[order[1:][slots[order[1:]] == slots[order[:-1]]]] = True
            lost = np.bincount(owner[bad], minlength=len(todo)) > 0
            base[todo[~lost]] = at[~lost]
            taken[slots[~lost[owner]]] = True
            todo, rounds = todo[lost], rounds + 1
            if rounds % 12 == 0:  # little room is left
                more = int(size[todo].sum()) + width
                taken = np.concatenate([taken, np.zeros(more, bool)])
                room += more
    # a single child goes to any free slot
    free = width + np.flatnonzero(~taken[width:room])[: len(single)]
    free = np.concatenate([free, len(taken) + np.arange(len(single) - len(free))])
    base[single] = free - symbol[first[single]]
    node_slot = np.zeros(n + 1, np.int64)
    if n:
        node_slot[1:] = base[parent] + symbol
    last = max(int(base.max()), int(node_slot.max())) + width + 1
    arrays = DoubleArray(np.zeros(last, np.int32), np.full(last, -1, np.int32))
    arrays.base[node_slot] = base
    arrays.check[node_slot[1:]] = node_slot[parent]
    return arrays, node_slot
