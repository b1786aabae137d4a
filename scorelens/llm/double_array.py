"""Double-array trie of symbol sequences, built and walked level by level in numpy (for one shard)."""

from __future__ import annotations

import numpy as np


class DoubleArray:
    """BASE by node, CHECK and NODE by slot: the child of node s by symbol c stands in slot BASE[s] + c,
    if CHECK of that slot is s.  Node 0 is the root."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Sequence i is ``symbols[starts[i] : starts[i] + lengths[i]]``; symbols are dense from 0."""
        self.width = int(symbols.max(initial=-1)) + 1
        parents, by = self._transitions(symbols, starts, lengths)
        self.nodes = len(parents) + 1
        self._pack(parents, by)

    def _transitions(self, symbols, starts, lengths):
        """Parent and symbol of nodes 1, 2, ...: per level, the different pairs of node and next symbol."""
        at = np.zeros(len(starts), np.int64)
        parents, by, made = [], [], 1
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        for depth in range(int(lengths.max(initial=0))):
            open_ = order[: np.searchsorted(-sizes, -depth, side="left")]
            pairs, which = np.unique(at[open_] * self.width + symbols[starts[open_] + depth], return_inverse=True)
            at[open_] = made + which
            parents.append(pairs // self.width)
            by.append(pairs % self.width)
            made += len(pairs)
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *parents]), np.concatenate([empty, *by])

    def _pack(self, parents, by):
        self.base = np.zeros(self.nodes, np.int64)
        self.check = np.full(self.width + 2 * self.nodes + 64, -1, np.int64)
        self.node = np.full(len(self.check), -1, np.int64)
        children = np.arange(1, self.nodes)
        order = np.argsort(parents, kind="stable")
        parents, by, children = parents[order], by[order], children[order]
        first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]]) if len(parents) else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, len(parents)])
        free = 0  # no slot below is free
        for k in np.argsort(-count, kind="stable")[: int((count > 1).sum())]:
            rows = slice(first[k], first[k] + count[k])
            base, free = self._place(by[rows], free)
            self._set(parents[rows], base + by[rows], children[rows])
            self.base[parents[first[k]]] = base
        single = first[count == 1]
        if len(single):  # the child of an only-child node can stand in any free slot
            self._grow(len(self.check) + len(single))
            slots = np.flatnonzero(self.check < 0)[: len(single)]
            self.base[parents[single]] = slots - by[single]
            self._set(parents[single], slots, children[single])

    def _place(self, symbols, free):
        """First base whose slots are all free; beyond some tries, one past all used slots."""
        while self.check[free] >= 0:
            free += 1
        slot = free
        for _ in range(64):
            base = slot - symbols[0]
            if base + symbols[-1] >= len(self.check):
                self._grow(2 * len(self.check))
            if (self.check[base + symbols] < 0).all():
                return base, free
            slot += 1
            while slot < len(self.check) and self.check[slot] >= 0:
                slot += 1
        used = int(np.flatnonzero(self.check >= 0).max()) + 1
        self._grow(used + self.width + 64)
        return used - symbols[0], free

    def _grow(self, size):
        more = size - len(self.check)
        if more > 0:
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])
            self.node = np.concatenate([self.node, np.full(more, -1, np.int64)])

    def _set(self, parents, slots, children):
        self.check[slots] = parents
        self.node[slots] = children

    def step(self, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Child of each node by each symbol, -1 where there is none."""
        slot = self.base[at] + symbols
        inside = (slot >= 0) & (slot < len(self.check)) & (at >= 0)
        slot = np.where(inside, slot, 0)
        return np.where(inside & (self.check[slot] == at), self.node[slot], -1)

    def walk(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Node after each symbol of each sequence, where the symbol stands (-1 beyond the trie)."""
        out = np.full(len(symbols), -1, np.int64)
        at = np.zeros(len(starts), np.int64)
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        for depth in range(int(lengths.max(initial=0))):
            open_ = order[: np.searchsorted(-sizes, -depth, side="left")]
            where = starts[open_] + depth
            at[open_] = self.step(at[open_], symbols[where])
            out[where] = at[open_]
        return out
