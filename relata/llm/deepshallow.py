"""Deep-shallow sorting of byte rows: multikey quicksort to a shallow depth, blind tries below it.

Up to ``SHALLOW`` bytes, rows are ordered eight bytes a key; only rows that still tie go on to the next key.
Groups that tie beyond that share a long prefix; a blind trie (of branching depths, without the bytes
between) orders each of them, comparing a row with one other row only.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 48


class BlindTrie:
    """Rows of equal length, in order. An inner node is [depth, {byte: node}], a leaf [row, [ids]]."""

    def __init__(self, width: int) -> None:
        self.width, self.root = width, None

    def _common(self, a: bytes, b: bytes) -> int:
        """Length of the common prefix."""
        return self.width - -(-(int.from_bytes(a) ^ int.from_bytes(b)).bit_length() // 8)

    def insert(self, row: bytes, key: int) -> None:
        if self.root is None:
            self.root = [row, [key]]
            return
        node = self.root
        while type(node[0]) is int:  # blindly down: only the branching bytes are looked at
            node = node[1].get(row[node[0]]) or next(iter(node[1].values()))
        if node[0] == row:
            node[1].append(key)
            return
        depth = self._common(node[0], row)
        parent, node = None, self.root
        while type(node[0]) is int and node[0] < depth:
            parent, node = node, node[1][row[node[0]]]
        if type(node[0]) is int and node[0] == depth:
            node[1][row[depth]] = [row, [key]]
            return
        any_row = node
        while type(any_row[0]) is int:
            any_row = next(iter(any_row[1].values()))
        branch = [depth, {any_row[0][depth]: node, row[depth]: [row, [key]]}]
        if parent is None:
            self.root = branch
        else:
            parent[1][row[parent[0]]] = branch

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if type(node[0]) is int:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out += node[1]
        return out


def order_rows(group: np.ndarray, rows: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Order of byte rows (matrix) by group, then bytes; equal rows stay as they come."""
    n, width = rows.shape
    order = np.argsort(group, kind="stable")
    tie = np.cumsum(np.concatenate([[0], np.diff(group[order].astype(np.int64)) != 0])) if n else np.zeros(0, np.int64)
    for at in range(0, min(shallow, width), 8):
        size = np.bincount(tie, minlength=1) if n else np.zeros(1, int)
        open_ = np.flatnonzero(size[tie] > 1)
        if not len(open_):
            return order
        part = rows[order[open_], at : at + 8]
        word = np.zeros((len(open_), 8), np.uint8)
        word[:, : part.shape[1]] = part
        word = word.view(">u8").ravel().astype(np.uint64)
        by = np.lexsort((word, tie[open_]))
        order[open_] = order[open_][by]
        word, own = word[by], tie[open_]
        new = np.zeros(n, bool)
        new[1:] = np.diff(tie) != 0
        inner = np.concatenate([[False], (np.diff(word) != 0) & (np.diff(own) == 0)])
        new[open_[inner]] = True
        tie = np.cumsum(new)
    begin = np.flatnonzero(np.concatenate([[True], np.diff(tie) != 0])) if n else np.zeros(0, int)
    for a, b in zip(begin, np.append(begin[1:], n)):
        if b - a > 1:
            trie = BlindTrie(width)
            for k in order[a:b]:
                trie.insert(rows[k].tobytes(), int(k))
            order[a:b] = trie.ordered()
    return order


def neighbours_common(group: np.ndarray, rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it in order; -1 at the first of a group."""
    if not len(order):
        return np.zeros(0, np.int64)
    sorted_rows, g = rows[order], group[order]
    differ = sorted_rows[1:] != sorted_rows[:-1]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.concatenate([[-1], np.where(g[1:] == g[:-1], common, -1)])
