"""Deep-shallow sorting of strings of fixed width.

The shallow part is multikey quicksort on an alphabet of 8-byte words: strings are ordered by their first
word, ties by the next one, and so on down to `shallow` words; only ties go on. Groups that are still
tied share a long prefix: if they are equal to the end they are done, else a blind trie orders them. Its
inner nodes hold only the position of a branching byte, so that a string is placed by a blind walk, one
comparison with the leaf found, and a second walk to the branch.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 3  # words of 8 bytes: what is tied after them shares a long prefix and goes to the tries


class BlindTrie:
    def __init__(self) -> None:
        self.root: list | None = None  # leaf: [bytes, items]; inner: [position, {byte: node}, any leaf]

    @staticmethod
    def _common(a: bytes, b: bytes) -> int:
        differing = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
        return len(a) - (differing.bit_length() + 7) // 8

    def add(self, s: bytes, items: list[int]) -> None:
        """A string that is not in the trie yet, with its items."""
        if self.root is None:
            self.root = [s, items]
            return
        node = self.root
        while len(node) == 3:
            node = node[1].get(s[node[0]], node[2])
        at = self._common(s, node[0])
        leaf = [s, items]
        node, up, byte = self.root, None, 0
        while len(node) == 3 and node[0] < at:
            up, byte = node, s[node[0]]
            node = node[1][byte]
        if len(node) == 3 and node[0] == at:
            node[1][s[at]] = leaf
            return
        old = node[2] if len(node) == 3 else node
        inner = [at, {s[at]: leaf, old[0][at]: node}, old]
        if up is None:
            self.root = inner
        else:
            up[1][byte] = inner

    def groups(self) -> list[list[int]]:
        """Items of equal strings, in the order of the strings."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if len(node) == 2:
                out.append(node[1])
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def sort(words: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """words: (n, width) unsigned 64-bit, big-endian values of the strings' bytes. Gives the order, and
    the number of the distinct string of each place in it."""
    n, width = words.shape
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(words[:, 0], kind="stable")
    new = np.ones(n, bool)
    new[1:] = words[order[1:], 0] != words[order[:-1], 0]
    for d in range(1, min(shallow, width)):
        group = np.cumsum(new) - 1
        tied = np.flatnonzero((np.bincount(group) > 1)[group])
        if not len(tied):
            return order, group
        part = order[tied]
        again = np.lexsort((words[part, d], group[tied]))
        order[tied] = part = part[again]
        new[tied[1:]] |= words[part[1:], d] != words[part[:-1], d]
    group = np.cumsum(new) - 1
    if width > shallow:
        start = np.flatnonzero(new)
        first = order[start[group]]
        differs = np.zeros(n, bool)
        tied = np.flatnonzero((np.bincount(group) > 1)[group])
        differs[tied] = (words[order[tied], shallow:] != words[first[tied], shallow:]).any(1)
        end = np.append(start[1:], n)
        for g in np.unique(group[differs]).tolist():
            b, e = start[g], end[g]
            raw = words[order[b:e], shallow:].astype(">u8").tobytes()
            size = 8 * (width - shallow)
            equal: dict[bytes, list[int]] = {}
            for k, item in enumerate(order[b:e].tolist()):
                equal.setdefault(raw[k * size : (k + 1) * size], []).append(item)
            if len(equal) < 3:  # a trie of one branch
                ordered = [equal[s] for s in sorted(equal)]
            else:
                trie = BlindTrie()
                for s, items in equal.items():
                    trie.add(s, items)
                ordered = trie.groups()
            at = b
            for items in ordered:
                order[at : at + len(items)] = items
                new[at] = True
                new[at + 1 : at + len(items)] = False
                at += len(items)
        group = np.cumsum(new) - 1
    return order, group
