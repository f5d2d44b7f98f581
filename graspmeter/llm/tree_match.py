"""Simple tree matching: the largest order-keeping match of two trees with equal labels."""

from __future__ import annotations

import numpy as np

#: Cells of a matching table that are held at once; larger ones are halved first.
CELLS = 1 << 20


class Tree:
    """Nodes in page order from the lines ``depth label`` of a skeleton."""

    def __init__(self, skeleton: str):
        self.children: list[list[int]] = [[]]
        self.labels = [""]
        self.text_number: dict[int, int] = {}
        path = [0]
        for line in skeleton.split("\n") if skeleton else ():
            depth, label = line.split(" ", 1)
            del path[int(depth) :]
            self.children[path[-1]].append(len(self.labels))
            if label == "#":
                self.text_number[len(self.labels)] = len(self.text_number)
            path.append(len(self.labels))
            self.labels.append(label)
            self.children.append([])


class Matcher:
    """Weights of pairs of subtree shapes are remembered, as lists have many children of one shape."""

    def __init__(self):
        self.shapes: dict[tuple, int] = {}
        self.parts: list[tuple[str, tuple[int, ...]]] = []
        self.sizes: list[int] = []
        self.weights: dict[tuple[int, int], int] = {}

    def shape_of(self, tree: Tree) -> list[int]:
        shapes = [0] * len(tree.labels)
        for node in range(len(tree.labels) - 1, -1, -1):
            key = (tree.labels[node], tuple(shapes[c] for c in tree.children[node]))
            if key not in self.shapes:
                self.shapes[key] = len(self.parts)
                self.parts.append(key)
                self.sizes.append(1 + sum(self.sizes[c] for c in key[1]))
            shapes[node] = self.shapes[key]
        return shapes

    def weight(self, a: int, b: int) -> int:
        if a == b:
            return self.sizes[a]
        (label, left), (other, right) = self.parts[a], self.parts[b]
        if label != other:
            return 0
        if (a, b) not in self.weights:
            self.weights[a, b] = 1 + sum(self.weight(left[i], right[j]) for i, j in self.pairs(left, right))
        return self.weights[a, b]

    def pairs(self, left: tuple[int, ...], right: tuple[int, ...]) -> list[tuple[int, int]]:
        """Positions that match best. Equal shapes at either end always may match."""
        start, end = 0, 0
        most = min(len(left), len(right))
        while start < most and left[start] == right[start]:
            start += 1
        while end < most - start and left[-1 - end] == right[-1 - end]:
            end += 1
        inner = self._inner(left[start : len(left) - end], right[start : len(right) - end])
        tail = [(len(left) - k, len(right) - k) for k in range(end, 0, -1)]
        return [*((i, i) for i in range(start)), *((i + start, j + start) for i, j in inner), *tail]

    def _row(self, shape: int, right: tuple[int, ...], above: np.ndarray) -> np.ndarray:
        gains = np.array([self.weight(shape, other) for other in right])
        return np.maximum.accumulate(np.r_[0, np.maximum(above[1:], above[:-1] + gains)])

    def _inner(self, left: tuple[int, ...], right: tuple[int, ...]) -> list[tuple[int, int]]:
        if not left or not right:
            return []
        if (len(left) + 1) * (len(right) + 1) > CELLS and len(left) > 1:
            half = len(left) // 2
            ahead = behind = np.zeros(len(right) + 1, np.int64)
            for shape in left[:half]:
                ahead = self._row(shape, right, ahead)
            for shape in left[:half - 1 : -1]:
                behind = self._row(shape, right[::-1], behind)
            cut = int(np.argmax(ahead + behind[::-1]))
            later = self._inner(left[half:], right[cut:])
            return self._inner(left[:half], right[:cut]) + [(i + half, j + cut) for i, j in later]
        table = [np.zeros(len(right) + 1, np.int64)]
        for shape in left:
            table.append(self._row(shape, right, table[-1]))
        found, i, j = [], len(left), len(right)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((i, j))
        return found[::-1]


def matched_texts(page: Tree, other: Tree, matcher: Matcher) -> list[tuple[int, int]]:
    """Numbers of the texts of two trees that stand at matched places."""
    mine, theirs = matcher.shape_of(page), matcher.shape_of(other)
    found, open_pairs = [], [(0, 0)]
    while open_pairs:
        a, b = open_pairs.pop()
        if a in page.text_number and b in other.text_number:
            found.append((page.text_number[a], other.text_number[b]))
        left, right = page.children[a], other.children[b]
        if left and right:
            at = matcher.pairs(tuple(mine[c] for c in left), tuple(theirs[c] for c in right))
            open_pairs += [(left[i], right[j]) for i, j in at if page.labels[left[i]] == other.labels[right[j]]]
    return sorted(found)
