"""Edit distance with transpositions, singly, in columns, and against all words of a trie at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words; ``most + 1`` if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = _step(b, x, a[i - 1] if i else "", last, before, i + 1)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def _step(word: str, letter: str, previous: str, last: list[int], before: list[int], first: int) -> list[int]:
    """The automaton's next state: edits between the letters read so far and each prefix of ``word``."""
    row = [first]
    for j, y in enumerate(word):
        cost = min(last[j + 1] + 1, row[j] + 1, last[j] + (letter != y))
        if before and j and letter == word[j - 1] and previous == y:
            cost = min(cost, before[j - 1] + 1)
        row.append(cost)
    return row


class Automaton:
    """The Levenshtein automaton of a word, swaps of neighbours included, made deterministic as far as it is walked.

    A state is a tuple of bit sets: for 0 .. ``most`` edits the letters of the word read so far, then for 1 .. ``most``
    edits the swaps begun. Bit i stands for the first i letters.
    """

    def __init__(self, word: str, most: int):
        self.most, self.last, self.all = most, 1 << len(word), (1 << (len(word) + 1)) - 1
        self.places: dict[str, int] = {}
        for i, letter in enumerate(word):
            self.places[letter] = self.places.get(letter, 0) | 1 << i
        start = tuple((2 << d) - 1 & self.all for d in range(most + 1)) + (0,) * most
        self.number = {start: 0}
        self.states = [start]
        self.moves: list[dict[str, int]] = [{}]
        self.final = [start[most] & self.last > 0]

    def step(self, state: int, letter: str) -> int:
        """The state after one more letter; -1 if no word within reach begins like that."""
        after = self.moves[state].get(letter)
        if after is None:
            after = self.moves[state][letter] = self._make(self.states[state], self.places.get(letter, 0))
        return after

    def _make(self, old: tuple[int, ...], at: int) -> int:
        read, begun = [(old[0] & at) << 1], []
        for d in range(1, self.most + 1):
            before, swap = old[d - 1], old[self.most + d]
            reached = (old[d] & at) << 1 | before | before << 1 | read[-1] << 1 | (swap & at) << 2
            read.append(reached & self.all)
            begun.append(before & at >> 1)
        if not read[-1] and not (begun and begun[-1]):
            return -1
        state = (*read, *begun)
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            self.final.append(read[-1] & self.last > 0)
        return self.number[state]


automaton = lru_cache(maxsize=20_000)(Automaton)


class Trie:
    """Words in a tree of letters; :meth:`near` walks it with the automaton of a word and leaves dead branches."""

    def __init__(self, words):
        self.root: dict = {}
        for word in words:
            node = self.root
            for letter in word:
                node = node.setdefault(letter, {})
            node[""] = word

    def near(self, word: str, most: int) -> list[str]:
        """All words of the tree within ``most`` edits of ``word``."""
        found = []
        walk = automaton(word, most)
        stack = [(self.root, 0)]
        while stack:
            node, state = stack.pop()
            moves = walk.moves[state]
            for letter, child in node.items():
                if letter == "":
                    if walk.final[state]:
                        found.append(child)
                    continue
                after = moves.get(letter)
                if after is None:
                    after = walk.step(state, letter)
                if after >= 0:
                    stack.append((child, after))
        return found


def edit_column(a: Column, b: Column, most: int) -> Column:
    """``edits`` of two string columns, in Arrow batches; NULL counts as the empty word."""

    @F.pandas_udf("int")
    def each(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([edits(x or "", y or "", most) for x, y in zip(left, right, strict=True)], dtype="int32")

    return each(a, b)
