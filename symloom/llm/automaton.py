"""A generalised suffix automaton over word sequences.

Each state stands for the set of substrings that end at the same places of the
items. Walking a token stream through it gives, at every token, the length of
the longest suffix of the stream that occurs in some item.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """Built from (item, words) pairs; windows are ``width`` consecutive words, or a whole shorter item.

    ``vocabulary`` maps a word to a positive number. ``length`` and ``link`` are
    the usual arrays. ``level[s]`` is the ancestor of ``s`` that holds the suffix
    of exactly ``width`` words, ``inside[u]`` the items in which the strings of
    such a state occur, ``whole[s]`` the (length, item) of all short items that
    are suffixes of the strings of ``s``.
    """

    def __init__(self, items: Iterable[tuple[str, Sequence[bytes]]], width: int):
        self.width = width
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]) for item, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.shortest = min((min(len(codes), width) for _, codes in coded), default=0)
        self._mark(coded)

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of ``q`` for the strings that reach it by ``c`` from ``p`` or shorter ones."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = copy
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if (q := self.step[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def _mark(self, coded: list[tuple[str, list[int]]]) -> None:
        n, width = len(self.length), self.width
        inside: list[set] = [set() for _ in range(n)]
        own: list[list] = [[] for _ in range(n)]
        for item, codes in coded:
            s = 0
            for c in codes:
                s = self.step[s][c]
                if self.length[s] >= width:
                    inside[s].add(item)
            if len(codes) < width:
                own[s].append((len(codes), item))
        by_length = sorted(range(1, n), key=self.length.__getitem__)
        for s in reversed(by_length):
            if self.length[self.link[s]] >= width:
                inside[self.link[s]] |= inside[s]
        self.whole: list[tuple] = [()] * n
        self.level = [0] * n
        for s in by_length:
            up = self.link[s]
            self.whole[s] = (*own[s], *self.whole[up])
            if self.length[s] >= width:
                self.level[s] = self.level[up] if self.length[up] >= width else s
        self.inside = [frozenset(x) for x in inside]

    def scan(self, codes: Sequence[int], hits: list[tuple[int, int]], found: set, start: int = 0) -> None:
        """Walk ``codes``; append the (first, last) words of each window's occurrence to ``hits``, its items to ``found``."""
        step, link, length, width, whole, level, inside = self.step, self.link, self.length, self.width, self.whole, self.level, self.inside
        s = matched = 0
        for at, c in enumerate(codes, start):
            while (to := step[s].get(c)) is None and s:
                s = link[s]
                matched = length[s]
            if to is None:
                continue
            s = to
            matched += 1
            if matched >= width:
                hits.append((at - width + 1, at))
                found |= inside[level[s]]
            for size, item in whole[s]:
                if size <= matched:
                    hits.append((at - size + 1, at))
                    found.add(item)
