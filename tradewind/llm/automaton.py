"""Generalised suffix automaton over sequences of hashable symbols."""

from __future__ import annotations


class SuffixAutomaton:
    """States are classes of substrings of the added sequences; state 0 is the empty string.

    ``next[s]`` maps symbols to states, ``link[s]`` is the longest suffix in
    another class and ``length[s]`` the longest string of the class. It has
    fewer than two states per symbol.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def add(self, sequence) -> None:
        """Add one sequence; matches never run across two sequences."""
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, source: int, symbol, target: int) -> int:
        """The state of the strings source + symbol alone, cut from a target that also holds longer ones."""
        copy = self._state(self.length[source] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while source >= 0 and self.next[source].get(symbol) == target:
            self.next[source][symbol] = copy
            source = self.link[source]
        return copy

    def _extend(self, last: int, symbol) -> int:
        known = self.next[last].get(symbol)
        if known is not None:  # the prefix occurs already
            return known if self.length[known] == self.length[last] + 1 else self._split(last, symbol, known)
        state = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = state
            at = self.link[at]
        if at >= 0:
            target = self.next[at][symbol]
            exact = self.length[target] == self.length[at] + 1
            self.link[state] = target if exact else self._split(at, symbol, target)
        return state

    def step(self, state: int, matched: int, symbol) -> tuple[int, int]:
        """State and length of the longest suffix of what was read, symbol included, that occurs in a sequence."""
        moves = self.next
        while state and symbol not in moves[state]:
            state = self.link[state]
            matched = self.length[state]
        target = moves[state].get(symbol)
        return (0, 0) if target is None else (target, matched + 1)
