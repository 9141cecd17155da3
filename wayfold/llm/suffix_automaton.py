"""A generalised suffix automaton over sequences of hashable symbols."""

from __future__ import annotations

from collections.abc import Hashable, Iterable


class SuffixAutomaton:
    """States are numbered from the root 0; next[v] maps a symbol to a state, link is -1 at the root."""

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def _state(self, length: int, link: int, edges: dict[Hashable, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, parent: int, child: int, symbol: Hashable) -> int:
        """A state for the strings of `child` that are at most one longer than `parent`."""
        copy = self._state(self.length[parent] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(symbol) == child:
            self.next[parent][symbol] = copy
            parent = self.link[parent]
        return copy

    def extend(self, last: int, symbol: Hashable) -> int:
        """The state of the string of `last` and then `symbol`, which is made part of the automaton."""
        known = self.next[last].get(symbol)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, symbol)
        state = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = state
            at = self.link[at]
        if at >= 0:
            child = self.next[at][symbol]
            exact = self.length[child] == self.length[at] + 1
            self.link[state] = child if exact else self._split(at, child, symbol)
        return state

    def add(self, symbols: Iterable[Hashable]) -> int:
        """Adds one sequence; returns the state of the whole of it."""
        last = 0
        for symbol in symbols:
            last = self.extend(last, symbol)
        return last

    def step(self, state: int, matched: int, symbol: Hashable) -> tuple[int, int]:
        """The state and the length of the longest match that ends with `symbol`, after those before it."""
        while state > 0 and symbol not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        state_next = self.next[state].get(symbol)
        return (0, 0) if state_next is None else (state_next, matched + 1)
