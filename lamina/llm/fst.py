"""Small weighted finite-state transducers with composition.

A transducer is deterministic on its input: ``arcs[state][symbol] = (output, next state, weight)``.
``"*"`` stands for any symbol without an arc of its own and outputs the symbol itself. Weights add
along a path. Lexicons are transducers over letters: a trie whose word end ``$`` puts out the lexicon's symbol for words
that it holds and stays ``$`` for all others, so that lexicons, too, are chained by composition.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

Arc = tuple[str, int, float]


@dataclass(frozen=True)
class Transducer:
    arcs: tuple[dict[str, Arc], ...]

    def step(self, state: int, symbol: str) -> Arc:
        found = self.arcs[state].get(symbol)
        if found is None:
            out, to, weight = self.arcs[state]["*"]
            return (symbol if out == "*" else out), to, weight
        return found

    def compose(self, other: Transducer, alphabet: Iterable[str]) -> Transducer:
        """The transducer that runs this one and feeds its output to ``other``; reachable pairs of states only."""
        alphabet = list(alphabet)
        number, arcs, todo = {(0, 0): 0}, [], [(0, 0)]
        while todo:
            a, b = todo.pop(0)
            row = {}
            for s in alphabet:
                mid, a2, w1 = self.step(a, s)
                out, b2, w2 = other.step(b, mid)
                if (a2, b2) not in number:
                    number[a2, b2] = len(number)
                    todo.append((a2, b2))
                row[s] = (out, number[a2, b2], w1 + w2)
            arcs.append(row)
        return Transducer(tuple(arcs))

    def chained(self, other: Transducer) -> Chain:
        """As ``compose``, over any alphabet: states come into being when they are reached."""
        return Chain(self, other)

    def run(self, symbols: Iterable[str]) -> list[tuple[str, float]]:
        """Output symbol and weight of each step from the start state."""
        state, out = 0, []
        for s in symbols:
            o, state, w = self.step(state, s)
            out.append((o, w))
        return out


class Chain(Transducer):
    """Two transducers, the second one reading what the first puts out; pairs of states are numbered as they are met."""

    def __init__(self, first: Transducer, second: Transducer):
        object.__setattr__(self, "parts", (first, second))
        object.__setattr__(self, "pairs", [(0, 0)])
        object.__setattr__(self, "number", {(0, 0): 0})
        object.__setattr__(self, "known", {})

    def step(self, state: int, symbol: str) -> Arc:
        found = self.known.get((state, symbol))
        if found is None:
            a, b = self.pairs[state]
            mid, a2, w1 = self.parts[0].step(a, symbol)
            out, b2, w2 = self.parts[1].step(b, mid)
            if (a2, b2) not in self.number:
                self.number[a2, b2] = len(self.pairs)
                self.pairs.append((a2, b2))
            found = self.known[state, symbol] = out, self.number[a2, b2], w1 + w2
        return found


def lexicon(entries: dict[str, float], symbol: str) -> Transducer:
    """``entries``: beginnings of words, or whole words ending in ``$``, with weights; of several that hold the largest counts."""
    arcs: list[dict[str, Arc]] = [{}]
    begun: list[float | None] = [None]  # the largest weight of a beginning on the way to the state

    def child(state: int, letter: str) -> int:
        if letter not in arcs[state]:
            arcs[state][letter] = (letter, len(arcs), 0.0)
            arcs.append({})
            begun.append(None)
        return arcs[state][letter][1]

    whole: dict[int, float] = {}
    for entry, weight in sorted(entries.items()):
        state = 0
        for letter in entry.rstrip("$"):
            state = child(state, letter)
        if entry.endswith("$"):
            whole[state] = max(weight, whole.get(state, weight))
        else:
            begun[state] = weight
    for state in range(len(arcs)):  # parents come before their children
        for _, to, _ in arcs[state].values():
            begun[to] = max((w for w in (begun[state], begun[to]) if w is not None), default=None)
    rest: dict[float | None, int] = {}
    for state in range(len(arcs)):
        # letters that the trie doesn't know lead to a state that only remembers the weight so far
        if begun[state] not in rest:
            rest[begun[state]] = len(arcs)
            arcs.append({"*": ("*", len(arcs), 0.0), "$": ("$" if begun[state] is None else symbol, 0, begun[state] or 0.0)})
        arcs[state]["*"] = ("*", rest[begun[state]], 0.0)
        found = [w for w in (begun[state], whole.get(state)) if w is not None]
        arcs[state]["$"] = (symbol, 0, max(found)) if found else ("$", 0, 0.0)
    return Transducer(tuple(arcs))
