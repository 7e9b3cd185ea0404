"""The logical form of a transducer: arcs, final weights and an alphabet, state 0 initial.

Grammars are small beside the texts that they are applied to, so an ``Fst`` is an ordinary value on the driver, like a query plan. It becomes three tables
(``tables``) for analysis in Spark, or a compiled payload (``lookup``) that Python workers apply to text columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np

# The special symbols of the exchange formats.
EPSILON = "@_EPSILON_SYMBOL_@"
UNKNOWN = "@_UNKNOWN_SYMBOL_@"
IDENTITY = "@_IDENTITY_SYMBOL_@"
DEFAULT = "@_DEFAULT_SYMBOL_@"
SPECIAL = frozenset({EPSILON, UNKNOWN, IDENTITY, DEFAULT})
WILD = frozenset({UNKNOWN, IDENTITY})
FLAG = re.compile(r"^@([PNDRCU])\.([^.@]+)(?:\.([^@]+))?@$")

#: Symbols of this form are actions of a pattern (tags, calls, conditions); no wildcard means them.
MARKER = "@:"

Arc = tuple[str, str, float, int]


class FstError(Exception):
    """An operation's contract is broken."""


class CyclicError(FstError):
    """All paths of a cyclic transducer were asked for."""


class NotAutomatonError(FstError):
    """An operation on automata got a transducer whose sides differ."""


class FormatError(FstError):
    """A text or file isn't in the format that it is read as."""


class UnsupportedError(FstError):
    """A construct that the languages define but that has no meaning here."""


def f32(x: float) -> float:
    """Weights have single precision."""
    return float(np.float32(x))


def is_flag(symbol: str) -> bool:
    return symbol.startswith("@") and FLAG.match(symbol) is not None


def parse_flag(symbol: str) -> tuple[str, str, str | None]:
    m = FLAG.match(symbol)
    if not m:
        raise FstError(f"not a flag: {symbol}")
    return m[1], m[2], m[3]


@dataclass
class Fst:
    """arcs[state] has (input, output, weight, target); a state is final where finals has it."""

    arcs: list[list[Arc]] = field(default_factory=lambda: [[]])
    finals: dict[int, float] = field(default_factory=dict)
    alphabet: set[str] = field(default_factory=set)
    name: str = ""
    props: dict[str, str] = field(default_factory=dict)
    semiring: str = "tropical"

    # building

    def add_state(self) -> int:
        self.arcs.append([])
        return len(self.arcs) - 1

    def need(self, state: int) -> int:
        while len(self.arcs) <= state:
            self.arcs.append([])
        return state

    def add_arc(self, src: int, dst: int, isym: str, osym: str, weight: float = 0.0) -> None:
        if not isym or not osym:
            raise FstError("empty symbol")
        self.need(max(src, dst))
        self.arcs[src].append((isym, osym, float(weight), dst))
        self.alphabet.update(s for s in (isym, osym) if s not in SPECIAL)

    def set_final(self, state: int, weight: float = 0.0) -> None:
        self.need(state)
        self.finals[state] = float(weight)

    def copy(self) -> Fst:
        return Fst([list(a) for a in self.arcs], dict(self.finals), set(self.alphabet), self.name, dict(self.props), self.semiring)

    def like(self, arcs: list[list[Arc]], finals: dict[int, float], alphabet: Iterable[str] | None = None) -> Fst:
        return Fst(arcs, finals, set(self.alphabet if alphabet is None else alphabet), self.name, dict(self.props), self.semiring)

    # looking

    def __iter__(self) -> Iterator[tuple[int, str, str, float, int]]:
        for src, arcs in enumerate(self.arcs):
            for isym, osym, w, dst in arcs:
                yield src, isym, osym, w, dst

    @property
    def n_states(self) -> int:
        return len(self.arcs)

    @property
    def n_arcs(self) -> int:
        return sum(map(len, self.arcs))

    def symbols_used(self) -> set[str]:
        return {s for _, i, o, _, _ in self for s in (i, o) if s not in SPECIAL}

    def flags(self) -> set[str]:
        return {s for s in self.alphabet if is_flag(s)}

    def is_automaton(self) -> bool:
        return all(i == o and i != UNKNOWN for _, i, o, _, _ in self)

    def has_weights(self) -> bool:
        return any(w for _, _, _, w, _ in self) or any(self.finals.values())

    def need_automaton(self, what: str) -> None:
        if not self.is_automaton():
            raise NotAutomatonError(f"{what} needs automata")


def empty() -> Fst:
    """The empty language."""
    return Fst()


def epsilon(weight: float = 0.0) -> Fst:
    """The empty string."""
    return Fst([[]], {0: weight})


def pair(isym: str, osym: str, weight: float = 0.0) -> Fst:
    f = Fst()
    f.add_arc(0, 1, isym, osym, weight)
    f.set_final(1)
    return f


def symbol(sym: str, weight: float = 0.0) -> Fst:
    return pair(sym, sym, weight)


def any_symbol() -> Fst:
    """Any one symbol, copied."""
    return pair(IDENTITY, IDENTITY)


def any_pair() -> Fst:
    """Any one symbol to any one symbol."""
    f = pair(IDENTITY, IDENTITY)
    f.add_arc(0, 1, UNKNOWN, UNKNOWN)
    return f


def universal() -> Fst:
    """All strings."""
    f = Fst([[(IDENTITY, IDENTITY, 0.0, 0)]], {0: 0.0})
    return f


def from_pairs(pairs: Sequence[tuple[str, str]], weight: float = 0.0) -> Fst:
    """One path."""
    f = Fst()
    for k, (i, o) in enumerate(pairs):
        f.add_arc(k, k + 1, i, o)
    f.set_final(len(pairs), weight)
    return f


def symbols_of(text: str, multichar: Iterable[str] = ()) -> list[str]:
    """Symbols of a text: the longest multi-character symbol that fits, else one code point."""
    longer = sorted((m for m in multichar if len(m) > 1), key=len, reverse=True)
    if not longer:
        return list(text)
    pattern = re.compile("|".join(map(re.escape, longer)) + "|.", re.S)
    return pattern.findall(text)


def from_string(upper: str, lower: str | None = None, weight: float = 0.0, multichar: Iterable[str] = ()) -> Fst:
    """One string, or a pair of strings whose shorter side is padded with epsilon at its end."""
    a = symbols_of(upper, multichar)
    b = a if lower is None else symbols_of(lower, multichar)
    n = max(len(a), len(b))
    return from_pairs(list(zip(a + [EPSILON] * (n - len(a)), b + [EPSILON] * (n - len(b)), strict=True)), weight)


def from_words(words: Iterable[str | tuple[str, float] | tuple[str, str, float]], multichar: Iterable[str] = ()) -> Fst:
    """A trie of words, of (word, weight) or of (upper, lower, weight); equal entries keep the smallest weight."""
    f, multichar = Fst(), list(multichar)
    index: list[dict[tuple[str, str], int]] = [{}]
    for w in words:
        upper, lower, weight = (w, None, 0.0) if isinstance(w, str) else (w[0], None, w[1]) if len(w) == 2 else w
        a = symbols_of(upper, multichar)
        b = a if lower is None else symbols_of(lower, multichar)
        n, state = max(len(a), len(b)), 0
        for key in zip(a + [EPSILON] * (n - len(a)), b + [EPSILON] * (n - len(b)), strict=True):
            to = index[state].get(key)
            if to is None:
                to = f.add_state()
                index.append({})
                f.add_arc(state, to, *key)
                index[state][key] = to
            state = to
        f.finals[state] = min(weight, f.finals.get(state, float("inf")))
    return f
