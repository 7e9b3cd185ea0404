"""The compiled form of a transducer for application to text, and the search over one input.

Arcs are dictionaries by input symbol; a payload is an ordinary picklable value that goes to Python workers once. All state of a search belongs to one
row: symbols that a transducer doesn't know stay what they are in the row, and never enter an alphabet.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from tapeworks.plans import algebra as A
from tapeworks.plans.fst import DEFAULT, EPSILON, IDENTITY, SPECIAL, UNKNOWN, Fst, f32, is_flag

#: Silent steps in a row that a search takes at least before it gives a branch up; a transducer with more states gets as many as it has. Only cycles without input need more.
MOST_SILENT = 5000
#: Texts from which a search first finds the states that can reach the text's end.
LONG = 256


@dataclass
class Compiled:
    """arcs[state] by input symbol: (output, weight, target); silent[state]: epsilon and flag arcs (flag or None, output, weight, target)."""

    arcs: list[dict[str, list[tuple[str, float, int]]]]
    silent: list[list[tuple[str | None, str, float, int]]]
    finals: dict[int, float]
    alphabet: frozenset[str]
    pattern: str | None

    def split(self, text: str) -> list[str]:
        """The longest symbol of the alphabet at each place, else one code point."""
        return re.findall(self.pattern, text, re.S) if self.pattern else list(text)


def compile_fst(f: Fst) -> Compiled:
    arcs, silent = [], []
    for row in f.arcs:
        table: dict[str, list] = {}
        quiet = []
        for i, o, w, d in row:
            if i == EPSILON:
                quiet.append((None, o, w, d))
            elif is_flag(i):
                quiet.append((i, EPSILON if o == i else o, w, d))
            else:
                table.setdefault(i, []).append((o, w, d))
        arcs.append(table)
        silent.append(quiet)
    longer = sorted((s for s in f.alphabet if len(s) > 1 and not is_flag(s) and s not in SPECIAL), key=len, reverse=True)
    pattern = "|".join([*map(re.escape, longer), "."]) if longer else None
    return Compiled(arcs, silent, dict(f.finals), frozenset(f.alphabet), pattern)


def lookup(c: Compiled, text: str | list[str], obey_flags: bool = True, most: int | None = None, max_depth: int | None = None, max_weight: float | None = None, cycles: int | None = None, seconds: float | None = None, pairs: bool = False, show_flags: bool = False) -> list[tuple[float, tuple]]:
    """All (weight, outputs) for an input, as a set ordered by weight, then outputs; with most, the best so many.

    Depth-first with an explicit stack, for texts of any length. ``max_depth`` drops branches with more steps; ``cycles`` is how often a state may come again without a symbol read. A flag
    loop is cut at the same state and registers; a loop that gives output for no input is followed for MOST_SILENT steps, or as many as there are states. A default arc is taken only where
    nothing else was followed from the state, epsilon arcs included. In long texts, ways that can't reach the end aren't followed.
    """
    tape = c.split(text) if isinstance(text, str) else list(text)
    known = [s in c.alphabet for s in tape]
    n, found = len(tape), set()
    alive = _alive(c, tape, known) if n >= LONG else None
    stop = time.process_time() + seconds if seconds else None
    most_silent = max(MOST_SILENT, len(c.arcs))
    # outputs are linked from the last to the first, so that a step costs the same anywhere in a text
    stack: list[tuple] = [(0, 0, 0.0, None, (), (), 0)] if alive is None or 0 in alive[0] else []
    count = 0
    while stack:
        state, at, w, out, registers, trail, depth = stack.pop()
        count += 1
        if stop and count % 256 == 0 and time.process_time() > stop:
            break
        if max_weight is not None and w > max_weight:
            continue
        if at == n and state in c.finals:
            total = f32(w + c.finals[state])
            if max_weight is None or total <= max_weight:
                found.add((total, _unlinked(out)))
        if (max_depth is not None and depth >= max_depth) or len(trail) >= most_silent:
            continue
        followed = False
        here = (state, registers)
        for flag, o, v, d in c.silent[state]:
            after = registers
            if flag is not None and obey_flags:
                got = A.apply_flag(flag, dict(registers))
                if got is None:
                    continue
                after = tuple(sorted(got.items()))
            if flag is not None and (d, after) in trail:
                continue
            if flag is None and cycles is not None and sum(t[0] == d for t in trail) > cycles:
                continue
            if flag is None and cycles is None and (d, after) in trail and o == EPSILON and v >= 0:
                continue
            followed = True
            if alive is not None and d not in alive[at]:
                continue
            given = out
            if flag is not None and show_flags:
                given = (given, flag)
            if o != EPSILON:
                given = (given, (EPSILON, o) if pairs else o)
            stack.append((d, at, w + v, given, after, (*trail, here), depth + 1))
        if at >= n:
            continue
        s = tape[at]
        moves = c.arcs[state].get(s, []) if known[at] else [*c.arcs[state].get(IDENTITY, []), *c.arcs[state].get(UNKNOWN, [])]
        if not moves and not followed:
            moves = c.arcs[state].get(DEFAULT, [])
        for o, v, d in moves:
            if alive is not None and d not in alive[at + 1]:
                continue
            o = s if o in (IDENTITY, UNKNOWN, DEFAULT) else o
            given = (out, (s, o)) if pairs else out if o == EPSILON else (out, o)
            stack.append((d, at + 1, w + v, given, registers, (), depth + 1))
    result = sorted(found)
    return result if most is None else result[:most]


def _unlinked(out: tuple | None) -> tuple:
    symbols = []
    while out is not None:
        out, symbol = out
        symbols.append(symbol)
    return tuple(reversed(symbols))


def _alive(c: Compiled, tape: list[str], known: list[bool]) -> list[frozenset[int]]:
    """For each place of a tape the states that lie on a way from its beginning to its end, where flags refuse nothing and default arcs are always taken."""
    kept: dict[tuple, tuple] = {}

    def moves(layer: frozenset[int], s: str, is_known: bool) -> tuple[frozenset[int], dict[int, set[int]]]:
        key = (layer, s if is_known else None)
        if key not in kept:
            to = {x: {d for i in ((s, DEFAULT) if is_known else (IDENTITY, UNKNOWN, DEFAULT)) for _, _, d in c.arcs[x].get(i, ())} for x in layer}
            kept[key] = (closed(frozenset().union(*to.values())), to)
        return kept[key]

    def closed(states: frozenset[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for _, _, _, d in c.silent[todo.pop()]:
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        return frozenset(seen)

    layers, steps = [closed(frozenset([0]))], []
    for s, is_known in zip(tape, known, strict=True):
        after, to = moves(layers[-1], s, is_known)
        layers.append(after)
        steps.append(to)

    def back(layer: frozenset[int], good: set[int]) -> frozenset[int]:
        """States of a layer from which silent steps lead to good ones."""
        good, grown = set(good), True
        while grown:
            more = {s for s in layer - good if any(d in good for _, _, _, d in c.silent[s])}
            grown = bool(more)
            good |= more
        return frozenset(good)

    alive = [back(layers[-1], {s for s in layers[-1] if s in c.finals})]
    past: dict[tuple, frozenset[int]] = {}
    for k in range(len(tape) - 1, -1, -1):
        key = (layers[k], tape[k] if known[k] else None, alive[-1])
        if key not in past:
            past[key] = back(layers[k], {s for s, to in steps[k].items() if not to.isdisjoint(alive[-1])})
        alive.append(past[key])
    return alive[::-1]


def lookup_tags(c: Compiled, text: str, diacritics: bool, seconds: float | None = None) -> list[str]:
    """The outputs, flags only or everything but flags, joined; in order of weight and symbols, equal strings kept."""
    return ["".join(s for s in out if is_flag(s) == diacritics) for _, out in lookup(c, text, seconds=seconds, show_flags=True)]


def is_infinitely_ambiguous_for(c: Compiled, text: str) -> bool:
    """Whether reading the input can go round a cycle that reads nothing."""
    tape = c.split(text)
    layer, seen_any = {0}, False
    for at in range(len(tape) + 1):
        todo, reach = list(layer), set(layer)
        while todo:
            s = todo.pop()
            for _, _, _, d in c.silent[s]:
                if d not in reach:
                    reach.add(d)
                    todo.append(d)
        number = {s: k for k, s in enumerate(reach)}
        if A.is_cyclic_graph([[number[d] for _, _, _, d in c.silent[s]] for s in number]):
            return True
        if at < len(tape):
            s = tape[at]
            layer = {d for x in reach for _, _, d in (c.arcs[x].get(s, []) if s in c.alphabet else c.arcs[x].get(IDENTITY, []) + c.arcs[x].get(UNKNOWN, []))}
            seen_any |= bool(layer)
    return False


def is_lookdown_infinitely_ambiguous(f: Fst, text: str) -> bool:
    """Whether a text has endlessly many inputs that give it."""
    return is_infinitely_ambiguous_for(compile_fst(A.invert(f)), text)


def aligned_with_flags(upper: list[str], lower: list[str]) -> list[tuple[str, str]]:
    """Symbol pairs of two sides, a flag of either side standing on both; what is left over on the longer side has epsilons beside it."""
    out, k, j = [], 0, 0
    while k < len(upper) or j < len(lower):
        u, d = upper[k] if k < len(upper) else None, lower[j] if j < len(lower) else None
        if u is not None and is_flag(u):
            out.append((u, u))
            k, j = k + 1, j + (d == u)
        elif d is not None and is_flag(d):
            out.append((d, d))
            j += 1
        else:
            out.append((EPSILON if u is None else u, EPSILON if d is None else d))
            k, j = k + 1, j + 1
    return out


def accepts(c: Compiled, text: str) -> bool:
    """Whether there is any result; states only, flags obeyed."""
    tape = c.split(text)
    layer = {(0, ())}
    for at in range(len(tape) + 1):
        todo, reach = list(layer), set(layer)
        while todo:
            s, registers = todo.pop()
            for flag, _, _, d in c.silent[s]:
                after = registers
                if flag is not None:
                    got = A.apply_flag(flag, dict(registers))
                    if got is None:
                        continue
                    after = tuple(sorted(got.items()))
                if (d, after) not in reach:
                    reach.add((d, after))
                    todo.append((d, after))
        if at == len(tape):
            return any(s in c.finals for s, _ in reach)
        s, layer = tape[at], set()
        for x, registers in reach:
            moves = c.arcs[x].get(s, []) if s in c.alphabet else c.arcs[x].get(IDENTITY, []) + c.arcs[x].get(UNKNOWN, [])
            if not moves and not c.silent[x]:
                moves = c.arcs[x].get(DEFAULT, [])
            layer |= {(d, registers) for _, _, d in moves}
        if not layer:
            return False
    return False


def correct(lexicon: Compiled, errors: Compiled, word: str, most: int | None = None, max_weight: float | None = None) -> list[tuple[float, str]]:
    """Corrections of a word: outputs that the error model gives for it and that the lexicon accepts, each with its smallest weight, lightest first."""
    import heapq

    tape = errors.split(word)
    best: dict[tuple, float] = {}
    heap: list = [(0.0, 0, 0, 0, "", ())]
    found: dict[str, float] = {}
    while heap:
        w, at, e, x, out, registers = heapq.heappop(heap)
        key = (at, e, x, out, registers)
        if best.get(key, float("inf")) <= w or (max_weight is not None and w > max_weight):
            continue
        best[key] = w
        if most is not None and len(found) >= most and w > sorted(found.values())[most - 1]:
            break
        if at == len(tape) and e in errors.finals and x in lexicon.finals:
            total = f32(w + errors.finals[e] + lexicon.finals[x])
            if max_weight is None or total <= max_weight:
                found[out] = min(total, found.get(out, float("inf")))
        for flag, _, v, d in lexicon.silent[x]:
            after = registers
            if flag is not None:
                got = A.apply_flag(flag, dict(registers))
                if got is None:
                    continue
                after = tuple(sorted(got.items()))
            heapq.heappush(heap, (w + v, at, e, d, out, after))

        def consume(o: str, w: float, at: int, e: int) -> None:
            if o == EPSILON:
                heapq.heappush(heap, (w, at, e, x, out, registers))
                return
            moves = lexicon.arcs[x].get(o, []) if o in lexicon.alphabet else lexicon.arcs[x].get(IDENTITY, [])
            for _, v, d in moves:
                heapq.heappush(heap, (w + v, at, e, d, out + o, registers))

        for _, o, v, d in errors.silent[e]:
            if o in (IDENTITY, UNKNOWN):
                for s in lexicon.arcs[x]:
                    if s not in SPECIAL:
                        consume(s, w + v, at, d)
            else:
                consume(o, w + v, at, d)
        if at < len(tape):
            s = tape[at]
            moves = errors.arcs[e].get(s, []) if s in errors.alphabet else errors.arcs[e].get(IDENTITY, []) + errors.arcs[e].get(UNKNOWN, [])
            for o, v, d in moves:
                if o == UNKNOWN:
                    for t in lexicon.arcs[x]:
                        if t != s and t not in SPECIAL:
                            consume(t, w + v, at + 1, d)
                else:
                    consume(s if o == IDENTITY else o, w + v, at + 1, d)
    ranked = sorted((w, s) for s, w in found.items())
    return ranked if most is None else ranked[:most]


def edit_model(distance: int, symbols: str = "", insert: float = 1.0, delete: float = 1.0, replace: float = 1.0, swap: float | None = 1.0) -> Fst:
    """Up to so many edits of any symbols; swaps are of neighbouring symbols listed."""
    f = Fst()
    f.alphabet |= set(symbols)
    every = [*symbols, IDENTITY]
    for k in range(distance + 1):
        f.set_final(k)
        for s in every:
            f.add_arc(k, k, s, s)
    for k in range(distance):
        f.add_arc(k, k + 1, EPSILON, UNKNOWN, insert)
        for s in symbols:
            f.add_arc(k, k + 1, EPSILON, s, insert)
            f.add_arc(k, k + 1, s, EPSILON, delete)
            f.add_arc(k, k + 1, s, UNKNOWN, replace)
            f.add_arc(k, k + 1, UNKNOWN, s, replace)
            for t in symbols:
                if s != t:
                    f.add_arc(k, k + 1, s, t, replace)
                    if swap is not None:
                        middle = f.add_state()
                        f.add_arc(k, middle, s, t, swap)
                        f.add_arc(middle, k + 1, t, s, 0.0)
        f.add_arc(k, k + 1, UNKNOWN, EPSILON, delete)
        f.add_arc(k, k + 1, UNKNOWN, UNKNOWN, replace)
    return f
