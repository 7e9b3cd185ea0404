"""Rewrite rules as transducers.

A rule's candidates are strings of label pairs in which every rewritten stretch stands in brackets of its mapping and context. Conditions on candidates are
automata over these label pairs: contexts are looked up on either side, an obligatory rule has no unbracketed match, a directed rule has no match that begins earlier
(leftmost) and none at the same place that is longer (or shorter). What is left, without the brackets, is the rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from tapeworks.plans import algebra as A
from tapeworks.plans.fst import EPSILON, IDENTITY, SPECIAL, UNKNOWN, Fst, FstError, empty, epsilon, symbol, universal

BOUNDARY = ".#."
OPTIONAL, OBLIGATORY, LEFT_LONGEST, LEFT_SHORTEST, RIGHT_LONGEST, RIGHT_SHORTEST = "(->)", "->", "@->", "@>", "->@", ">@"
#: Sides on which left and right contexts are looked up.
SIDES = {"||": ("input", "input"), "//": ("output", "input"), "\\\\": ("input", "output"), "\\/": ("output", "output")}


@dataclass
class Mapping:
    """upper to lower; or upper kept with something before and after it. ``dotted``: an empty match is one insertion at each place."""

    upper: Fst
    lower: Fst | None = None
    before: Fst | None = None
    after: Fst | None = None
    dotted: bool = False
    #: Any relation; upper is its input side.
    pairs: Fst | None = None

    def relation(self, upper: Fst) -> Fst:
        if self.pairs is not None:
            return A.compose(upper, self.pairs)
        if self.lower is not None:
            return A.cross_product(upper, self.lower)
        return A.concat(A.cross_product(epsilon(), self.before or epsilon()), upper, A.cross_product(epsilon(), self.after or epsilon()))

    def reversed(self) -> Mapping:
        turn = lambda f: None if f is None else A.reverse(f)
        return Mapping(A.reverse(self.upper), turn(self.lower), turn(self.after), turn(self.before), self.dotted, turn(self.pairs))


@dataclass
class Rule:
    mappings: list[Mapping]
    arrow: str = OBLIGATORY
    contexts: list[tuple[Fst, Fst]] = field(default_factory=list)
    sides: str = "||"

    def parts(self) -> list[Fst]:
        out = [f for m in self.mappings for f in (m.upper, m.lower, m.before, m.after, m.pairs) if f is not None]
        return out + [f for c in self.contexts for f in c]


class _Compiler:
    def __init__(self, rules: Sequence[Rule]):
        self.rules = rules
        self.every = set().union(*(f.alphabet for r in rules for f in r.parts()), set()) - SPECIAL | {BOUNDARY}
        self.brackets: list[tuple[str, str]] = []

    def known(self, f: Fst) -> Fst:
        """Knows all symbols; any other symbol means neither a bracket nor the boundary."""
        return A.insert_to_alphabet(A.expand(f, self.every - {BOUNDARY}), {BOUNDARY} | {b for p in self.brackets for b in p})

    def compile(self) -> Fst:
        stretches, inserts, jobs = [], [], []
        for rule in self.rules:
            for m in rule.mappings:
                upper = A.minimize(A.without_weights(m.upper))
                solid = A.subtract(upper, epsilon())
                hollow = not A.is_empty(A.intersect(upper, epsilon()))
                for left, right in rule.contexts or [(epsilon(), epsilon())]:
                    for part, is_insert in ((solid, False), (epsilon() if hollow else empty(), True)):
                        if A.is_empty(part):
                            continue
                        k = len(self.brackets)
                        self.brackets.append((f"@_<{k}_@", f"@_>{k}_@"))
                        relation = m.relation(part if not is_insert else epsilon())
                        jobs.append((rule, k, part, left, right, is_insert))
                        (inserts if is_insert else stretches).append((k, relation))
        marks = {b for p in self.brackets for b in p}
        plain = Fst([[(IDENTITY, IDENTITY, 0.0, 1)], []], {1: 0.0}, self.every | marks)
        for s in sorted(self.every - {BOUNDARY}):
            plain.arcs[0].append((s, s, 0.0, 1))
        region = lambda k, relation: A.concat(self._mark(self.brackets[k][0]), self.known(relation), self._mark(self.brackets[k][1]))
        body = A.union(plain, *(region(k, r) for k, r in stretches))
        if inserts:
            extra = A.optional(A.union(*(region(k, r) for k, r in inserts)))
            inner = A.concat(extra, A.star(A.concat(body, extra)))
        else:
            inner = A.star(body)
        edge = self._mark(BOUNDARY)
        self.inner = A.determinize(A.without_weights(self.known(inner)))
        whole = A.concat(edge, A.remove_epsilons(self.known(inner)), edge)
        self.pairs = sorted({(i, o) for _, i, o, _, _ in A.remove_epsilons(whole)})
        self.prefix = A.concat(edge, self.inner)
        self.plain = plain
        self.no_marks = [p for p in self.pairs if p[0] not in marks]
        result = A.remove_epsilons(whole)
        for bad in self._forbidden(jobs):
            result = A.subtract(result, bad)
        names = dict.fromkeys(marks | {BOUNDARY}, EPSILON)
        result = A.substitute_map(result, names)
        result.alphabet = self.every - {BOUNDARY}
        result = A.remove_epsilons(result)
        return A.minimize(result) if not result.has_weights() else result

    def _mark(self, s: str) -> Fst:
        f = symbol(s)
        f.alphabet |= self.every | {b for p in self.brackets for b in p}
        return f

    def _strings(self, pairs: Sequence[tuple[str, str]], least: int = 0) -> Fst:
        """At least so many (0 or 1) of the label pairs."""
        f = Fst([[(i, o, 0.0, 0) for i, o in pairs]], {0: 0.0}, self.every | {b for p in self.brackets for b in p})
        if not least:
            return f
        return f.like([[(i, o, 0.0, 1) for i, o in pairs], [(i, o, 0.0, 1) for i, o in pairs]], {1: 0.0})

    def lift(self, f: Fst, side: str) -> Fst:
        """Candidate strings whose one side, without brackets and epsilons, is in the automaton."""
        f = A.determinize(A.without_weights(self.known(f)))
        pick, marks = (0 if side == "input" else 1), {b for p in self.brackets for b in p}
        arcs = []
        for s, row in enumerate(f.arcs):
            table = {i: d for i, _, _, d in row}
            new = []
            for i, o in self.pairs:
                x = (i, o)[pick]
                if x == EPSILON or x in marks:
                    new.append((i, o, 0.0, s))
                else:
                    d = table.get(IDENTITY if x in (IDENTITY, UNKNOWN) else x)
                    if d is not None:
                        new.append((i, o, 0.0, d))
            arcs.append(new)
        return f.like(arcs, dict(f.finals), self.every | marks)

    def anything(self) -> Fst:
        f = universal()
        f.alphabet |= self.every
        f.arcs[0] += [(s, s, 0.0, 0) for s in sorted(self.every)]
        return f

    def _forbidden(self, jobs: list) -> list[Fst]:
        every, out = self._strings(self.pairs), []
        opens = lambda k: self._mark(self.brackets[k][0])
        closes = lambda k: self._mark(self.brackets[k][1])
        ends = A.union(empty(), *(A.concat(every, closes(k)) for _, k, *_, ins in jobs if ins))
        begins = A.union(empty(), *(A.concat(opens(k), every) for _, k, *_, ins in jobs if ins))
        for rule, k, upper, left, right, is_insert in jobs:
            side_l, side_r = SIDES[rule.sides]
            before = self.lift(A.concat(self.anything(), self.known(left)), side_l)
            after = self.lift(A.concat(self.known(right), self.anything()), side_r)
            out.append(A.concat(A.subtract(every, before), opens(k), every))
            out.append(A.concat(every, closes(k), A.subtract(every, after)))
            if rule.arrow == OPTIONAL:
                continue
            start = A.intersect(before, self.prefix)
            if is_insert:
                out.append(A.concat(A.subtract(start, ends), A.subtract(after, begins)))
                continue
            match = self.lift(upper, "input")
            unmarked = A.intersect(match, A.star(self.plain))
            out.append(A.concat(start, unmarked, after))
            if rule.arrow == OBLIGATORY:
                continue
            first_plain = A.intersect(match, A.concat(self.plain, every))
            out.append(A.concat(start, first_plain, after))
            no_marks = self._strings(self.no_marks)
            real = [p for p in self.pairs if p in set(self.no_marks) and p[0] != EPSILON]
            more = A.concat(every, self._strings(real, 1), every)
            for other, j, *_, ins in jobs:
                if ins or other.arrow != rule.arrow:
                    continue
                if rule.arrow == LEFT_LONGEST:
                    longer = A.intersect(match, A.concat(opens(j), no_marks, closes(j), more))
                    out.append(A.concat(start, longer, after))
                else:
                    shorter = A.intersect(match, A.concat(opens(j), no_marks))
                    rest = A.intersect(after, A.concat(no_marks, self._strings(real, 1), no_marks, closes(j), every))
                    out.append(A.concat(start, shorter, rest))
        return out


def replace(rules: Sequence[Rule]) -> Fst:
    """Parallel rules as one transducer; all directed ones in the same direction."""
    arrows = {r.arrow for r in rules}
    if arrows & {RIGHT_LONGEST, RIGHT_SHORTEST}:
        if arrows - {RIGHT_LONGEST, RIGHT_SHORTEST}:
            raise FstError("parallel rules need one direction")
        turned = {"||": "||", "//": "\\\\", "\\\\": "//", "\\/": "\\/"}
        mirror = [
            Rule([m.reversed() for m in r.mappings], LEFT_LONGEST if r.arrow == RIGHT_LONGEST else LEFT_SHORTEST, [(A.reverse(b), A.reverse(a)) for a, b in r.contexts], turned[r.sides])
            for r in rules
        ]
        return A.minimize(A.reverse(_Compiler(mirror).compile()))
    return _Compiler(rules).compile()


def replace_left(rules: Sequence[Rule]) -> Fst:
    """The inverse relation: lower strings are rewritten to upper ones."""
    return A.invert(replace(rules))


def _with_edges(f: Fst, every: set[str]) -> Fst:
    """Strings whose form with boundaries around them is in f; the boundaries go."""
    inside = universal()
    inside.alphabet |= every | {BOUNDARY}
    inside.arcs[0] += [(s, s, 0.0, 0) for s in sorted(every - {BOUNDARY})]
    edge = symbol(BOUNDARY)
    kept = A.intersect(A.concat(edge, inside, edge), f)
    out = A.remove_epsilons(A.substitute_map(kept, {BOUNDARY: EPSILON}))
    out.alphabet = every - {BOUNDARY}
    return out


def restriction(centre: Fst, contexts: Sequence[tuple[Fst, Fst]]) -> Fst:
    """Strings in which every occurrence of the centre stands in one of the contexts."""
    opened, closed = "@_<_@", "@_>_@"
    every = set().union(centre.alphabet, *(f.alphabet for c in contexts for f in c)) - SPECIAL
    known = every | {opened, closed, BOUNDARY}
    free = Fst([[(IDENTITY, IDENTITY, 0.0, 0)]], {0: 0.0}, set(known))
    free.arcs[0] += [(s, s, 0.0, 0) for s in sorted(every | {BOUNDARY})]
    grow = lambda f: A.insert_to_alphabet(A.expand(A.without_weights(f), every - {BOUNDARY}), known)
    middle = A.concat(symbol(opened), grow(centre), symbol(closed))
    occurs = A.concat(free, middle, free)
    good = A.union(empty(), *(A.concat(free, grow(a), middle, grow(b), free) for a, b in contexts))
    bad = A.substitute_map(A.subtract(occurs, good), {opened: EPSILON, closed: EPSILON})
    allowed = A.subtract(free, A.remove_epsilons(bad))
    return A.minimize(_with_edges(allowed, every))


def coercion(relation: Fst, contexts: Sequence[tuple[Fst, Fst]], pairs: Sequence[tuple[str, str]], obligatory: bool = True) -> Fst:
    """Pair strings over the pairs in which, in the contexts, an input that the relation (of single pairs) has is realised as the relation says.

    With ``obligatory`` False its pairs may not occur in the contexts at all.
    """
    every = {s for p in pairs for s in p} - SPECIAL
    mine = {(i, o) for _, i, o, _, _ in relation}
    inputs = {i for i, _ in mine}
    wrong = mine if not obligatory else {p for p in pairs if p[0] in inputs and p not in mine}
    free = Fst([[(i, o, 0.0, 0) for i, o in pairs]], {0: 0.0}, set(every))
    one = Fst([[(i, o, 0.0, 1) for i, o in sorted(wrong)], []], {1: 0.0}, set(every))
    bad = A.union(empty(), *(A.concat(free, a, one, b, free) for a, b in contexts))
    return A.subtract(free, bad)


def pair_restriction(centre: Sequence[tuple[str, str]], contexts: Sequence[tuple[Fst, Fst]], pairs: Sequence[tuple[str, str]]) -> Fst:
    """Pair strings over the pairs in which the centre's pairs occur in the contexts only."""
    every = {s for p in pairs for s in p} - SPECIAL
    mark = "@_<_@"
    free = Fst([[(i, o, 0.0, 0) for i, o in pairs]], {0: 0.0}, every | {mark})
    one = Fst([[(i, o, 0.0, 1) for i, o in sorted(set(centre))], []], {1: 0.0}, every | {mark})
    middle = A.concat(symbol(mark), one)
    good = A.union(empty(), *(A.concat(free, a, middle, b, free) for a, b in contexts))
    bad = A.remove_epsilons(A.substitute_map(A.subtract(A.concat(free, middle, free), good), {mark: EPSILON}))
    return A.subtract(free, bad)


def before(a: Fst, b: Fst) -> Fst:
    """Strings in which no a comes after a b."""
    return A.negate(A.concat(universal(), b, universal(), a, universal()))


def after(a: Fst, b: Fst) -> Fst:
    return before(b, a)


Contexts = Sequence[tuple[Fst, Fst]]


def _replaced(relation: Fst, contexts: Contexts, sides: str, optional: bool, left: bool) -> Fst:
    """A relation applied wherever its input side stands in a context; left: the inverse of that for the inverse relation."""
    pairs = A.invert(relation) if left else relation
    rule = Rule([Mapping(A.project(pairs, "input"), pairs=pairs)], OPTIONAL if optional else OBLIGATORY, list(contexts), sides)
    return (replace_left if left else replace)([rule])


def replace_up(relation: Fst, contexts: Contexts = (), optional: bool = False) -> Fst:
    """Both contexts on the input side."""
    return _replaced(relation, contexts, "||", optional, False)


def replace_right(relation: Fst, contexts: Contexts = (), optional: bool = False) -> Fst:
    """The left context on the output side."""
    return _replaced(relation, contexts, "//", optional, False)


def replace_left_sided(relation: Fst, contexts: Contexts = (), optional: bool = False) -> Fst:
    """The right context on the output side."""
    return _replaced(relation, contexts, "\\\\", optional, False)


def replace_down(relation: Fst, contexts: Contexts = (), optional: bool = False) -> Fst:
    """Both contexts on the output side."""
    return _replaced(relation, contexts, "\\/", optional, False)


def left_replace_up(relation: Fst, contexts: Contexts = (), optional: bool = False) -> Fst:
    """Outputs rewritten to inputs, both contexts on the output side of the result."""
    return _replaced(relation, contexts, "||", optional, True)


def left_replace_right(relation: Fst, contexts: Contexts = (), optional: bool = False) -> Fst:
    return _replaced(relation, contexts, "//", optional, True)


def left_replace_left(relation: Fst, contexts: Contexts = (), optional: bool = False) -> Fst:
    return _replaced(relation, contexts, "\\\\", optional, True)


def left_replace_down(relation: Fst, contexts: Contexts = (), optional: bool = False) -> Fst:
    return _replaced(relation, contexts, "\\/", optional, True)


Pairs = Sequence[tuple[str, str]]


def surface_restriction(centre: Pairs, contexts: Contexts, pairs: Pairs) -> Fst:
    """Pair strings in which pairs with an output of the centre occur in the contexts only."""
    outputs = {o for _, o in centre}
    return pair_restriction([p for p in pairs if p[1] in outputs], contexts, pairs)


def deep_restriction(centre: Pairs, contexts: Contexts, pairs: Pairs) -> Fst:
    """Pair strings in which pairs with an input of the centre occur in the contexts only."""
    inputs = {i for i, _ in centre}
    return pair_restriction([p for p in pairs if p[0] in inputs], contexts, pairs)


def _coerced(centre: Pairs, contexts: Contexts, pairs: Pairs, side: int) -> Fst:
    given = {p[side] for p in centre}
    wrong = sorted(p for p in pairs if p[side] in given and p not in set(centre))
    every = {s for p in pairs for s in p} - SPECIAL
    free = Fst([[(i, o, 0.0, 0) for i, o in pairs]], {0: 0.0}, set(every))
    one = Fst([[(i, o, 0.0, 1) for i, o in wrong], []], {1: 0.0}, set(every))
    return A.subtract(free, A.union(empty(), *(A.concat(free, a, one, b, free) for a, b in contexts)))


def deep_coercion(centre: Pairs, contexts: Contexts, pairs: Pairs) -> Fst:
    """Pair strings in which, in the contexts, an input of the centre is realised as the centre says."""
    return _coerced(centre, contexts, pairs, 0)


def surface_coercion(centre: Pairs, contexts: Contexts, pairs: Pairs) -> Fst:
    """Pair strings in which, in the contexts, an output of the centre comes from an input that the centre says."""
    return _coerced(centre, contexts, pairs, 1)


def restriction_and_coercion(centre: Pairs, contexts: Contexts, pairs: Pairs) -> Fst:
    """Both: the centre's pairs in the contexts only, and there always."""
    return A.intersect(pair_restriction(centre, contexts, pairs), deep_coercion(centre, contexts, pairs))


def surface_restriction_and_coercion(centre: Pairs, contexts: Contexts, pairs: Pairs) -> Fst:
    return A.intersect(surface_restriction(centre, contexts, pairs), surface_coercion(centre, contexts, pairs))


def deep_restriction_and_coercion(centre: Pairs, contexts: Contexts, pairs: Pairs) -> Fst:
    return A.intersect(deep_restriction(centre, contexts, pairs), deep_coercion(centre, contexts, pairs))
