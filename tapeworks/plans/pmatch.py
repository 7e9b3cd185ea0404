"""The pattern language: scripts of definitions to networks, and the matcher that scans a text with them.

What a network does beside reading symbols is an action on a marker arc: beginnings and tags of delimited stretches, calls of other networks, context conditions,
captures and counters. The matcher follows all ways at once, keeps the longest end at each place (then the lightest way), and goes on behind it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from tapeworks.plans import algebra as A
from tapeworks.plans.fst import EPSILON, IDENTITY, MARKER, SPECIAL, UNKNOWN, Fst, FstError, FormatError, UnsupportedError, any_symbol, epsilon, f32, from_string, is_flag, symbol, universal
from tapeworks.plans.syntax import Node, Parser
from tapeworks.plans.xre import Compiler

BOUNDARY = ".#."
NON_MATCHING = "@_NONMATCHING_@"
#: Symbols of analyses: where a part of the form begins, and where the form may be cut and analysed again.
INPUT_MARK, BACKTRACK = "@PMATCH_INPUT_MARK@", "@PMATCH_BACKTRACK@"
#: The options and their defaults.
DEFAULTS = {
    "count-patterns": "off", "delete-patterns": "off", "extract-patterns": "off", "locate-patterns": "off", "mark-patterns": "on", "max-context-length": "254",
    "max-recursion": "5000", "need-separators": "on", "xerox-composition": "on", "unicode-character-classes": "off", "flatten": "off",
}
#: Character classes; the default ones are of Latin-1 only.
CLASSES: dict[str, Callable[[str], bool]] = {
    "Alpha": str.isalpha, "UppercaseAlpha": str.isupper, "LowercaseAlpha": lambda c: c.isalpha() and c.islower(), "Num": lambda c: c in "0123456789",
    "Punct": lambda c: not c.isalnum() and not c.isspace() and c.isprintable(), "Whitespace": str.isspace,
}
FUNCTIONS = set(
    "EndTag Capture Captured LC RC NLC NRC OR AND Ins Lst Exc Sigma Like Unlike Interpolate Counter Explode Implode Uncompose Cap OptCap UpCase DownCase ToUpper ToLower OptUpCase OptDownCase "
    "OptToUpper OptToLower AnyCase Lit Define".split()
)


@dataclass
class Location:
    """A matched stretch of a text: where, what it reads and gives, its tag and weight, and where its parts begin."""

    start: int
    length: int
    input: str
    output: str
    tag: str
    weight: float
    #: Where parts of the form begin, and after how many output symbols.
    parts: tuple[int, ...] = ()
    oparts: tuple[int, ...] = ()
    osyms: tuple[str, ...] = ()


class PatternCompiler(Compiler):
    """Definitions of a script, compiled when they are used."""

    def __init__(self, reader=None, neighbours: Callable[[list[str], int, bool], list[str]] | None = None):
        super().__init__(reader=reader)
        self.nodes: dict[str, Node] = {}
        self.networks: dict[str, Fst] = {}
        self.guards: list[tuple[str, Fst]] = []
        self.options = dict(DEFAULTS)
        self.neighbours = neighbours
        self.recursive: set[str] = set()
        self.busy: list[str] = []

    # scripts

    def script(self, text: str) -> None:
        text = re.sub(r"@include\s*\"([^\"]+)\"", lambda m: self.reader("include", m[1]) if self.reader else "", text)
        p = Parser(text, lambda name: name in FUNCTIONS or name in self.functions)
        while not p.done():
            word = p.peek()
            if p.op(";"):
                p.take()
                continue
            if word.kind != "name":
                raise FormatError(f"a statement is expected at {word.at}")
            p.k += 1
            kind = word.text.lower()
            if kind in ("define", "defins", "deffun"):
                name = self._name(p)
                after = p.peek()
                if p.op("(") and after.at == p.peek(-1).at + len(p.peek(-1).text):
                    self._function(p, name, text)
                    continue
                self.nodes[name] = p.expression()
                if kind == "defins":
                    self.recursive.add(name)
                p.take(";")
            elif kind == "regex":
                self.nodes["TOP"] = p.expression()
                p.take(";")
            elif kind == "list":
                name = self._name(p)
                self.nodes[name] = p.expression()
                p.take(";")
            elif kind == "set":
                begin = p.peek().at
                m = re.compile(r"([A-Za-z-]+)[\s=]+([A-Za-z0-9]+)\s*;?").match(text, begin)
                if not m:
                    raise FormatError(f"set needs a name and a value at {begin}")
                self.options[m[1]] = m[2]
                while not p.done() and p.peek().at < m.end():
                    p.k += 1
            else:
                raise FormatError(f"unknown statement {word.text!r} at {word.at}")

    def _name(self, p: Parser) -> str:
        t = p.peek()
        if t is None or t.kind != "name":
            raise FormatError("a name is expected")
        p.k += 1
        return re.sub(r"%(.)", r"\1", t.text)

    def _function(self, p: Parser, name: str, text: str) -> None:
        p.take("(")
        parameters = []
        while not p.op(")"):
            parameters.append(self._name(p))
            if p.op(","):
                p.take()
        p.take(")")
        self.functions[name] = (parameters, "")
        self.bodies = getattr(self, "bodies", {})
        self.bodies[name] = p.expression()
        p.take(";")

    def network(self, name: str = "TOP") -> Fst:
        """A definition as a network; one that holds tags begins where it begins."""
        if name not in self.networks:
            if name not in self.nodes:
                raise FstError(f"no definition of {name}")
            if name in self.busy:
                raise FstError(f"{name} uses itself: call it with Ins({name})")
            self.busy.append(name)
            try:
                f = self.finish(self._delimited(self.of(self.nodes[name])))
            finally:
                self.busy.pop()
            self.networks[name] = f
        return self.networks[name]

    def _delimited(self, f: Fst) -> Fst:
        if not any(s.startswith(f"{MARKER}TAG:") or s.startswith(f"{MARKER}CAP:") for s in _open_marks(f)):
            return f
        return A.concat(symbol(f"{MARKER}ENTRY@"), f, symbol(f"{MARKER}EXIT@"))

    def all_networks(self) -> dict[str, Fst]:
        """TOP and all that it calls."""
        todo, out = ["TOP"], {}
        while todo:
            name = todo.pop()
            if name in out:
                continue
            out[name] = self.network(name)
            fs = [out[name], *(g for _, g in self.guards)]
            todo += [s[len(MARKER) + 4 : -1] for f in fs for s in f.alphabet if s.startswith(f"{MARKER}INS:")]
        return out

    # trees

    def _symbol(self, node: Node, local: dict) -> Fst:
        name = node.args[0]
        if name in local:
            return local[name].copy()
        if name in self.nodes:
            return self.network(name).copy()
        if name in CLASSES:
            return self._class(name)
        return super()._symbol(node, local)

    def _class(self, name: str) -> Fst:
        if self.options["unicode-character-classes"] == "on" and name not in ("Num", "Punct"):
            return symbol(f"{MARKER}CLS:{name}@")
        f = Fst([[], []], {1: 0.0})
        for c in map(chr, range(256)):
            if CLASSES[name](c):
                f.add_arc(0, 1, c, c)
        return f

    def _literal(self, node: Node, local: dict) -> Fst:
        text = node.args[0]
        if len(text) == 3 and text[1] == "-" and text[0] <= text[2]:
            return A.union(*(symbol(chr(c)) for c in range(ord(text[0]), ord(text[2]) + 1)))
        return symbol(text)

    def _boundary(self, node: Node, local: dict) -> Fst:
        return symbol(f"{MARKER}EDGE@")

    def _concat(self, node: Node, local: dict) -> Fst:
        """A left context is one of the beginning of what it stands in, wherever it is written."""

        def is_left(n: Node) -> bool:
            if n.kind in ("group", "|"):
                return all(is_left(x) for x in n.args)
            return n.kind == "call" and (n.args[0] in ("LC", "NLC") or (n.args[0] in ("OR", "AND") and all(map(is_left, n.args[1]))))

        lefts = [n for n in node.args if is_left(n)]
        return A.concat(*(self.of(n, local) for n in [*lefts, *(n for n in node.args if n not in lefts)]))

    def _tagged(self, node: Node, local: dict) -> Fst:
        return A.concat(symbol(f"{MARKER}ENTRY@"), self.of(node.args[0], local), symbol(f"{MARKER}TAG:{node.args[1]}@"), symbol(f"{MARKER}EXIT@"))

    def defined(self, name: str, local: dict) -> bool:
        return name in self.nodes or name in CLASSES or super().defined(name, local)

    def _text(self, node: Node) -> str:
        while node.kind == "group":
            node = node.args[0]
        if node.kind in ("symbol", "literal", "string"):
            return node.args[0]
        raise FormatError(f"a name is expected, not {node}")

    def _guard(self, kind: str, f: Fst) -> Fst:
        self.guards.append((kind, self.finish(A.reverse(f) if kind in ("LC", "NLC") else f)))
        return symbol(f"{MARKER}IF:{len(self.guards) - 1}@")

    def _call(self, node: Node, local: dict) -> Fst:
        name, args = node.args
        if name in self.functions:
            parameters, _ = self.functions[name]
            if len(parameters) != len(args):
                raise FstError(f"{name} has {len(parameters)} parameters")
            return self.of(self.bodies[name], {p: self.finish(self.of(a, local)) for p, a in zip(parameters, args, strict=True)})
        if name in ("EndTag", "Counter", "Capture", "Captured", "Ins"):
            text = self._text(args[0])
            if name == "Ins":
                if self.options["flatten"] == "on" and text not in self.busy:
                    return self.network(text).copy()
                return symbol(f"{MARKER}INS:{text}@")
            return symbol(f"{MARKER}{ {'EndTag': 'TAG', 'Counter': 'COUNT', 'Capture': 'CAP', 'Captured': 'SAME'}[name]}:{text}@")
        if name in ("LC", "RC", "NLC", "NRC"):
            return self._guard(name, self.finish(self.of(args[0], local)))
        if name == "Define":
            return self._delimited(self.of(args[0], local))
        if name == "Lit":
            return from_string(self._text(args[0]))
        if name in ("Like", "Unlike"):
            words = [self._text(a) for a in args if not self._number(a)]
            n = next((int(self._text(a)) for a in args if self._number(a)), 10)
            if self.neighbours is None:
                raise UnsupportedError(f"{name} needs word vectors")
            return A.union(*(from_string(w) for w in self.neighbours(words, n, name == "Like")))
        fs = [self.finish(self.of(a, local)) for a in args]
        if name == "OR":
            return A.union(*fs)
        if name == "AND":
            return A.concat(*fs)
        if name in ("Lst", "Exc", "Sigma"):
            symbols = sorted(s for s in fs[0].symbols_used() if not s.startswith(MARKER))
            if name == "Exc":
                f = any_symbol()
                f.alphabet |= set(symbols)
                return f
            return A.union(*(symbol(s) for s in symbols))
        if name == "Interpolate":
            out = [fs[1]]
            for f in fs[2:]:
                out += [fs[0], f]
            return A.concat(*out)
        if name == "Explode":
            return A.concat(*(from_string(s) for s in _one_string(fs[0])))
        if name == "Implode":
            return symbol("".join(_one_string(fs[0])))
        if name == "Uncompose":
            return A.compose(A.compose(fs[0], fs[1]), fs[2]) if len(fs) > 2 else A.compose(fs[0], fs[1])
        return casing(fs[0], name, self._text(args[1]) if len(args) > 1 else "")

    def _number(self, node: Node) -> bool:
        return node.kind in ("symbol", "literal") and node.args[0].isdigit()

    def _operator(self, node: Node, local: dict) -> Fst:
        self.inside_ignoring = True
        return super()._operator(node, local)


def _open_marks(f: Fst) -> set[str]:
    """Markers that stand outside of inner delimited stretches."""
    seen, todo, out = {(0, 0)}, [(0, 0)], set()
    while todo:
        s, depth = todo.pop()
        for i, _, _, d in f.arcs[s]:
            if depth == 0 and i.startswith(MARKER):
                out.add(i)
            deeper = depth + (i == f"{MARKER}ENTRY@") - (i == f"{MARKER}EXIT@")
            if 0 <= deeper < 50 and (d, deeper) not in seen:
                seen.add((d, deeper))
                todo.append((d, deeper))
    return out


def _one_string(f: Fst) -> list[str]:
    from tapeworks.plans.paths import paths

    return [i for i, _ in paths(f, 1)[0][1] if i != EPSILON]


def casing(f: Fst, kind: str, side: str = "") -> Fst:
    """Case variants: ``Opt`` keeps the form as it is too; side U or L gives a pair of which only that side has the new case."""
    opt = kind.startswith("Opt")
    kind = kind.removeprefix("Opt")
    change = {"Cap": str.upper, "UpCase": str.upper, "ToUpper": str.upper, "DownCase": str.lower, "ToLower": str.lower, "AnyCase": None}[kind]

    def turned(s: str, function) -> str:
        t = function(s) if len(s) == 1 else s
        return t if len(t) == 1 else s

    def arcs(row, function):
        new = []
        for i, o, w, d in row:
            if i in SPECIAL or i.startswith(MARKER) or is_flag(i):
                new.append((i, o, w, d))
                continue
            p, q = (turned(i, function) if side != "L" else i), (turned(o, function) if side != "U" and o not in SPECIAL else o)
            new.append((p, q, w, d))
        return new

    f = A.remove_epsilons(f)
    if kind == "AnyCase":
        out = f.like([[a for fn in (str.upper, str.lower) for a in arcs(row, fn)] for row in f.arcs], dict(f.finals))
        out = f.like([sorted(set(r)) for r in out.arcs], dict(f.finals))
    elif kind == "Cap":
        out = f.like([list(r) for r in f.arcs] + [[]], dict(f.finals))
        top = len(out.arcs) - 1
        out.arcs[top] = arcs(f.arcs[0], change)
        if 0 in f.finals:
            out.finals[top] = f.finals[0]
        swap = {0: top, top: 0}
        out = f.like([[(i, o, w, swap.get(d, d)) for i, o, w, d in out.arcs[swap.get(s, s)]] for s in range(len(out.arcs))], {swap.get(s, s): w for s, w in out.finals.items()})
    else:
        out = f.like([arcs(r, change) for r in f.arcs], dict(f.finals))
    out.alphabet = f.alphabet | out.symbols_used()
    return A.union(f, out) if opt else out


@dataclass
class Matcher:
    """The compiled form of a script: plain tables that go to workers once."""

    networks: dict[str, list]
    guards: list[tuple[str, list]]
    options: dict[str, str]
    counts: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def of(compiler: PatternCompiler) -> Matcher:
        networks = {name: _table(f) for name, f in compiler.all_networks().items()}
        return Matcher(networks, [(kind, _table(f)) for kind, f in compiler.guards], dict(compiler.options))

    def on(self, name: str) -> bool:
        return self.options.get(name, "off") == "on"

    # one network from one place

    def ends(self, table: list, text: str, at: int, step: int = 1) -> list[tuple[int, float, tuple]]:
        """(end, weight, output) of all ways from a place; output symbols, with beginnings, ends and tags between.

        Calls and conditions are searches of their own. They wait for one another on a stack here, not on Python's, so that they nest as deep as max-recursion says; what a call finds at
        a place is found once.
        """
        found: dict[tuple, list] = {}
        asked = [(table, at, step, 0)]
        running = [self._ways(table, text, at, step, 0)]
        answer = None
        while True:
            try:
                ask = running[-1].send(answer)
            except StopIteration as done:
                running.pop()
                inner, *rest = asked.pop()
                if not running:
                    return done.value
                found[id(inner), *rest] = answer = done.value
                continue
            answer = found.get((id(ask[0]), *ask[1:]))
            if answer is None:
                asked.append(ask)
                running.append(self._ways(ask[0], text, *ask[1:]))

    def _ways(self, table: list, text: str, at: int, step: int, depth: int):
        """ends() as a coroutine: it yields (table, place, step, depth) for each search that it needs and is sent what that finds.

        Places are taken in the order of reading; a call or a captured text puts its ways at the place where it ends. A state comes once only on a way that reads nothing.
        """
        arcs, silent, finals, known = table
        limit, loops = int(self.options["max-recursion"]), self._loops(table)
        found: dict[tuple, float] = {}
        places: dict[int, dict[tuple, float]] = {at: {(0, (), (), ()): 0.0}}
        while places:
            at = min(places) if step > 0 else max(places)
            closed = places.pop(at)
            todo = [(key, w, frozenset()) for key, w in closed.items()]
            while todo:
                (state, out, registers, caps), w, seen = todo.pop()
                if closed.get((state, out, registers, caps), w) < w:
                    continue
                if state in loops:
                    seen = seen | {(state, registers, caps)}
                for label, o, v, d in silent[state]:
                    kind, _, name = label[len(MARKER) : -1].partition(":") if label is not None and label.startswith(MARKER) else (None, None, None)
                    if kind == "INS":
                        inner = (yield self.networks[name], at, step, depth + 1) if depth < limit else ()
                        ways = [(e, given, registers, caps, more) for e, more, given in inner]
                    elif kind == "IF":
                        way, guard = self.guards[int(name)]
                        met = yield guard, at, -1 if way in ("LC", "NLC") else 1, depth + 1
                        ways = [(at, (), registers, caps, 0.0)] if bool(met) != way.startswith("N") else []
                    else:
                        ways = self._act(label, kind, name, o, text, at, out, registers, caps)
                    for to, extra, regs, cs, more in ways:
                        key, total = (d, out + extra, regs, cs), w + v + more
                        if to != at:
                            later = places.setdefault(to, {})
                            later[key] = min(total, later.get(key, float("inf")))
                        elif closed.get(key, float("inf")) > total and (d, regs, cs) not in seen:
                            closed[key] = total
                            todo.append((key, total, seen))
            for (state, out, _, _), w in closed.items():
                if state in finals:
                    total = w + finals[state]
                    found[at, out] = min(total, found.get((at, out), float("inf")))
            place = at if step > 0 else at - 1
            if not 0 <= place < len(text):
                continue
            c, layer = text[place], places.setdefault(at + step, {})
            for (state, out, registers, caps), w in closed.items():
                for o, v, d in arcs[state].get(c, []) if c in known else arcs[state].get(IDENTITY, []) + arcs[state].get(UNKNOWN, []):
                    o = c if o in (IDENTITY, UNKNOWN) else o
                    key = (d, out + _given(o, at + step), registers, caps)
                    layer[key] = min(w + v, layer.get(key, float("inf")))
                for label, o, v, d in silent[state]:
                    if label is not None and _reads(label, c):
                        key = (d, (*out, c), registers, caps)
                        layer[key] = min(w + v, layer.get(key, float("inf")))
            if not layer:
                del places[at + step]
        return [(e, w, o) for (e, o), w in found.items()]

    def _loops(self, table: list) -> set[int]:
        """The states that lie on cycles of silent arcs, or between such."""
        known = self.__dict__.setdefault("_cycles", {})
        if id(table) not in known:
            to = {s: {d for _, _, _, d in row} for s, row in enumerate(table[1]) if row}
            shrunk = True
            while shrunk:
                reached = set().union(*to.values())
                left = {s: {d for d in ds if d in to} for s, ds in to.items() if s in reached}
                left = {s: ds for s, ds in left.items() if ds}
                shrunk, to = left != to, left
            known[id(table)] = set(to)
        return known[id(table)]

    def _act(self, label, kind, name, o, text, at, out, registers, caps):
        """What an action without a search of its own does: (place, output, registers, captures, weight) for each way that it allows."""
        if label is None:
            return [(at, _given(o, at), registers, caps, 0.0)]
        if is_flag(label):
            got = A.apply_flag(label, dict(registers))
            return [] if got is None else [(at, (), tuple(sorted(got.items())), caps, 0.0)]
        if kind in ("ENTRY", "EXIT", "TAG", "COUNT"):
            return [(at, ((kind, name),), registers, caps, 0.0)]
        if kind == "EDGE":
            return [(at, (), registers, caps, 0.0)] if at in (0, len(text)) else []
        if kind == "CAP":
            return [(at, (("CAP", name),), registers, tuple(sorted((dict(caps) | {name: _capture_start(out)}).items())), 0.0)]
        if kind == "SAME":
            same = dict(caps).get(name)
            return [(at + len(same), tuple(same), registers, caps, 0.0)] if same is not None and text.startswith(same, at) else []
        return []

    # scanning

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_fast", "_cycles")}

    def fast(self) -> _Automaton | None:
        """The automaton of a plain pattern, built on first use in each process; None for others."""
        if "_fast" not in self.__dict__:
            self.__dict__["_fast"] = _Automaton.of(self.networks["TOP"])
        return self.__dict__["_fast"]

    def firsts(self) -> set[str] | None:
        """Characters that a match can begin with; None: any."""
        arcs, silent, _, known = self.networks["TOP"]
        seen, todo, out = {0}, [0], set()
        while todo:
            s = todo.pop()
            if IDENTITY in arcs[s] or UNKNOWN in arcs[s]:
                return None
            out |= set(arcs[s])
            for label, _, _, d in silent[s]:
                if label is not None and label[len(MARKER) :].startswith(("CLS", "NOT", "INS", "SAME")):
                    return None
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        return out

    def scan(self, text: str):
        """(start, end, [(weight, output)]) of the longest matches from left to right; gaps are not reported."""
        separators, firsts = self.on("need-separators"), self.firsts()
        at, n = 0, len(text)

        def apart(k: int) -> bool:
            return k in (0, n) or _separates(text[k - 1]) or _separates(text[k])

        top, fast = self.networks["TOP"], self.fast()
        while at < n:
            if (firsts is not None and text[at] not in firsts) or (separators and not apart(at)):
                at += 1
                continue
            if fast:
                end, ways = fast.longest(text, at, apart if separators else None)
                if end > at:
                    yield at, end, [(0.0, way) for way in sorted(ways, key=lambda x: _render(x, True))]
                at = max(end, at + 1)
                continue
            found = [x for x in self.ends(top, text, at) if x[0] > at and (not separators or apart(x[0]))]
            if not found:
                at += 1
                continue
            end = max(e for e, _, _ in found)
            yield at, end, sorted(((f32(w), o) for e, w, o in found if e == end), key=lambda x: (x[0], _render(x[1], True)))
            at = end

    def match(self, text: str) -> str:
        """The text with matches marked, deleted or alone, by the options."""
        out, last = [], 0
        for start, end, ways in self.scan(text):
            out.append("" if self.on("extract-patterns") else text[last:start])
            tagged = any(isinstance(x, tuple) and x[0] == "TAG" for x in ways[0][1])
            if self.on("count-patterns"):
                for x in ways[0][1]:
                    if isinstance(x, tuple) and x[0] == "TAG":
                        self.counts[x[1]] = self.counts.get(x[1], 0) + 1
            if not (self.on("delete-patterns") and tagged):
                out.append(_render(ways[0][1], self.on("mark-patterns")))
            last = end
        out.append("" if self.on("extract-patterns") else text[last:])
        return "".join(out)

    def locate(self, text: str, gaps: bool = True) -> list[list[Location]]:
        """For each stretch its locations: all of the longest match there, or one for what doesn't match."""
        out, last = [], 0

        def gap(a: int, b: int) -> None:
            if gaps and b > a:
                out.append([Location(a, b - a, text[a:b], NON_MATCHING, "", 0.0)])

        for start, end, ways in self.scan(text):
            gap(last, start)
            seen = {}
            for w, o in ways:
                tags = [x[1] for x in o if isinstance(x, tuple) and x[0] == "TAG"]
                symbols = tuple(x for x in o if isinstance(x, str))
                form = "".join(s for s in symbols if s != BACKTRACK)
                loc = Location(start, end - start, text[start:end], form, tags[-1] if tags else "", w, *_parts(o, start), symbols)
                seen.setdefault((loc.output, loc.tag, loc.weight), loc)
            out.append(sorted(seen.values(), key=lambda x: (x.weight, x.tag, x.output)))
            last = end
        gap(last, len(text))
        return out

    def tag_counts(self, text: str) -> dict[str, int]:
        found: dict[str, int] = {}
        for _, _, ways in self.scan(text):
            for x in ways[0][1]:
                if isinstance(x, tuple) and x[0] == "TAG":
                    found[x[1]] = found.get(x[1], 0) + 1
        return found

    def counters(self, text: str) -> dict[str, int]:
        """How often each profiling counter lies on a chosen way."""
        found: dict[str, int] = {}
        for _, _, ways in self.scan(text):
            for x in ways[0][1]:
                if isinstance(x, tuple) and x[0] == "COUNT":
                    found[x[1]] = found.get(x[1], 0) + 1
        return found


class _Automaton:
    """A deterministic automaton, built state by state as texts ask for it, of a pattern without weights, conditions, calls, captures, flags or changes of the text, whose tags stand before
    its first symbol or after its last. A state is a set of (network state, marks before)."""

    def __init__(self, table: list):
        self.arcs, self.silent, self.finals, self.known = table
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ways: list[list[tuple[tuple, tuple]]] = []
        self.start = self._number(frozenset(self._before()))

    @staticmethod
    def of(table: list) -> _Automaton | None:
        arcs, silent, finals, _ = table
        if any(w for w in finals.values()):
            return None
        consuming = [any(row.values()) for row in arcs]
        to: list[set[int]] = [set() for _ in arcs]
        for s in range(len(arcs)):
            for i, moves in arcs[s].items():
                for o, w, d in moves:
                    if w or o != i or i == UNKNOWN:
                        return None
                    to[s].add(d)
            for label, o, w, d in silent[s]:
                if w or o not in (EPSILON, label):
                    return None
                kind = None if label is None else "" if is_flag(label) else label[len(MARKER) : -1].partition(":")[0]
                if kind not in (None, "ENTRY", "EXIT", "TAG", "COUNT", "CLS", "NOT"):
                    return None
                consuming[s] |= kind in ("CLS", "NOT")
                to[s].add(d)

        def reach(begin: set[int]) -> set[int]:
            seen, todo = set(begin), list(begin)
            while todo:
                for d in to[todo.pop()] - seen:
                    seen.add(d)
                    todo.append(d)
            return seen

        read = {d for s in range(len(arcs)) for moves in arcs[s].values() for *_, d in moves} | {d for row in silent for label, _, _, d in row if label is not None and label[len(MARKER) :].startswith(("CLS", "NOT"))}
        inside = reach(read)
        for s in inside:
            for label, _, _, d in silent[s]:
                if label is not None and not label[len(MARKER) :].startswith(("CLS", "NOT")) and any(consuming[x] for x in reach({d})):
                    return None
        return _Automaton(table)

    def _mark(self, label: str | None) -> tuple:
        if label is None:
            return ()
        kind, _, name = label[len(MARKER) : -1].partition(":")
        return ((kind, name),)

    def _before(self) -> set:
        seen, todo = {(0, ())}, [(0, ())]
        while todo:
            s, marks = todo.pop()
            for label, _, _, d in self.silent[s]:
                if label is None or not label[len(MARKER) :].startswith(("CLS", "NOT")):
                    x = (d, marks + self._mark(label))
                    if x not in seen and len(x[1]) < 50:
                        seen.add(x)
                        todo.append(x)
        return seen

    def _number(self, states: frozenset) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            ways = set()
            for s, marks in states:
                todo, seen = [(s, ())], {(s, ())}
                while todo:
                    x, after = todo.pop()
                    if x in self.finals:
                        ways.add((marks, after))
                    for label, _, _, d in self.silent[x]:
                        if label is None or not label[len(MARKER) :].startswith(("CLS", "NOT")):
                            y = (d, after + self._mark(label))
                            if y not in seen and len(y[1]) < 50:
                                seen.add(y)
                                todo.append(y)
            self.ways.append(sorted(ways))
        return self.numbers[states]

    def _move(self, state: int, c: str) -> int:
        """The state after a character; -1: none."""
        out = set()
        for s, marks in self.sets[state]:
            moves = self.arcs[s].get(c, []) if c in self.known else self.arcs[s].get(IDENTITY, [])
            todo = [d for *_, d in moves] + [d for label, _, _, d in self.silent[s] if label is not None and _reads(label, c)]
            while todo:
                d = todo.pop()
                if (d, marks) not in out:
                    out.add((d, marks))
                    todo += [x for label, _, _, x in self.silent[d] if label is None]
        found = self._number(frozenset(out)) if out else -1
        if len(self.moves[state]) < 100_000:
            self.moves[state][c] = found
        return found

    def longest(self, text: str, at: int, good=None) -> tuple[int, list[tuple]]:
        """(end, outputs) of the longest match that ends at a good place; the end is at where there is none."""
        state, end, best = self.start, at, -1
        for k in range(at, len(text)):
            c = text[k]
            follow = self.moves[state].get(c)
            state = self._move(state, c) if follow is None else follow
            if state < 0:
                break
            if self.ways[state] and (good is None or good(k + 1)):
                end, best = k + 1, state
        if best < 0:
            return at, []
        letters = tuple(text[at:end])
        return end, [before + letters + after for before, after in self.ways[best]]


def _separates(c: str) -> bool:
    return CLASSES["Whitespace"](c) or CLASSES["Punct"](c)


def _capture_start(out: tuple) -> str:
    """The text since the innermost beginning that is still open."""
    depth, text = 0, []
    for x in reversed(out):
        if isinstance(x, tuple):
            if x[0] == "EXIT":
                depth += 1
            elif x[0] == "ENTRY":
                if depth == 0:
                    break
                depth -= 1
        else:
            text.append(x)
    return "".join(reversed(text))


def _reads(label: str, c: str) -> bool:
    """Whether a class arc reads a character."""
    kind, _, name = label[len(MARKER) : -1].partition(":")
    return CLASSES[name](c) if kind == "CLS" else c not in name if kind == "NOT" else False


def _given(o: str, at: int) -> tuple:
    """What an arc gives: nothing, a mark of the place in the input, or a symbol."""
    return () if o == EPSILON else (("PART", at),) if o == INPUT_MARK else (o,)


def _parts(out: tuple, start: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Where the parts that marks begin are: in the form, and in the output's symbols."""
    inputs, outputs, n = [], [], 0
    for x in out:
        if isinstance(x, str):
            n += 1
        elif x[0] == "PART":
            inputs.append(x[1] - start)
            outputs.append(n)
    return tuple(inputs), tuple(outputs)


def _render(out: tuple, mark: bool) -> str:
    """The output, with tags around what they delimit."""
    stack: list[list] = [[]]
    for x in out:
        if isinstance(x, str):
            stack[-1].append(x if x != BACKTRACK else "")
        elif x[0] == "ENTRY":
            stack.append([])
        elif x[0] == "TAG" and len(stack) > 1:
            text = "".join(stack[-1])
            stack[-1] = [f"<{x[1]}>{text}</{x[1]}>" if mark else text]
        elif x[0] == "EXIT" and len(stack) > 1:
            text = "".join(stack.pop())
            stack[-1].append(text)
    return "".join("".join(s) for s in stack)


def _table(f: Fst) -> list:
    arcs, silent = [], []
    for row in f.arcs:
        table: dict[str, list] = {}
        quiet = []
        for i, o, w, d in row:
            if i == EPSILON:
                quiet.append((None, o, w, d))
            elif i.startswith(MARKER) or is_flag(i):
                quiet.append((i, o, w, d))
            else:
                table.setdefault(i, []).append((o, w, d))
        arcs.append(table)
        silent.append(quiet)
    return [arcs, silent, dict(f.finals), frozenset(s for s in f.alphabet if len(s) == 1)]


# The action symbols of stored networks.
_ACTIONS = {
    "@PMATCH_ENTRY@": "ENTRY", "@PMATCH_EXIT@": "EXIT", "@BOUNDARY@": "EDGE", "@UNICODE_ALPHA@": "CLS:Alpha", "@UNICODE_UPPERALPHA@": "CLS:UppercaseAlpha", "@UNICODE_LOWERALPHA@": "CLS:LowercaseAlpha",
    "@UNICODE_WHITESPACE@": "CLS:Whitespace",
}
_PREFIXES = {"@PMATCH_ENDTAG_": "TAG", "@PMATCH_CAPTURED_": "SAME", "@PMATCH_CAPTURE_": "CAP", "@PMATCH_COUNTER_": "COUNT", "@I.": "INS"}
_SILENT = ("@PMATCH_PASSTHROUGH@", "@PMATCH_GUARD_")


def _action(s: str) -> str:
    if s in _ACTIONS:
        return f"{MARKER}{_ACTIONS[s]}@"
    for prefix, kind in _PREFIXES.items():
        if s.startswith(prefix):
            return f"{MARKER}{kind}:{s[len(prefix) : -1]}@"
    return EPSILON if s.startswith(_SILENT) else s


def _contexts_out(f: Fst, guards: list[tuple[str, Fst]]) -> Fst:
    """Contexts that stand in a network between their entry and exit symbols become conditions; left ones are stored as they are read, backwards."""
    out = f.copy()
    for kind in ("NLC", "NRC", "LC", "RC"):
        enter, leave = f"@PMATCH_{kind}_ENTRY@", f"@PMATCH_{kind}_EXIT@"
        for s, row in enumerate(out.arcs):
            for arc in [a for a in row if a[0] == enter]:
                row.remove(arc)
                seen, todo, ends = {arc[3]}, [arc[3]], {}
                while todo:
                    x = todo.pop()
                    for i, _, _, d in out.arcs[x]:
                        if i == leave:
                            ends.setdefault(d, set()).add(x)
                        elif d not in seen:
                            seen.add(d)
                            todo.append(d)
                for d, sources in sorted(ends.items()):
                    number = {x: k for k, x in enumerate([arc[3], *sorted(seen - {arc[3]})])}
                    inner = out.like([[(i, o, w, number[t]) for i, o, w, t in out.arcs[x] if i != leave and t in number] for x in number], {number[x]: 0.0 for x in sources})
                    guards.append((kind, A.trim(inner)))
                    label = f"{MARKER}IF:{len(guards) - 1}@"
                    out.arcs[s].append((label, label, arc[2], d))
                    out.alphabet.add(label)
    return out


def from_networks(networks: list[Fst], **options: str) -> Matcher:
    """The matcher of stored networks, of which one is called TOP; the options come from its properties."""
    by_name = {f.name: f for f in networks}
    if "TOP" not in by_name:
        raise FormatError("no network is called TOP")
    guards: list[tuple[str, Fst]] = []
    tables = {}
    for name, f in by_name.items():
        f = _contexts_out(f, guards)
        arcs = []
        for row in f.arcs:
            new = []
            for i, o, w, d in row:
                if i.startswith("@L.") or i.startswith("@X."):
                    members = [m for m in i[3:-1].split("_") if m]
                    new += [(m, m if o == i else o, w, d) for m in members] if i.startswith("@L.") else [(f"{MARKER}NOT:{''.join(members)}@", EPSILON, w, d)]
                else:
                    i, o = _action(i), _action(o)
                    # an action on one side only is one all the same
                    new.append((o, EPSILON, w, d) if i == EPSILON and o.startswith(MARKER) else (i, o, w, d))
            arcs.append(new)
        g = f.like(arcs, dict(f.finals), {s for row in arcs for a in row for s in a[:2]} | f.alphabet)
        tables[name] = _table(g)
    props = DEFAULTS | {k: v for k, v in by_name["TOP"].props.items() if k in DEFAULTS} | {k.replace("_", "-"): v for k, v in options.items()}
    wrapped = []
    for kind, g in guards:
        arcs = [[(_action(i), _action(o), w, d) for i, o, w, d in row] for row in g.arcs]
        wrapped.append((kind, _table(g.like(arcs, dict(g.finals)))))
    return Matcher(tables, wrapped, props)


def compile_script(script: str, reader=None, neighbours=None, **options: str) -> Matcher:
    c = PatternCompiler(reader, neighbours)
    c.script(script)
    c.options |= {k.replace("_", "-"): v for k, v in options.items()}
    if c.options["need-separators"] not in ("on", "off"):
        raise FstError("need-separators is on or off")
    return Matcher.of(c)


__all__ = ["Location", "Matcher", "PatternCompiler", "casing", "compile_script", "universal", "epsilon"]
