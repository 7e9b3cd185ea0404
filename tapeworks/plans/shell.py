"""The command shell: a stack of transducers, definitions and variables, driven by one command a line."""

from __future__ import annotations

import re
from collections.abc import Callable

from tapeworks.plans import algebra as A
from tapeworks.plans import lexc
from tapeworks.plans import lookup as L
from tapeworks.plans import paths as P
from tapeworks.plans.fst import EPSILON, IDENTITY, UNKNOWN, FstError, Fst, FormatError, UnsupportedError, is_flag
from tapeworks.plans.xre import Compiler
from tapeworks.sources import formats

# The commands' other spellings.
ALIASES = {
    "up": "apply up", "down": "apply down", "clear stack": "clear", "lookup-optimise": "lookup-optimize", "remove-optimisation": "remove-optimization", "determinise net": "determinize net",
    "determinise": "determinize net", "determinize": "determinize net", "epsilon-remove": "epsilon-remove net", "conjunct": "intersect net", "intersect": "intersect net", "disjunct": "union net",
    "union": "union net", "subtract": "minus net", "minus": "minus net", "minimise": "minimize net", "minimize": "minimize net", "complete": "complete net", "compose": "compose net",
    "concatenate": "concatenate net", "crossproduct": "crossproduct net", "ignore": "ignore net", "invert": "invert net", "lower-side": "lower-side net", "upper-side": "upper-side net",
    "name": "name net", "negate": "negate net", "one-plus": "one-plus net", "zero-plus": "zero-plus net", "pop stack": "pop", "prune": "prune net", "push defined": "push", "regex": "read regex",
    "reverse": "reverse net", "rotate stack": "rotate", "shuffle": "shuffle net", "turn stack": "turn", "words": "print words", "upper-words": "print upper-words", "lower-words": "print lower-words",
    "random-words": "print random-words", "random-upper": "print random-upper", "random-lower": "print random-lower", "size": "print size", "sigma": "print sigma", "stack": "print stack", "flags": "print flags",
    "labels": "print labels", "label-maps": "print label-maps", "label-tally": "print label-tally", "arc-tally": "print arc-tally", "sigma-tally": "print sigma-tally", "sitally": "print sigma-tally",
    "longest-string": "print longest-string", "pls": "print longest-string", "longest-string-size": "print longest-string-size", "plz": "print longest-string-size", "shortest-string": "print shortest-string",
    "pss": "print shortest-string", "shortest-string-size": "print shortest-string-size", "psz": "print shortest-string-size", "aliases": "print aliases", "pdefined": "print defined", "directory": "print directory",
    "file-info": "print file-info", "pname": "print name", "equivalent": "test equivalent", "te": "test equivalent", "identity": "test identity", "ti": "test identity", "tia": "test infinitely-ambiguous",
    "infinitely ambiguous": "test infinitely-ambiguous", "infinitely-ambiguous": "test infinitely-ambiguous", "test infinitely ambiguous": "test infinitely-ambiguous", "lower-bounded": "test lower-bounded",
    "tlb": "test lower-bounded", "lower-universal": "test lower-universal", "tlu": "test lower-universal", "tnn": "test non-null", "tnu": "test null", "overlap": "test overlap", "to": "test overlap",
    "sublanguage": "test sublanguage", "ts": "test sublanguage", "upper-bounded": "test upper-bounded", "tub": "test upper-bounded", "upper-universal": "test upper-universal", "tuu": "test upper-universal",
    "tfd": "twosided flag-diacritics", "lexc": "read lexc", "att": "write att", "rpl": "read prolog", "rt": "read text", "rs": "read spaced-text", "wpl": "write prolog", "wt": "write text",
    "wspaced-text": "write spaced-text", "dot": "write dot", "wdot": "write dot", "wdef": "write definition", "wdefs": "write definitions", "saved": "write definitions", "save defined": "write definitions",
    "ss": "save stack", "save": "save stack", "load": "load stack", "loadd": "load defined", "show": "show variable", "rprops": "read properties", "add": "add properties", "compact": "compact sigma",
    "com-rep upper": "compile-replace upper", "com-rep lower": "compile-replace lower",
}
NOT_AVAILABLE = {
    "apply med", "med", "ambiguous upper", "ambiguous", "cleanup net", "cleanup", "collect epsilon-loops", "epsilon-loops", "edit properties", "edit", "extract ambiguous", "extract unambiguous",
    "sort net", "sort", "substring net", "substring", "test functional", "functional", "tf", "test unambiguous", "tu",
}
STOP_WORDS = {"quit", "exit", "bye", "stop", "au revoir", "auf wiedersehen", "hyvästi"}
VARIABLES = {
    "minimal": "ON", "obey-flags": "ON", "show-flags": "OFF", "print-pairs": "OFF", "print-space": "OFF", "quit-on-fail": "OFF", "random-seed": "0", "verbose": "OFF", "max-words": "0", "encode-weights": "OFF",
    "lookup-cycle-cutoff": "5", "print-words-cycle-cutoff": "5", "precision": "5", "name-nets": "OFF", "flag-is-epsilon": "OFF", "sort-arcs": "MAYBE", "recursive-define": "OFF", "retokenize": "ON", "quote-special": "OFF",
}


class Shell:
    """``files`` reads and writes by name; what commands print is returned, line by line, and kept in ``printed``."""

    def __init__(self, files: dict[str, str | bytes] | None = None):
        self.stack: list[Fst] = []
        self.c = Compiler()
        self.variables = dict(VARIABLES)
        self.aliases: dict[str, str] = {}
        self.files = files if files is not None else {}
        self.printed: list[str] = []
        self.optimized: set[int] = set()
        self.done = False
        self.definitions: dict[str, str] = {}

    # running

    def run(self, script: str) -> str:
        """All commands of a script; applications end with END;, as do inputs of several lines."""
        begin = len(self.printed)
        lines = script.splitlines()
        k = 0
        while k < len(lines) and not self.done:
            line = re.sub(r"(?<!%)![^\"]*$", "", lines[k]).strip() if not lines[k].lstrip().startswith("echo") else lines[k].strip()
            k += 1
            if not line:
                continue
            word = self._command(line)[0]
            if word in ("read regex", "define", "list") and ";" not in line:
                while k < len(lines) and ";" not in line:
                    line += "\n" + lines[k]
                    k += 1
            if word in ("apply up", "apply down", "read text", "read spaced-text", "read lexc", "read att", "read prolog") and not self._command(line)[1] and k < len(lines):
                body = []
                while k < len(lines) and lines[k].strip() not in ("END;", "<ctrl-d>"):
                    body.append(lines[k])
                    k += 1
                k += 1
                self._do(word, "\n".join(body), True)
                continue
            self.execute(line)
        return "\n".join(self.printed[begin:])

    def execute(self, line: str) -> None:
        for alias, to in self.aliases.items():
            if line.rstrip(";").strip() == alias:
                self.run(to)
                return
        word, rest = self._command(line)
        self._do(word, rest, False)

    def _command(self, line: str) -> tuple[str, str]:
        line = line.strip()
        words = line.rstrip(";").split() if not line.startswith(("define", "regex", "read regex")) else line.split()
        for n in (3, 2, 1):
            head = " ".join(words[:n]).lower()
            head = ALIASES.get(head, head)
            if head in NOT_AVAILABLE or head in STOP_WORDS or hasattr(self, "do_" + re.sub(r"[ -]", "_", head)):
                rest = line.split(None, len(" ".join(words[:n]).split()))
                return head, rest[len(" ".join(words[:n]).split())] if len(rest) > len(" ".join(words[:n]).split()) else ""
        raise FormatError(f"unknown command {line[:60]!r}")

    def _do(self, word: str, rest: str, many: bool) -> None:
        if word in NOT_AVAILABLE:
            raise UnsupportedError(f"{word} isn't available")
        if word in STOP_WORDS:
            self.done = True
            return
        getattr(self, "do_" + re.sub(r"[ -]", "_", word))(rest.strip() if not many else rest)

    def say(self, text: str) -> None:
        self.printed.append(text)

    # the stack

    def top(self) -> Fst:
        if not self.stack:
            raise FstError("the stack is empty")
        return self.stack[-1]

    def push(self, f: Fst) -> None:
        self.stack.append(f)

    def _minimal(self, f: Fst) -> Fst:
        return self.c.finish(f) if self.variables["minimal"] == "ON" else A.remove_epsilons(f)

    def _one(self, function: Callable[[Fst], Fst]) -> None:
        self.top()
        self.push(self._minimal(function(self.stack.pop())))

    def _two(self, function: Callable[[Fst, Fst], Fst]) -> None:
        if len(self.stack) < 2:
            raise FstError("two nets are needed")
        a = self.stack.pop()
        b = self.stack.pop()
        self.push(self._minimal(function(a, b)))

    def _all(self, function: Callable[[Fst, Fst], Fst]) -> None:
        self.top()
        out = self.stack.pop()
        while self.stack:
            out = function(out, self.stack.pop())
        self.push(self._minimal(out))

    def do_clear(self, rest): self.stack.clear()
    def do_pop(self, rest): self.top(); self.stack.pop()
    def do_rotate(self, rest): self.stack[:] = self.stack[-1:] + self.stack[:-1]
    def do_turn(self, rest): self.stack.reverse()

    def do_push(self, rest):
        for n in rest.rstrip(";").split() or sorted(self.c.names):
            if n not in self.c.names:
                raise FstError(f"no definition of {n}")
            self.push(self.c.names[n].copy())

    # operations

    def do_compose_net(self, rest): self._all(lambda a, b: A.compose(a, b, self.variables["flag-is-epsilon"] == "ON"))
    def do_concatenate_net(self, rest): self._all(A.concat)
    def do_union_net(self, rest): self._all(A.union)
    def do_intersect_net(self, rest): self._all(A.intersect)
    def do_minus_net(self, rest): self._two(A.subtract)
    def do_crossproduct_net(self, rest): self._two(A.cross_product)
    def do_ignore_net(self, rest): self._two(A.insert_freely)
    def do_shuffle_net(self, rest): self._all(A.shuffle)
    def do_complete_net(self, rest): self.top(); self.push(A.complete(A.determinize(self.stack.pop())))
    def do_determinize_net(self, rest): self.top(); self.push(A.determinize(self.stack.pop()))
    def do_minimize_net(self, rest): self.top(); self.push(A.minimize(self.stack.pop()))
    def do_epsilon_remove_net(self, rest): self.top(); self.push(A.remove_epsilons(self.stack.pop()))
    def do_invert_net(self, rest): self._one(A.invert)
    def do_reverse_net(self, rest): self._one(A.reverse)
    def do_lower_side_net(self, rest): self._one(lambda f: A.project(f, "output"))
    def do_upper_side_net(self, rest): self._one(lambda f: A.project(f, "input"))
    def do_negate_net(self, rest): self._one(A.negate)
    def do_one_plus_net(self, rest): self._one(A.plus)
    def do_zero_plus_net(self, rest): self._one(A.star)
    def do_prune_net(self, rest): self._one(A.prune)
    def do_twosided_flag_diacritics(self, rest): self.top(); self.push(A.twosided_flags(self.stack.pop()))
    def do_eliminate_flags(self, rest): self._one(A.eliminate_flags)
    def do_eliminate_flag(self, rest): self._one(lambda f: A.eliminate_flags(f, [rest.rstrip(";").strip()]))
    def do_lookup_optimize(self, rest): self.optimized.add(id(self.top()))
    def do_remove_optimization(self, rest): self.optimized.discard(id(self.top()))
    def do_compact_sigma(self, rest): self._one(A.prune_alphabet)

    def do_label_net(self, rest):
        labels = sorted({(i, o) for _, i, o, _, _ in self.top()})
        f = Fst([[(i, o, 0.0, 1) for i, o in labels], []], {1: 0.0}, set(self.top().alphabet))
        self.stack[-1] = f

    def do_sigma_net(self, rest):
        self.stack[-1] = A.union(*(Fst([[(s, s, 0.0, 1)], []], {1: 0.0}, {s}) for s in sorted(self.top().alphabet)))

    def do_name_net(self, rest): self.top().name = rest.rstrip(";").strip()

    def _compile_replace(self, side: int) -> None:
        """Paths hold expressions between ^[ and ^] on a side; each is compiled and put in their place."""
        f = self.top()
        out = []
        for w, p in P.paths(f, None, None):
            parts, k = [], 0
            while k < len(p):
                if p[k][side] == "^[":
                    end = next((j for j in range(k, len(p)) if p[j][side] == "^]"), None)
                    if end is None:
                        raise FormatError("an expression in the net isn't closed")
                    inner = "".join(x[side] for x in p[k + 1 : end] if x[side] != EPSILON)
                    compiled = self.c.compile(inner)
                    other = [x[1 - side] for x in p[k : end + 1] if x[1 - side] not in (EPSILON, "^[", "^]")]
                    literal = A.concat(*(Fst([[(s, s, 0.0, 1)], []], {1: 0.0}, {s}) for s in other)) if other else Fst([[]], {0: 0.0})
                    same = all(x[0] == x[1] for x in p[k : end + 1])
                    parts.append(compiled if same else A.cross_product(literal, compiled) if side == 1 else A.cross_product(compiled, literal))
                    k = end + 1
                else:
                    from tapeworks.plans.fst import from_pairs

                    parts.append(from_pairs([p[k]]))
                    k += 1
            out.append(A.set_final_weights(A.concat(*parts), w, increment=True) if parts else Fst([[]], {0: w}))
        self.stack[-1] = self._minimal(A.union(*out))

    def do_compile_replace_upper(self, rest): self._compile_replace(0)
    def do_compile_replace_lower(self, rest): self._compile_replace(1)

    # definitions

    def do_read_regex(self, rest):
        for part in [p for p in re.split(r";\s*(?:\n|$)", rest) if p.strip()]:
            self.push(self.c.compile(part))

    def do_define(self, rest):
        m = re.match(r"([^\s(]+)\(([^)]*)\)\s+(.*?);?\s*$", rest, re.S)
        if m:
            self.c.define_function(m[1], [p.strip() for p in m[2].split(",")], m[3])
            return
        name, _, body = rest.strip().partition(" ")
        body = body.strip().rstrip(";").strip()
        self.definitions[name] = body
        self.c.define(name, body if body else self.stack.pop())

    def do_undefine(self, rest):
        for n in rest.rstrip(";").split():
            self.c.undefine(n)

    def do_list(self, rest):
        name, _, symbols = rest.strip().rstrip(";").partition(" ")
        self.c.define_list(name, symbols)

    def do_unlist(self, rest): self.c.lists.pop(rest.rstrip(";").strip(), None)

    def do_alias(self, rest):
        name, _, body = rest.strip().partition(" ")
        self.aliases[name] = body.rstrip(";")

    def do_substitute_defined(self, rest):
        m = re.match(r"(\S+)\s+for\s+(\S+?);?$", rest.strip())
        if not m or m[1] not in self.c.names:
            raise FormatError("substitute defined NAME for SYMBOL")
        self._one(lambda f: A.substitute_fst(f, (m[2], m[2]), self.c.names[m[1]]))

    def do_substitute_symbol(self, rest):
        m = re.match(r"(.+?)\s+for\s+(\S+?);?$", rest.strip())
        if not m:
            raise FormatError("substitute symbol NEW for OLD")
        new = [EPSILON if s in ("NOTHING", "0") else s for s in m[1].split()]
        self._one(lambda f: A.substitute_by(f, lambda i, o: [((n if i == m[2] else i), (n if o == m[2] else o)) for n in new] if m[2] in (i, o) else None))
        self.top().alphabet.discard(m[2])

    def do_substitute_label(self, rest):
        m = re.match(r"(.+?)\s+for\s+(\S+?);?$", rest.strip())
        if not m:
            raise FormatError("substitute label NEW for OLD")
        label = lambda s: tuple(EPSILON if x == "0" else x for x in (s.split(":") if ":" in s else (s, s)))
        self._one(lambda f: A.substitute_pairs(f, {label(m[2]): [label(s) for s in m[1].split()]}))

    # variables and messages

    def do_set(self, rest):
        name, _, value = rest.rstrip(";").strip().partition(" ")
        if name not in self.variables:
            raise FstError(f"no variable {name}")
        self.variables[name] = value.strip().upper() if value.strip().lower() in ("on", "off") else value.strip()
        self.c.minimal = self.variables["minimal"] == "ON"

    def do_show_variable(self, rest):
        for n in [rest.rstrip(";").strip()] if rest.strip() else sorted(self.variables):
            self.say(f"variable {n} = {self.variables[n]}")

    do_show_variables = do_show_variable

    def do_echo(self, rest): self.say(rest)
    def do_help(self, rest): self.say("\n".join(sorted({n[3:].replace("_", " ") for n in dir(self) if n.startswith("do_") and rest.strip() in n.replace("_", " ")})))
    do_apropos = do_help
    def do_system(self, rest): raise UnsupportedError("other programs aren't run")
    def do_assert(self, rest):
        before = len(self.printed)
        self.execute(rest)
        if not any(x.startswith("1") for x in self.printed[before:]):
            raise FstError(f"assertion failed: {rest}")

    def do_add_properties(self, rest): self.top().props |= dict(p.split(":", 1) for p in rest.split() if ":" in p)
    def do_read_properties(self, rest): self.do_add_properties(str(self.files[rest.strip()]))

    # application

    def _apply(self, f: Fst, rest: str) -> None:
        c = L.compile_fst(f)
        for line in rest.splitlines():
            word = line.strip().rstrip(";") if "\n" not in rest else line.strip()
            cycles = int(self.variables["lookup-cycle-cutoff"])
            found = L.lookup(c, word, self.variables["obey-flags"] == "ON", cycles=cycles, show_flags=self.variables["show-flags"] == "ON")
            seen = dict.fromkeys((" " if self.variables["print-space"] == "ON" else "").join(s for s in o if s != EPSILON) for _, o in found)
            for s in seen or ["???"]:
                self.say(s)

    def do_apply_up(self, rest): self._apply(A.invert(self.top()), rest)
    def do_apply_down(self, rest): self._apply(self.top(), rest)

    # printing

    def _limit(self, rest: str) -> int | None:
        m = re.search(r"\d+", rest)
        return int(m[0]) if m else None

    def _show(self, pairs, side: int | None = None) -> str:
        sep = " " if self.variables["print-space"] == "ON" else ""
        ok = lambda s: s != EPSILON and (self.variables["show-flags"] == "ON" or not is_flag(s))
        if side is not None:
            return sep.join(x[side] for x in pairs if ok(x[side]))
        out = []
        for i, o in pairs:
            if not ok(i) and not ok(o):
                continue
            name = lambda s: {EPSILON: "0", IDENTITY: "?", UNKNOWN: "?"}.get(s, s)
            out.append(name(i) if i == o else f"<{name(i)}:{name(o)}>" if sep == "" else f"{name(i)}:{name(o)}")
        return sep.join(out)

    def _words(self, rest: str, side: int | None = None, f: Fst | None = None) -> None:
        f = f or self.top()
        n = self._limit(rest)
        cycles = None if not A.is_cyclic(f) else int(self.variables["print-words-cycle-cutoff"])
        found = P.paths(f, n, cycles, self.variables["obey-flags"] == "ON")
        for s in dict.fromkeys(self._show(p, side) for _, p in found):
            self.say(s)

    def do_print_words(self, rest): self._words(rest)
    def do_print_upper_words(self, rest): self._words(rest, 0)
    def do_print_lower_words(self, rest): self._words(rest, 1)

    def _random(self, rest, side=None):
        for _, p in P.random_paths(self.top(), self._limit(rest) or 15, int(self.variables["random-seed"]), self.variables["obey-flags"] == "ON"):
            self.say(self._show(p, side))

    def do_print_random_words(self, rest): self._random(rest)
    def do_print_random_upper(self, rest): self._random(rest, 0)
    def do_print_random_lower(self, rest): self._random(rest, 1)
    def do_print_longest_string(self, rest): self.say(self._show(P.longest_paths(self.top(), 1)[0][1]))
    def do_print_longest_string_size(self, rest): self.say(str(P.longest_length(self.top())))
    def do_print_shortest_string(self, rest): self.say(self._show(P.shortest_paths(self.top())[0][1]))
    def do_print_shortest_string_size(self, rest): self.say(str(P.shortest_length(self.top())))

    def do_print_size(self, rest):
        f = self.top()
        self.say(f"{f.n_states} states, {f.n_arcs} arcs, " + ("circular." if A.is_cyclic(f) else f"{sum(P.path_sizes(f).values())} paths"))

    def do_print_properties(self, rest): self.say("\n".join(f"{k}: {v}" for k, v in sorted(self.top().props.items())))
    def do_view_net(self, rest): self.say(formats.write_dot(self.top()).rstrip("\n"))

    def do_inspect_net(self, rest):
        """The arcs and states around state 0, or the one named."""
        f, s = self.top(), int(rest.strip().rstrip(";") or 0)
        self.say(f"State {s}{' (final)' if s in f.finals else ''}")
        for k, (i, o, _, d) in enumerate(f.arcs[s], 1):
            self.say(f"{k}. {self._show([(i, o)]) or '0'} -> {d}{' (final)' if d in f.finals else ''}")

    do_inspect = do_inspect_net

    def do_print_net(self, rest): self.say(formats.write_listing(self.top()).rstrip("\n"))
    def do_print_sigma(self, rest): self.say("Sigma: " + " ".join(sorted(s for s in self.top().alphabet if not is_flag(s))) + f"\nSize: {len(self.top().alphabet)}.")

    def _tally(self, items) -> None:
        count: dict[str, int] = {}
        for x in items:
            count[x] = count.get(x, 0) + 1
        for x, n in sorted(count.items(), key=lambda t: (-t[1], t[0])):
            self.say(f"{n:5d} {x}")

    def do_print_label_tally(self, rest): self._tally(self._show([(i, o)]) or "0" for _, i, o, _, _ in self.top())
    def do_print_arc_tally(self, rest): self._tally(self._show([(i, o)]) or "0" for _, i, o, _, _ in self.top())
    def do_print_sigma_tally(self, rest): self._tally(s for _, i, o, _, _ in self.top() for s in {i, o} if s not in (EPSILON,))
    def do_print_sigma_word_tally(self, rest): self._tally(s for _, p in P.paths(self.top(), None, 1) for x in p for s in set(x) if s != EPSILON)
    def do_print_labels(self, rest): self.say("Labels: " + " ".join(sorted({self._show([(i, o)]) or "0" for _, i, o, _, _ in self.top()})))
    do_print_label_maps = do_print_labels
    def do_print_flags(self, rest): self.say(" ".join(sorted(self.top().flags())))
    def do_print_name(self, rest): self.say(self.top().name)
    def do_print_file_info(self, rest): self.say(f"{self.top().props}")
    def do_print_directory(self, rest): self.say("\n".join(sorted(self.files)))
    def do_print_aliases(self, rest): self.say("\n".join(f"alias {n} {b}" for n, b in sorted(self.aliases.items())))
    def do_print_defined(self, rest): self.say("\n".join(f"{n} {self.definitions.get(n, '')}".strip() for n in sorted([*self.c.names, *self.c.functions])))
    def do_print_list(self, rest): self.say("\n".join(f"{n}: {' '.join(sorted(s))}" for n, s in sorted(self.c.lists.items()) if not rest.strip() or n == rest.rstrip(";").strip()))
    do_print_lists = do_print_list

    def do_print_stack(self, rest):
        for k, f in enumerate(reversed(self.stack)):
            self.say(f"{k}: {f.n_states} states, {f.n_arcs} arcs{' ' + f.name if f.name else ''}")

    # tests

    def _test(self, good: bool) -> None:
        self.say(f"{int(good)}, (1 = TRUE, 0 = FALSE)")

    def _pair_test(self, function) -> None:
        if len(self.stack) < 2:
            raise FstError("two nets are needed")
        self._test(function(self.stack[-1], self.stack[-2]))

    def do_test_equivalent(self, rest): self._pair_test(A.equivalent)
    def do_test_overlap(self, rest): self._pair_test(A.overlaps)
    def do_test_sublanguage(self, rest): self._pair_test(A.is_sublanguage)
    def do_test_identity(self, rest): self._test(A.is_identity(self.top()))
    def do_test_null(self, rest): self._test(A.is_empty(self.top()))
    def do_test_non_null(self, rest): self._test(not A.is_empty(self.top()))
    def do_test_infinitely_ambiguous(self, rest): self._test(A.is_infinitely_ambiguous(self.top()))
    def do_test_lower_bounded(self, rest): self._test(A.is_bounded(self.top(), "output"))
    def do_test_upper_bounded(self, rest): self._test(A.is_bounded(self.top(), "input"))
    def do_test_lower_universal(self, rest): self._test(A.is_universal(self.top(), "output"))
    def do_test_upper_universal(self, rest): self._test(A.is_universal(self.top(), "input"))

    # files

    def _text(self, rest: str) -> str:
        name = rest.strip().rstrip(";").lstrip("< ").strip()
        got = self.files.get(name, rest)
        return got.decode() if isinstance(got, bytes) else got

    def _put(self, rest: str, text: str) -> None:
        name = rest.strip().rstrip(";").lstrip("> ").strip()
        if name:
            self.files[name] = text
        else:
            self.say(text.rstrip("\n"))

    def do_read_text(self, rest): self.push(self._minimal(formats.read_words(self._text(rest).splitlines())))
    def do_read_spaced_text(self, rest): self.push(self._minimal(formats.read_spaced(self._text(rest).splitlines())))
    def do_read_lexc(self, rest): self.push(lexc.compile_lexc(self._text(rest)))
    def do_read_att(self, rest): self.stack += formats.read_att(self._text(rest))
    def do_read_prolog(self, rest): self.stack += formats.read_prolog(self._text(rest))
    def do_write_att(self, rest): self._put(rest, formats.write_att(self.top(), self.top().has_weights()))
    def do_write_dot(self, rest): self._put(rest, formats.write_dot(self.top()))
    def do_write_prolog(self, rest): self._put(rest, formats.write_prolog(self.top()))
    def do_write_text(self, rest): self._put(rest, formats.write_words(self.top(), None, 5 if A.is_cyclic(self.top()) else None))
    def do_write_spaced_text(self, rest): self._put(rest, formats.write_words(self.top(), None, 5 if A.is_cyclic(self.top()) else None, spaced=True))
    def do_write_definition(self, rest): name, _, to = rest.partition(" "); self._put(to, formats.write_prolog(self.c.names[name.rstrip(";")], name.rstrip(";")))
    def do_write_definitions(self, rest): self._put(rest, "\n".join(formats.write_prolog(f, n) for n, f in sorted(self.c.names.items())))
    def do_save_stack(self, rest): self._put(rest, "\n".join(formats.write_prolog(f, f.name or f"NET_{k}") for k, f in enumerate(self.stack)))
    def do_load_stack(self, rest): self.stack += formats.read_prolog(self._text(rest))
    def do_load_defined(self, rest): self.c.names |= {f.name: f for f in formats.read_prolog(self._text(rest))}
