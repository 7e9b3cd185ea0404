"""The command-line tools: each takes transducers and options and gives transducers or text.

    python -m tapeworks.tools compose a.att b.att
    python -m tapeworks.tools lookup analyser.att < words

Files are read as tables, facts, word lists or containers by their first bytes and suffix; the first given file's form is the output's.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Callable, Sequence
from pathlib import Path

from tapeworks import api
from tapeworks.operators import tagging, tokens
from tapeworks.plans import algebra as A
from tapeworks.plans import lookup as L
from tapeworks.plans import paths as P
from tapeworks.plans import twolc
from tapeworks.plans.fst import EPSILON, FormatError, Fst, is_flag
from tapeworks.plans.pmatch import compile_script
from tapeworks.plans.xre import Compiler
from tapeworks.sources import formats

Tool = Callable[..., object]
TOOLS: dict[str, Tool] = {}


def tool(*names: str):
    def add(f: Tool) -> Tool:
        for n in names:
            TOOLS[n] = f
        return f

    return add


def _each(name: str, function: Callable[..., Fst]) -> None:
    TOOLS[name] = lambda fsts, **options: [function(f, **options) for f in fsts]


def _pairs(name: str, function: Callable[[Fst, Fst], Fst]) -> None:
    TOOLS[name] = lambda fsts, **options: [function(fsts[0], fsts[1], **options)]


for _name, _function in {
    "determinize": A.determinize, "minimize": A.minimize, "remove-epsilons": A.remove_epsilons, "invert": A.invert, "reverse": A.reverse, "prune-alphabet": A.prune_alphabet, "fst2fst": Fst.copy,
    "project": lambda f, side="input": A.project(f, side), "eliminate-flags": lambda f, flags=None: A.eliminate_flags(f, flags.split(",") if isinstance(flags, str) else flags),
    "push-weights": lambda f, direction="initial": A.push_weights(f, direction.startswith(("i", "s"))), "push-labels": lambda f, direction="initial": A.push_labels(f, direction.startswith(("i", "s"))),
    "realign": lambda f: A.push_labels(f, True), "repeat": lambda f, low="0", high=None: A.repeat(f, int(low), None if high is None else int(high)),
    "strip-header": lambda f: Fst(f.arcs, f.finals, f.alphabet), "twosided-flags": A.twosided_flags, "complete": lambda f: A.complete(A.determinize(f)),
}.items():
    _each(_name, _function)
for _name, _function in {
    "compose": A.compose, "concatenate": A.concat, "conjunct": A.intersect, "disjunct": A.union, "priority-disjunct": A.priority_union, "subtract": A.subtract, "shuffle": A.shuffle, "insert-freely": A.insert_freely,
    "cross-product": A.cross_product, "merge": A.merge, "lenient-compose": A.lenient_composition,
}.items():
    _pairs(_name, _function)


@tool("compare")
def compare(fsts, **options) -> str:
    return "equal" if A.equivalent(fsts[0], fsts[1]) else "different"


@tool("compose-intersect")
def compose_intersect(fsts, **options):
    return [twolc.compose_intersect(fsts[0], fsts[1:])]


@tool("multiply")
def multiply(fsts, n="2", **options):
    return [f.copy() for f in fsts for _ in range(int(n))]


@tool("head")
def head(fsts, n="1", **options):
    n = int(n)
    return fsts[:n] if n >= 0 else fsts[: len(fsts) + n]


@tool("tail")
def tail(fsts, n="1", **options):
    n = int(n)
    return fsts[-n:] if n > 0 else []


@tool("split")
def split(fsts, **options):
    return fsts


@tool("name")
def name(fsts, name="", **options):
    for f in fsts:
        f.name = name
    return fsts


@tool("edit-metadata")
def edit_metadata(fsts, **props):
    for f in fsts:
        f.props |= props
    return fsts


@tool("format", "info")
def info(fsts, **options) -> str:
    return "\n".join(f"{f.name or '-'}: {f.semiring}, {f.n_states} states, {f.n_arcs} arcs, {f.props}" for f in fsts)


@tool("summarize")
def summarize(fsts, **options) -> str:
    return "\n\n".join("\n".join(f"{k}: {v}" for k, v in P.summary(f).items()) for f in fsts)


@tool("check-alpha")
def check_alpha(fsts, **options) -> str:
    a, b = fsts[0].alphabet, fsts[1].alphabet
    return f"only first: {' '.join(sorted(a - b))}\nonly second: {' '.join(sorted(b - a))}"


@tool("fst2txt")
def fst2txt(fsts, format="att", **options) -> str:
    write = {"att": formats.write_att, "prolog": formats.write_prolog, "dot": formats.write_dot, "kimmo": formats.write_state_table, "listing": formats.write_listing}[format]
    return ("--\n" if format == "att" else "\n").join(write(f) for f in fsts)


@tool("fst2strings")
def fst2strings(fsts, max_strings=None, nbest=None, random=None, cycles=None, beam=None, max_in_length=None, in_prefix="", in_exclude="", weights=False, seed="0", **options) -> str:
    out = []
    for f in fsts:
        if nbest is not None:
            f = A.n_best(f, int(nbest))
        if random is not None:
            found = [(w, p) for w, p in P.random_paths(f, int(random), int(seed))]
        else:
            found = P.paths(f, None if max_strings is None else int(max_strings), None if cycles is None else int(cycles))
        least = min((w for w, _ in found), default=0.0)
        for w, p in found:
            upper, lower = ("".join(x[k] for x in p if x[k] != EPSILON and not is_flag(x[k])) for k in (0, 1))
            if beam is not None and w > least + float(beam) or max_in_length is not None and len(upper) > int(max_in_length) or not upper.startswith(in_prefix) or (in_exclude and in_exclude in upper):
                continue
            out.append((upper if upper == lower else f"{upper}:{lower}") + (f"\t{w:g}" if weights else ""))
    return "\n".join(out)


@tool("txt2fst")
def txt2fst(fsts, text="", prolog=False, **options):
    return formats.read_prolog(text) if prolog else formats.read_att(text)


@tool("strings2fst")
def strings2fst(fsts, text="", pairstrings=False, has_spaces=False, norm=None, disjunct=True, **options):
    lines = text.splitlines()
    if has_spaces:
        return [formats.read_spaced(lines)]
    if pairstrings or norm:
        return [formats.read_pairs(lines, norm)]
    return [formats.read_words(lines)] if disjunct else [formats.read_words([x]) for x in lines]


@tool("regexp2fst")
def regexp2fst(fsts, text="", disjunct=False, semicolon=False, **options):
    c = Compiler()
    made = c.compile_all(text) if semicolon else [c.compile(x) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("!")]
    return [A.minimize(A.union(*made))] if disjunct else made


@tool("lexc", "lexc-compiler")
def lexc_compiler(fsts, text="", with_flags=False, align=False, **options):
    from tapeworks.plans import lexc

    return [lexc.compile_lexc(text, with_flags=with_flags, align=align)]


@tool("twolc")
def twolc_compiler(fsts, text="", **options):
    out = []
    for n, f in twolc.compile_rules(text).items():
        f.name = n
        out.append(f)
    return out


@tool("sfst")
def sfst_compiler(fsts, text="", **options):
    from tapeworks.plans import sfst

    return [sfst.compile_program(text)]


@tool("xfst")
def xfst(fsts, text="", **options) -> str:
    from tapeworks.plans.shell import Shell

    shell = Shell()
    shell.stack += fsts
    return shell.run(text)


@tool("substitute")
def substitute(fsts, old="", new="", fst=None, **options):
    label = lambda s: tuple(EPSILON if x in ("", "0", "@0@") else x for x in (s.split(":") if ":" in s else (s, s)))
    if fst is not None:
        return [A.substitute_fst(f, label(old), fst) for f in fsts]
    if ":" in old:
        return [A.substitute_pairs(f, {label(old): [label(new)]}) for f in fsts]
    return [A.substitute_map(f, {label(old)[0]: label(new)[0]}) for f in fsts]


@tool("expand-equivalences")
def expand_equivalences(fsts, classes: Sequence[Sequence[str]] = (), level="upper", **options):
    """Each symbol also as the others of its class, on a side or both."""
    out = []
    for f in fsts:
        for group in classes:
            f = A.substitute_by(
                f, lambda i, o, group=group: [(x if i in group and level != "lower" else i, x if o in group and level != "upper" else o) for x in group] if (i in group and level != "lower") or (o in group and level != "upper") else None
            )
        out.append(f)
    return out


@tool("reweight")
def reweight(fsts, function="id", addition="0", multiplier="1", lower_bound=None, upper_bound=None, input_symbols=None, output_symbols=None, symbol=None, arcs_only=False, end_states_only=False, **options):
    turn = {"id": lambda w: w} | {n: getattr(math, n) for n in ("exp", "log", "log10", "sqrt", "sin", "cos", "tan", "floor", "ceil", "fabs")}

    def new(w: float) -> float:
        if lower_bound is not None and w < float(lower_bound) or upper_bound is not None and w > float(upper_bound):
            return w
        return float(multiplier) * turn[function](w) + float(addition)

    def hit(i: str, o: str) -> bool:
        return (symbol is None or symbol in (i, o)) and (input_symbols is None or i in input_symbols.split(",")) and (output_symbols is None or o in output_symbols.split(","))

    chosen = symbol or input_symbols or output_symbols
    out = []
    for f in fsts:
        arcs = [[(i, o, new(w) if not end_states_only and hit(i, o) else w, d) for i, o, w, d in row] for row in f.arcs]
        finals = {s: w if arcs_only or chosen else new(w) for s, w in f.finals.items()}
        out.append(f.like(arcs, finals))
    return out


def _results(fsts, text, how="union", beam=None, most=None, obey_flags=True, cycles=None, weights=True) -> str:
    compiled, lines = [L.compile_fst(f) for f in fsts], []
    for word in text.splitlines():
        found: dict[str, float] = {}
        if how == "composition":
            now = {word: 0.0}
            for c in compiled:
                step: dict[str, float] = {}
                for s, v in now.items():
                    for w, out in L.lookup(c, s, obey_flags, cycles=cycles):
                        t = "".join(x for x in out if x != EPSILON and not is_flag(x))
                        step[t] = min(v + w, step.get(t, math.inf))
                now = step
            found = now
        else:
            for c in compiled:
                for w, out in L.lookup(c, word, obey_flags, cycles=cycles):
                    t = "".join(x for x in out if x != EPSILON and not is_flag(x))
                    found[t] = min(w, found.get(t, math.inf))
                if found and how == "priority-union":
                    break
        ranked = sorted(found.items(), key=lambda x: (x[1], x[0]))
        if beam is not None and ranked:
            ranked = [x for x in ranked if x[1] <= ranked[0][1] + float(beam)]
        ranked = ranked[: None if most is None else int(most)]
        lines += [f"{word}\t{t}\t{w:.6f}" if weights else f"{word}\t{t}" for t, w in ranked] or [f"{word}\t{word}+?\tinf" if weights else f"{word}\t+?"]
        lines.append("")
    return "\n".join(lines)


@tool("lookup", "optimized-lookup")
def lookup(fsts, text="", cascade="union", beam=None, max_number=None, **options) -> str:
    return _results(fsts, text, cascade, beam, max_number)


@tool("flookup")
def flookup(fsts, text="", **options) -> str:
    return _results([A.invert(f) for f in reversed(fsts)], text, "composition" if len(fsts) > 1 else "union", weights=False)


@tool("proc")
def proc(fsts, text="", mode="analysis", form="plain", case="ignore", weights=False, classes=None, **options) -> str:
    """Running text: words with their analyses, or analyses between ^ and $ with their forms."""
    from tapeworks.operators.running_text import Stream

    return Stream(fsts[0], mode, case, form, bool(weights), None if classes is None else int(classes)).text(text)


@tool("pmatch", "pmatch2fst")
def pmatch(fsts, script="", text="", **options) -> str:
    m = compile_script(script, **options)
    return "\n".join(m.match(x) for x in text.splitlines())


@tool("tokenize")
def tokenize(fsts, script="", text="", form="tokenize", **options) -> str:
    m = compile_script(script)
    return "".join(tokens.Printer(form, **options).text(m, x) for x in text.splitlines())


@tool("pair-test")
def pair_test(fsts, text="", **options) -> str:
    out = []
    for line in text.splitlines():
        pairs = [tuple(EPSILON if x == "0" else x for x in (t.split(":") if ":" in t else (t, t))) for t in line.split()]
        failed = [f.name or str(k) for k, f in enumerate(fsts) if not twolc.accepts_pairs(f, pairs)]
        out.append(f"{line}\t{'ok' if not failed else 'failed: ' + ', '.join(failed)}")
    return "\n".join(out)


@tool("grep")
def grep(fsts, pattern="", text="", count=False, invert=False, only=False, number=False, most=None, whole=False, **options) -> str:
    c = Compiler()
    f = c.compile(pattern)
    accept = L.compile_fst(A.minimize(f if whole else A.contains(f)))
    m = compile_script(f"set need-separators off Define TOP [{pattern}] EndTag(M);") if only else None
    found = []
    for k, line in enumerate(text.splitlines(), 1):
        if L.accepts(accept, line) != invert:
            parts = [x.input for g in m.locate(line, False) for x in g[:1]] if m else [line]
            found += [f"{k}:{x}" if number else x for x in parts]
            if most is not None and len(found) >= int(most):
                break
    return str(len(found)) if count else "\n".join(found)


def suffix_guesser(f: Fst, longest: int = 5) -> dict[str, list[str]]:
    """Analyses' endings by word endings, from the words of an analyser (inputs analyses, outputs words)."""
    table: dict[str, dict[str, int]] = {}
    for upper, lower, _ in P.strings(f, None, 0 if A.is_cyclic(f) else None):
        k = 0
        while k < min(len(upper), len(lower)) and upper[k] == lower[k]:
            k += 1
        for n in range(1, min(longest, len(lower)) + 1):
            if len(lower) - n <= k:
                end = table.setdefault(lower[len(lower) - n :], {})
                rest = upper[len(lower) - n :]
                end[rest] = end.get(rest, 0) + 1
    return {s: sorted(e, key=lambda x: (-e[x], x)) for s, e in table.items()}


@tool("guessify", "affix-guessify", "guess")
def guess(fsts, text="", n="5", **options) -> str:
    table, out = suffix_guesser(fsts[0]), []
    for word in text.splitlines():
        for k in range(len(word)):
            if word[k:] in table:
                out += [f"{word}\t{word[:k]}{e}" for e in table[word[k:]][: int(n)]]
                break
        else:
            out.append(f"{word}\t{word}+?")
    return "\n".join(out)


@tool("build-tagger", "train-tagger-system")
def build_tagger(fsts, text="", **options) -> str:
    """A model of sentences, lines of words and tags."""
    return json.dumps(tagging.build(text), ensure_ascii=False, sort_keys=True)


@tool("reweight-tagger")
def reweight_tagger(fsts, model="", factor="1", addition="0", **options) -> str:
    return json.dumps(tagging.reweight_model(json.loads(model), float(factor), float(addition)), ensure_ascii=False, sort_keys=True)


@tool("tag")
def tag(fsts, model="", text="", **options) -> str:
    """Sentences, a word a line and a blank line behind each, with their tags."""
    loaded, out = json.loads(model), []
    for sentence in tagging.read_sentences(text):
        words = [w for w, _ in sentence]
        out += [f"{w}\t{t}" for w, t in zip(words, tagging.tag_words(loaded, words), strict=True)] + [""]
    return "\n".join(out)


@tool("traverse")
def traverse(fsts, text="", **options) -> str:
    """What can come next after a beginning."""
    f = A.remove_epsilons(A.project(fsts[0], "input"))
    layer = {0}
    for c in text.strip():
        layer = {d for s in layer for i, _, _, d in f.arcs[s] if i == c}
    return " ".join(sorted({i for s in layer for i, *_ in f.arcs[s]}) + (["#"] if any(s in f.finals for s in layer) else []))


def read(path: str) -> list[Fst]:
    data = Path(path).read_bytes()
    if formats.is_container(data):
        return formats.read_archive(data)
    text = data.decode()
    if text.lstrip().startswith("network("):
        return formats.read_prolog(text)
    if path.endswith((".strings", ".words")):
        return [formats.read_words(text.splitlines())]
    return formats.read_att(text)


def main(args: list[str]) -> int:
    if not args or args[0] not in TOOLS:
        sys.exit("tools: " + " ".join(sorted(TOOLS)))
    options: dict[str, object] = {}
    files = []
    for a in args[1:]:
        if a.startswith("--"):
            k, _, v = a[2:].partition("=")
            options[k.replace("-", "_")] = v if v else True
        else:
            files.append(a)
    for name in ("script", "model"):
        if name in options:
            options[name] = Path(str(options[name])).read_text()
    fsts = [f for p in files for f in read(p)]
    needs_text = args[0] in {"lookup", "optimized-lookup", "flookup", "proc", "pmatch", "tokenize", "pair-test", "grep", "guess", "traverse", "xfst", "strings2fst", "txt2fst", "regexp2fst", "lexc", "twolc", "sfst", "build-tagger", "train-tagger-system", "tag"}
    if needs_text and "text" not in options:
        options["text"] = sys.stdin.read()
    result = TOOLS[args[0]](fsts, **options)
    if isinstance(result, list):
        result = "--\n".join(formats.write_att(f) for f in result)
    print(result, end="" if str(result).endswith("\n") else "\n")
    return 0


__all__ = ["TOOLS", "FormatError", "api", "main"]

if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
