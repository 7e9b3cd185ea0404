"""The module-level functions: making, reading, compiling and combining transducers."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Sequence
from pathlib import Path

from tapeworks.plans import algebra as A
from tapeworks.plans import lexc, sfst, twolc
from tapeworks.plans.fst import EPSILON, SPECIAL, Fst, FstError, from_pairs, from_words
from tapeworks.plans.fst import empty as empty_fst  # noqa: F401
from tapeworks.plans.fst import epsilon as epsilon_fst  # noqa: F401
from tapeworks.plans.pmatch import Matcher, compile_script
from tapeworks.plans.shell import Shell
from tapeworks.plans.xre import Compiler
from tapeworks.sources import formats


def regex(expression: str, definitions: dict[str, str | Fst] | None = None, reader: Callable[[str, str], str | Fst] | None = None) -> Fst:
    """The transducer of an expression."""
    c = Compiler(reader=reader)
    for name, e in (definitions or {}).items():
        c.define(name, e)
    return c.compile(expression)


def fsa(arg: str | Iterable) -> Fst:
    """An automaton of a string, a (string, weight) pair, or a list or dict of them."""
    if isinstance(arg, str):
        return from_words([arg])
    if isinstance(arg, tuple):
        return from_words([(arg[0], float(arg[1]))])
    return from_words([a if isinstance(a, str) else (a[0], float(a[1])) for a in arg])


def fst(arg) -> Fst:
    """A transducer of what fsa() takes, or of a dict from upper strings to lower strings, pairs with weights, or lists of them."""
    if not isinstance(arg, dict):
        return fsa(arg)
    rows = []
    for upper, lowers in arg.items():
        for lower in lowers if isinstance(lowers, (list, set)) else [lowers]:
            rows.append((upper, lower, 0.0) if isinstance(lower, str) else (upper, lower[0], float(lower[1])))
    return from_words(rows)


def fst_to_fsa(f: Fst, separator: str = "") -> Fst:
    """Label pairs as single symbols: input, separator and output in one."""
    out = Fst(name=f.name)
    out.arcs = [[] for _ in f.arcs]
    for s, i, o, w, d in f:
        label = i if i == o else f"{i}{separator}{o}"
        out.arcs[s].append((label, label, w, d))
    out.finals, out.alphabet = dict(f.finals), {i for r in out.arcs for i, *_ in r} - SPECIAL
    return out


def fsa_to_fst(f: Fst, separator: str = "") -> Fst:
    """The inverse of fst_to_fsa(); without a separator, symbols of two special or one-character parts are cut in the middle."""
    f.need_automaton("fsa_to_fst")

    def cut(s: str) -> tuple[str, str]:
        if separator:
            parts = s.split(separator)
            if len(parts) > 2:
                raise FstError(f"more than one separator in {s!r}")
            return (parts[0], parts[-1])
        m = re.fullmatch(r"(@[^@]+@|.)(@[^@]+@|.)", s, re.S)
        return (m[1], m[2]) if m and s not in SPECIAL else (s, s)

    arcs = [[(*cut(i), w, d) for i, _, w, d in row] for row in f.arcs]
    return f.like(arcs, dict(f.finals), {s for r in arcs for a in r for s in a[:2]} - SPECIAL)


def tokenized_fst(arg: Sequence[str | tuple[str, str]], weight: float = 0.0) -> Fst:
    """One path of given symbols or symbol pairs."""
    return from_pairs([(a, a) if isinstance(a, str) else (a[0] or EPSILON, a[1] or EPSILON) for a in arg], weight)


def concatenate(fsts: Sequence[Fst]) -> Fst:
    return A.minimize(A.concat(*fsts))


def disjunct(fsts: Sequence[Fst]) -> Fst:
    return A.minimize(A.union(*fsts))


def _fold(fsts: Sequence[Fst], function) -> Fst:
    if not fsts:
        raise FstError("no transducers")
    out = fsts[0]
    for f in fsts[1:]:
        out = function(out, f)
    return A.minimize(out)


def intersect(fsts: Sequence[Fst]) -> Fst:
    return _fold(fsts, A.intersect)


def compose(fsts: Sequence[Fst]) -> Fst:
    return _fold(fsts, A.compose)


def cross_product(fsts: Sequence[Fst]) -> Fst:
    return _fold(fsts, A.cross_product)


read_att_string = formats.read_att


def _text(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")


def read_att_transducer(path: str) -> list[Fst]:
    return formats.read_att(_text(path))


def read_prolog_transducer(path: str) -> list[Fst]:
    return formats.read_prolog(_text(path))


def compile_lexc_file(path: str, *more: str, **options) -> Fst:
    return lexc.compile_lexc(*(_text(p) for p in (path, *more)), **options)


def compile_twolc_file(path: str) -> dict[str, Fst]:
    return twolc.compile_rules(_text(path))


def compile_pmatch_file(path: str, **options: str) -> Matcher:
    return compile_script(_text(path), lambda kind, name: _text(str(Path(path).parent / name)), **options)


def compile_sfst_file(path: str) -> Fst:
    return sfst.compile_program(_text(path), lambda name: _text(str(Path(path).parent / name)))


def compile_xfst_file(path: str) -> Shell:
    """The shell after all commands of a file."""
    shell = Shell()
    shell.run(_text(path))
    return shell


def start_xfst(lines: Iterable[str]) -> Iterable[str]:
    """What the shell prints for each line, until a line ends it."""
    shell = Shell()
    for line in lines:
        said = shell.run(line)
        if _console and said:
            print(said)
        yield said
        if shell.done:
            return


_console = False


def set_output_to_console(value: bool) -> None:
    """Whether shells that start_xfst() runs print to the console too, besides giving back what they say."""
    global _console
    _console = bool(value)


def get_output_to_console() -> bool:
    return _console


def read_att_input(stream=None) -> list[Fst]:
    """Transducers of table lines from a stream, the standard input by default, up to its end."""
    return formats.read_att((stream or sys.stdin).read())
