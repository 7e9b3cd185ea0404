"""Text and binary forms of transducers: AT&T tables, prolog facts, word lists, pair strings, and the optimized-lookup container."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable

import numpy as np

from tapeworks.plans import algebra as A
from tapeworks.plans.fst import DEFAULT, EPSILON, IDENTITY, SPECIAL, UNKNOWN, FormatError, Fst, empty, f32, from_pairs, from_words, is_flag

# Escapes of the table form.
ATT_ESCAPES = {"@0@": EPSILON, "@_EPSILON_SYMBOL_@": EPSILON, "@_SPACE_@": " ", "@_TAB_@": "\t", "@_COLON_@": ":"}


def _att_in(s: str) -> str:
    return ATT_ESCAPES.get(s, s)


def _att_out(s: str) -> str:
    return {EPSILON: "@0@", " ": "@_SPACE_@", "\t": "@_TAB_@"}.get(s, s)


def read_att(text: str | Iterable[str]) -> list[Fst]:
    """The transducers of a table: one or two fields are a final state, four or five an arc; ``--`` stands between transducers."""
    out, f, any_line = [], Fst(), False
    for n, line in enumerate(text.splitlines() if isinstance(text, str) else text, 1):
        line = line.rstrip("\r\n")
        if line.startswith("--"):
            out.append(f)
            f, any_line = Fst(), False
            continue
        if not line.strip():
            continue
        parts = line.split("\t") if "\t" in line else line.split()
        any_line = True
        try:
            if len(parts) <= 2:
                f.set_final(int(parts[0]), float(parts[1]) if len(parts) == 2 and parts[1] else 0.0)
            elif len(parts) in (4, 5):
                f.add_arc(int(parts[0]), int(parts[1]), _att_in(parts[2]), _att_in(parts[3]), float(parts[4]) if len(parts) == 5 else 0.0)
            else:
                raise ValueError(f"{len(parts)} fields")
        except ValueError as e:
            raise FormatError(f"line {n}: {e}") from e
    if any_line or not out:
        out.append(f)
    return out


def _number(w: float) -> str:
    return f"{w:.6f}"


def write_att(f: Fst, weights: bool = True, numbers: dict[str, int] | None = None) -> str:
    """The table of a transducer; with numbers, symbols as numbers."""
    name = (lambda s: str(numbers[s])) if numbers else _att_out
    lines = []
    for s, i, o, w, d in f:
        lines.append("\t".join([str(s), str(d), name(i), name(o)] + ([_number(w)] if weights else [])))
    for s, w in sorted(f.finals.items()):
        lines.append("\t".join([str(s)] + ([_number(w)] if weights else [])))
    return "".join(x + "\n" for x in lines)


_FACT = re.compile(r'^\s*(network|symbol|arc|final)\((.*)\)\.\s*$')
_STRING = r'"((?:[^"\\]|\\.)*)"'


def _pl_in(s: str) -> str:
    s = re.sub(r"\\(.)", r"\1", s)
    return {"0": EPSILON, "?": IDENTITY, "%0": "0", "%?": "?"}.get(s, s)


def _pl_out(s: str, pair: bool) -> str:
    s = {EPSILON: "0", IDENTITY: "?", UNKNOWN: "?", "0": "%0", "?": "%?"}.get(s, s)
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def read_prolog(text: str) -> list[Fst]:
    """The networks of facts network/1, symbol/2, arc/4 (and /5 with a weight), final/2 (and /3). A question mark on both sides of a colon is any to any."""
    out: dict[str, Fst] = {}
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("%"):
            continue
        m = _FACT.match(line)
        if not m:
            raise FormatError(f"line {n}: not a fact: {line[:60]}")
        kind, rest = m[1], m[2]
        name = rest.split(",")[0].strip()
        f = out.setdefault(name, Fst(name=name))
        if kind == "symbol":
            got = re.match(rf"[^,]*,\s*{_STRING}\s*$", rest)
            f.alphabet.add(re.sub(r"\\(.)", r"\1", got[1]) if got else "")
        elif kind == "arc":
            got = re.match(rf"[^,]*,\s*(\d+),\s*(\d+),\s*{_STRING}(?:\s*:\s*{_STRING})?(?:,\s*([-\d.eE+]+))?\s*$", rest)
            if not got:
                raise FormatError(f"line {n}: not an arc: {line[:60]}")
            i = _pl_in(got[3])
            o = _pl_in(got[4]) if got[4] is not None else i
            if got[4] is not None:
                i, o = (UNKNOWN if x == IDENTITY else x for x in (i, o))
            f.add_arc(int(got[1]), int(got[2]), i, o, float(got[5] or 0))
        elif kind == "final":
            parts = [p.strip() for p in rest.split(",")]
            f.set_final(int(parts[1]), float(parts[2]) if len(parts) > 2 else 0.0)
    return list(out.values()) or [empty()]


def write_prolog(f: Fst, name: str = "", weights: bool = True) -> str:
    name = name or f.name or "NO_NAME"
    lines = [f"network({name})."]
    used = f.symbols_used()
    lines += [f"symbol({name}, {_pl_out(s, False)})." for s in sorted(f.alphabet - used)]
    for s, i, o, w, d in f:
        label = _pl_out(i, False) if i == o and i != UNKNOWN else f"{_pl_out(i, True)}:{_pl_out(o, True)}"
        lines.append(f"arc({name}, {s}, {d}, {label}{f', {_number(w)}' if weights and f.has_weights() else ''}).")
    lines += [f"final({name}, {s}{f', {_number(w)}' if weights and f.has_weights() else ''})." for s, w in sorted(f.finals.items())]
    return "".join(x + "\n" for x in lines)


def write_listing(f: Fst) -> str:
    """States with their arcs, one line each: ``Ss0: a -> s1``."""
    lines = []
    for s, row in enumerate(f.arcs):
        head = ("S" if s == 0 else "") + ("fs" if s in f.finals else "s") + str(s)
        arcs = [f"{_label(i, o)} -> {'fs' if d in f.finals else 's'}{d}" for i, o, _, d in row]
        lines.append(f"{head}: " + (", ".join(arcs) if arcs else "(no arcs)") + ".")
    return "\n".join(lines) + "\n"


def _label(i: str, o: str) -> str:
    show = lambda s: {EPSILON: "0", IDENTITY: "?", UNKNOWN: "?"}.get(s, s)
    return show(i) if i == o and i != UNKNOWN else f"<{show(i)}:{show(o)}>"


def write_dot(f: Fst) -> str:
    """A graph for drawing."""
    lines = ["digraph A {", "rankdir = LR;"]
    for s in range(len(f.arcs)):
        w = f.finals.get(s)
        lines.append(f'node [shape={"doublecircle" if w is not None else "circle"}, style=filled] q{s} [label="q{s}{f"/{w:g}" if w else ""}"];')
    for s, i, o, w, d in f:
        label = _label(i, o).strip("<>").replace('"', '\\"')
        lines.append(f'q{s} -> q{d} [label="{label}{f"/{w:g}" if w else ""}"];')
    return "\n".join([*lines, "}"]) + "\n"


def write_state_table(f: Fst) -> str:
    """Rows of states and columns of label pairs, 0 where there is no arc; final states end in a colon, others in a dot."""
    labels = sorted({(i, o) for _, i, o, _, _ in f})
    show = lambda s: {EPSILON: "0", IDENTITY: "@", UNKNOWN: "@"}.get(s, s)
    lines = ["\t" + "\t".join(show(i) for i, _ in labels), "\t" + "\t".join(show(o) for _, o in labels)]
    for s, row in enumerate(f.arcs):
        to = {(i, o): d + 1 for i, o, _, d in row}
        lines.append(f"{s + 1}{':' if s in f.finals else '.'}\t" + "\t".join(str(to.get(x, 0)) for x in labels))
    return "\n".join(lines) + "\n"


def read_words(lines: Iterable[str], multichar: Iterable[str] = ()) -> Fst:
    """One string a line, a weight after a tab."""
    words = []
    for line in lines:
        word, _, weight = line.rstrip("\r\n").partition("\t")
        if word or weight:
            words.append((word, float(weight) if weight else 0.0))
    return from_words(words, multichar)


def read_spaced(lines: Iterable[str]) -> Fst:
    """Symbols apart by spaces; ``a:b`` is a pair."""
    return A.union(empty(), *(from_pairs([_pair(t) for t in line.split()]) for line in lines if line.strip()))


def _pair(token: str) -> tuple[str, str]:
    parts = re.split(r"(?<!\\):", token, maxsplit=1)
    clean = [EPSILON if p in ("@0@", "0", "") else re.sub(r"\\(.)", r"\1", p) for p in parts]
    return (clean[0], clean[-1]) if len(clean) == 2 else (clean[0], clean[0])


def read_pairs(lines: Iterable[str], normalize: str | None = None) -> Fst:
    """``upper:lower`` strings, a weight after a tab; normalize 'norm', 'log' or 'log10' turns the weights of all lines into shares or their negative logarithms."""
    rows = []
    for line in lines:
        body, _, weight = line.rstrip("\r\n").partition("\t")
        if body:
            parts = re.split(r"(?<!\\):", body, maxsplit=1)
            upper, lower = (re.sub(r"\\(.)", r"\1", p) for p in (parts if len(parts) == 2 else parts * 2))
            rows.append((upper, lower, float(weight) if weight else 0.0))
    if normalize:
        total = sum(w for *_, w in rows)
        if total <= 0:
            raise FormatError("weights to normalize need a positive sum")
        turn = {"norm": lambda x: x, "log": lambda x: -float(np.log(x)), "log10": lambda x: -float(np.log10(x))}[normalize]
        rows = [(u, lo, turn(w / total)) for u, lo, w in rows if w > 0 or normalize == "norm"]
    return from_words(rows)


def write_words(f: Fst, most: int | None = None, cycles: int | None = None, spaced: bool = False, weights: bool = False) -> str:
    from tapeworks.plans.paths import paths

    lines = []
    for w, p in paths(f, most, cycles):
        pairs = [(i, o) for i, o in p if not is_flag(i)]
        show = lambda s: "" if s == EPSILON else s
        if spaced:
            text = " ".join(i if i == o else f"{i if i != EPSILON else '0'}:{o if o != EPSILON else '0'}" for i, o in pairs)
        else:
            a, b = "".join(show(i) for i, _ in pairs), "".join(show(o) for _, o in pairs)
            text = a if a == b else f"{a}:{b}"
        lines.append(text + (f"\t{w:g}" if weights else ""))
    return "".join(x + "\n" for x in lines)


# the container and the optimized-lookup tables; the numbers below are fixed values of that format. A container begins with four capital letters, which
# programs choose; any are read, and what is written has these or the caller's.

MAGIC = b"TAPE\0"
_HEADER = re.compile(rb"[A-Z]{4}\0")
NO_SYMBOL, NO_TABLE, TARGET_TABLE = 0xFFFF, 0xFFFFFFFF, 0x80000000
INF_WEIGHT = float("inf")


def is_container(data: bytes) -> bool:
    return _HEADER.match(data) is not None


def read_container(data: bytes) -> tuple[dict[str, str], int]:
    """(properties, length) of the header at the beginning of data."""
    if not is_container(data):
        raise FormatError("no container header")
    (size,) = struct.unpack_from("<H", data, len(MAGIC))
    begin = len(MAGIC) + 3
    parts = data[begin : begin + size].split(b"\0")
    props = {parts[k].decode(): parts[k + 1].decode() for k in range(0, len(parts) - 2, 2)}
    return props, begin + size


def write_container(props: dict[str, str], magic: bytes = MAGIC) -> bytes:
    body = b"".join(k.encode() + b"\0" + v.encode() + b"\0" for k, v in props.items())
    return magic + struct.pack("<H", len(body)) + b"\0" + body


def write_lookup(f: Fst, weighted: bool | None = None, magic: bytes = MAGIC) -> bytes:
    """The index and transition tables of a transducer, after a container header. Every state has an index row, so nothing overlaps. Other programs want their own magic letters."""
    weighted = f.has_weights() if weighted is None else weighted
    f = A.sort_arcs(f)
    inputs = sorted({i for _, i, _, _, _ in f if i != EPSILON and not is_flag(i)})
    others = sorted(({s for _, i, o, _, _ in f for s in (i, o)} | f.alphabet) - set(inputs) - {EPSILON})
    symbols = [EPSILON, *inputs, *others]
    number = {s: k for k, s in enumerate(symbols)}
    rows, width = [], len(inputs) + 2
    transitions: list[tuple[int, int, int, float]] = []
    place = {}
    for s, row in enumerate(f.arcs):
        order = sorted(row, key=lambda a: (number[a[0]] if not is_flag(a[0]) else 0, number[a[0]], number[a[1]]))
        place[s] = (len(transitions), order)
        first: dict[int, int] = {}
        transitions.append((NO_SYMBOL, NO_SYMBOL, 1 if s in f.finals else NO_TABLE, f.finals.get(s, INF_WEIGHT)))
        for i, o, w, d in order:
            key = 0 if is_flag(i) or i == EPSILON else number[i]
            first.setdefault(key, len(transitions))
            transitions.append((number[i], number[o], d, w))
        rows.append(first)
    transitions.append((NO_SYMBOL, NO_SYMBOL, NO_TABLE, INF_WEIGHT))
    index = bytearray()
    for s, first in enumerate(rows):
        final = f.finals.get(s)
        target = NO_TABLE if final is None else (int(np.float32(final).view(np.uint32)) if weighted else 1)
        index += struct.pack("<HI", NO_SYMBOL, target)
        for k in range(width - 1):
            index += struct.pack("<HI", k, first[k] + TARGET_TABLE) if k in first else struct.pack("<HI", NO_SYMBOL, NO_TABLE)
    table = bytearray()
    for i, o, d, w in transitions:
        target = d if i == NO_SYMBOL else d * width
        table += struct.pack("<HHI", i, o, target) + (struct.pack("<f", w) if weighted else b"")
    names = "".join(s + "\0" for s in symbols).encode()
    bits = [weighted, *([0] * 8)]
    header = struct.pack("<HHIIII", len(inputs) + 1, len(symbols), width * len(rows), len(transitions), f.n_states, f.n_arcs) + struct.pack("<9I", *bits)
    kind = magic[:4].decode() + ("_OLW" if weighted else "_OL")
    props = {"version": "3.3", "type": kind, "name": f.name}
    return write_container(props, magic) + header + names + bytes(index) + bytes(table)


def read_lookup(data: bytes) -> Fst:
    """The transducer of index and transition tables, with or without a container header."""
    props: dict[str, str] = {}
    at = 0
    if is_container(data):
        props, at = read_container(data)
    n_inputs, n_symbols, n_index, n_transitions, _, _ = struct.unpack_from("<HHIIII", data, at)
    at += 20
    flags = struct.unpack_from("<9I", data, at)
    weighted = bool(flags[0])
    at += 36
    symbols = []
    for _ in range(n_symbols):
        end = data.index(b"\0", at)
        symbols.append(data[at:end].decode())
        at = end + 1
    symbols[0] = EPSILON
    index = np.frombuffer(data, np.dtype([("i", "<u2"), ("t", "<u4")]), n_index, at)
    at += 6 * n_index
    kind = np.dtype([("i", "<u2"), ("o", "<u2"), ("t", "<u4")] + ([("w", "<f4")] if weighted else []))
    table = np.frombuffer(data, kind, n_transitions, at)
    f = Fst(alphabet={s for s in symbols if s and s not in SPECIAL}, name=props.get("name", ""), props=props)
    number, todo = {0: 0}, [0]

    def weight(k: int) -> float:
        return f32(float(table[k]["w"])) if weighted else 0.0

    def follow(state: int, k: int, want: int | None) -> None:
        while k < len(table) and table[k]["i"] != NO_SYMBOL and (want is None or int(table[k]["i"]) == want or (want == 0 and is_flag(symbols[int(table[k]["i"])]))):
            d = int(table[k]["t"])
            if d not in number:
                number[d] = len(number)
                todo.append(d)
            f.need(number[d])
            f.arcs[state].append((symbols[int(table[k]["i"])], symbols[int(table[k]["o"])], weight(k), number[d]))
            k += 1

    while todo:
        place = todo.pop()
        state = number[place]
        f.need(state)
        if place >= TARGET_TABLE:
            k = place - TARGET_TABLE
            if table[k]["t"] != NO_TABLE:
                f.finals[state] = weight(k)
            follow(state, k + 1, None)
            continue
        if index[place]["t"] != NO_TABLE:
            f.finals[state] = f32(float(np.uint32(index[place]["t"]).view(np.float32))) if weighted else 0.0
        for s in range(n_inputs):
            if place + 1 + s < n_index and index[place + 1 + s]["i"] == s:
                follow(state, int(index[place + 1 + s]["t"]) - TARGET_TABLE, s)
    return f


def read_archive(data: bytes) -> list[Fst]:
    """All transducers of a stream of containers."""
    if not is_container(data):
        raise FormatError("no container header")
    starts = [m.start() for m in re.finditer(re.escape(data[:5]), data)]
    return [read_lookup(data[a:b]) for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]


__all__ = [n for n in dir() if n.startswith(("read_", "write_"))] + ["DEFAULT"]
