"""Column functions of regular patterns: what Catalyst runs without Python.

Patterns whose alternatives are listed longest first match leftmost-longest as long as no alternative continues another's repetition; ``java_pattern`` translates
expression trees for which that holds and gives None for others, which then go to the compiled matcher.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeworks.plans.syntax import Node, parse

# Classes of the pattern language in Java's notation.
CLASSES = {"Alpha": "\\p{L}", "UppercaseAlpha": "\\p{Lu}", "LowercaseAlpha": "\\p{Ll}", "Num": "[0-9]", "Punct": "[\\p{P}\\p{S}]", "Whitespace": "\\s"}


def quoted(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}\-&~#])", r"\\\1", text)


def alternatives(words: Sequence[str]) -> str:
    """A pattern that takes the longest of the words at each place."""
    return "(?:" + "|".join(quoted(w) for w in sorted(set(words), key=lambda w: (-len(w), w))) + ")"


def java_pattern(expression: str | Node, definitions: dict[str, str] | None = None) -> str | None:
    """The Java pattern of an expression, or None where it isn't a plain regular pattern."""
    definitions = definitions or {}
    node = parse(expression) if isinstance(expression, str) else expression

    def words(n: Node) -> list[str] | None:
        if n.kind == "group":
            return words(n.args[0])
        if n.kind in ("symbol", "literal", "string") and n.args[0] not in CLASSES and n.args[0] not in definitions and not (n.kind == "literal" and re.fullmatch(r".-.", n.args[0], re.S)):
            return [n.args[0]]
        if n.kind == "|":
            a, b = words(n.args[0]), words(n.args[1])
            return None if a is None or b is None else a + b
        return None

    def one(n: Node) -> str | None:
        """A set of single characters."""
        if n.kind == "group":
            return one(n.args[0])
        if n.kind == "any":
            return "\\s\\S"
        if n.kind == "symbol" and n.args[0] in CLASSES:
            return CLASSES[n.args[0]].strip("[]")
        if n.kind == "literal" and re.fullmatch(r".-.", n.args[0], re.S):
            return f"{quoted(n.args[0][0])}-{quoted(n.args[0][2])}"
        if n.kind in ("symbol", "literal", "string") and len(n.args[0]) == 1:
            return quoted(n.args[0])
        if n.kind == "|":
            a, b = one(n.args[0]), one(n.args[1])
            return None if a is None or b is None else a + b
        return None

    def go(n: Node) -> str | None:
        if (w := words(n)) is not None:
            return alternatives(w)
        if n.kind == "symbol" and n.args[0] in definitions:
            return java_pattern(definitions[n.args[0]], {k: v for k, v in definitions.items() if k != n.args[0]})
        if (c := one(n)) is not None:
            return f"[{c}]"
        if n.kind == "group":
            return go(n.args[0])
        if n.kind == "concat":
            parts = [go(x) for x in n.args]
            return None if None in parts else "".join(parts)
        if n.kind in ("star", "plus", "optional", "times"):
            if (c := one(n.args[0])) is None:
                inner = go(n.args[0])
                if inner is None or n.kind != "optional" or words(n.args[0]) is None:
                    return None
            else:
                inner = f"[{c}]"
            if n.kind == "times":
                return inner + "{%d,%s}" % (n.args[1], "" if n.args[2] is None else n.args[2])
            return inner + {"star": "*", "plus": "+", "optional": "?"}[n.kind]
        if n.kind == "\\" and (c := one(n.args[0])) is not None:
            return f"[^{c}]"
        if n.kind == "-" and n.args[0].kind == "any" and (c := one(n.args[1])) is not None:
            return f"[^{c}]"
        return None

    return go(node)


def symbols(c: Column | str, multichar: Sequence[str] = ()) -> Column:
    """The symbols of a text: the longest multi-character symbol that fits, else one code point."""
    pattern = "|".join([alternatives(multichar)] if multichar else []) + ("|" if multichar else "") + "(?s:.)"
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), 1)


explode_symbols = symbols


def implode(c: Column | str) -> Column:
    return F.array_join(c, "")


def mark(c: Column | str, pattern: str, tag: str) -> Column:
    return F.regexp_replace(c, f"({pattern})", f"<{tag}>$1</{tag}>")


def delete(c: Column | str, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


def extract(c: Column | str, pattern: str, separator: str = "") -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(f"({pattern})"), 1), separator)


def occurrences(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def contains(c: Column | str, pattern: str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike(pattern)


def contains_once(c: Column | str, pattern: str) -> Column:
    return occurrences(c, pattern) == 1


def contains_at_most_once(c: Column | str, pattern: str) -> Column:
    return occurrences(c, pattern) <= 1


def replaced(c: Column | str, pattern: str, by: str, left: str = "", right: str = "", shared: bool = True) -> Column:
    """Obligatory replacement of matches in a context that is looked up in the text as it was.

    Where contexts aren't shared, a match takes its contexts with it: the next begins behind the right context of the one before.
    """
    if not shared:
        named = by.replace("\\", "\\\\").replace("$", "\\$")
        return F.regexp_replace(c, f"(?<left>{left})(?:{pattern})(?<right>{right})", f"${{left}}{named}${{right}}")
    before = f"(?<={left})" if left else ""
    after = f"(?={right})" if right else ""
    return F.regexp_replace(c, f"{before}(?:{pattern}){after}", by.replace("\\", "\\\\").replace("$", "\\$"))


def replaced_optionally(c: Column | str, pattern: str, by: str) -> Column:
    """The text with all matches replaced and the text as it is; with one match these are all variants."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_sort(F.array_distinct(F.array(c, replaced(c, pattern, by))))


def replaced_in_parallel(c: Column | str, table: dict[str, str]) -> Column:
    """One code point for another, all at once."""
    return F.translate(c, "".join(table), "".join(table.values()))


def inserted(c: Column | str, what: str, left: str = "", right: str = "") -> Column:
    """What at every place in the context."""
    return F.regexp_replace(c, (f"(?<={left})" if left else "") + (f"(?={right})" if right else ""), what)


def restricted(c: Column | str, centre: str, left: str, right: str) -> Column:
    """Whether every match of the centre stands in the context."""
    c = F.col(c) if isinstance(c, str) else c
    return occurrences(c, centre) == occurrences(c, f"(?:(?<={left})(?:{centre})(?={right}))")


def cap(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def variants(c: Column | str, kind: str) -> Column:
    """Case variants of a text as an array: Cap, UpCase, DownCase, their Opt forms, AnyCase (as it is, lower, upper, capitalised)."""
    c = F.col(c) if isinstance(c, str) else c
    base = {"Cap": [cap(c)], "UpCase": [F.upper(c)], "DownCase": [F.lower(c)], "AnyCase": [c, F.lower(c), F.upper(c), cap(c)]}
    found = base[kind.removeprefix("Opt")] + ([c] if kind.startswith("Opt") else [])
    return F.array_sort(F.array_distinct(F.array(*found)))
