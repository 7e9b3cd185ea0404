"""Running text: analysis of words where they stand, generation of analyses in place, and the marks that other programs put between.

A backslash takes a sign's special meaning; stretches in square brackets pass as blanks. The longest stretch that the transducer knows and that ends at a word's end is one word.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from tapeworks.plans import lookup as L
from tapeworks.plans.fst import EPSILON, Fst, is_flag

#: Signs that are escaped in output.
SIGNS = "^$/<>{}\\@[]~"
_STRETCH = re.compile(r"\[(?:\\.|[^\]\\])*\]|\\.|.", re.S)


def escaped(text: str) -> str:
    return re.sub(r"([\^$/{}\\\[\]~@])", r"\\\1", text)


@dataclass
class Stream:
    """``case``: 'ignore' (an upper-case letter may stand for its lower-case one, and lemmas take the word's case), 'sensitive', or 'dictionary' (ignore, but lemmas as the dictionary has
    them). ``form``: 'plain', 'rows' or 'cohorts'. ``weights``: print them; ``classes``: weight classes kept."""

    f: Fst
    mode: str = "analysis"
    case: str = "ignore"
    form: str = "plain"
    weights: bool = False
    classes: int | None = None

    def __post_init__(self):
        from tapeworks.plans.algebra import invert

        self.c = L.compile_fst(self.f if self.mode in ("analysis", "tokenize") else invert(self.f))
        self.letters = {s for s in self.c.alphabet if len(s) == 1}

    def results(self, word: str) -> list[tuple[str, float]]:
        """(analysis, weight) by weight; the word as it is comes before its case variants."""
        upper = [k for k, ch in enumerate(word) if ch.isupper() and ch.lower() != ch]
        variants = [word]
        if self.case != "sensitive" and upper:
            if len(upper) <= 6:
                choices = itertools.product(*([(True, False)] * len(upper)))
                variants = ["".join(ch.lower() if k in upper and not keep[upper.index(k)] else ch for k, ch in enumerate(word)) for keep in choices]
            else:
                variants = [word, word[0] + word[1:].lower(), word.lower()]
        best: dict[str, float] = {}
        for v in dict.fromkeys(variants):
            for w, out in L.lookup(self.c, v):
                s = "".join(x for x in out if x != EPSILON and not is_flag(x))
                s = s if self.case != "ignore" or self.mode != "analysis" else self._cased(s, word)
                best[s] = min(w, best.get(s, float("inf")))
        found = sorted(best.items(), key=lambda x: x[1])
        if self.classes is not None:
            kept = sorted({w for _, w in found})[: self.classes]
            found = [x for x in found if x[1] in kept]
        return found

    def _cased(self, analysis: str, word: str) -> str:
        """The lemma with the word's case: all upper if its first two letters are, else its first letter's."""
        if not word[0].isupper():
            return analysis
        cut = re.search(r"[+<]", analysis)
        lemma, tags = (analysis[: cut.start()], analysis[cut.start() :]) if cut else (analysis, "")
        return (lemma.upper() if len(word) > 1 and word[1].isupper() else lemma[:1].upper() + lemma[1:]) + tags

    def text(self, text: str) -> str:
        if self.mode in ("analysis", "tokenize"):
            return self._words(text)
        return re.sub(r"\^((?:\\.|[^$\\])*)\$", lambda m: self._generated(re.sub(r"\\(.)", r"\1", m[1])), text)

    def _generated(self, analysis: str) -> str:
        """A form of an analysis. Unknown: with a sign before it in mode 'generation', without in 'generation-bare', nothing in 'generation-none'."""
        if analysis[:1] in "*@":
            return analysis[1:]
        found = self.results(analysis) if self.case == "sensitive" else self._with_case(analysis)
        if found:
            return found[0][0]
        return {"generation": "#" + analysis, "generation-bare": analysis}.get(self.mode, "")

    def _with_case(self, analysis: str) -> list[tuple[str, float]]:
        best: dict[str, float] = {}
        cut = re.search(r"[+<]", analysis)
        lemma, tags = (analysis[: cut.start()], analysis[cut.start() :]) if cut else (analysis, "")
        for v in dict.fromkeys([lemma, lemma[:1] + lemma[1:].lower(), lemma.lower()]):
            for w, out in L.lookup(self.c, v + tags):
                s = "".join(x for x in out if x != EPSILON and not is_flag(x))
                best.setdefault(self._cased(s, lemma or " "), w)
        return list(best.items())

    def _words(self, text: str) -> str:
        # symbols: (character, whether it is blank mark-up), escapes resolved
        symbols = [(m[0], True) if m[0].startswith("[") else (m[0][-1], False) for m in _STRETCH.finditer(text)]
        out, k, n = [], 0, len(symbols)

        def letter(j: int) -> bool:
            return j < n and not symbols[j][1] and (symbols[j][0].isalnum() or (symbols[j][0] in self.letters and not symbols[j][0].isspace()))

        while k < n:
            if not letter(k):
                ch, blank = symbols[k]
                out.append(ch if blank or self.form != "plain" else escaped(ch) if ch in SIGNS else ch)
                k += 1
                continue
            end = k
            while letter(end):
                end += 1
            word, best, found = "".join(ch for ch, _ in symbols[k:end]), end, None
            found = self.results(word)
            # longer stretches over blanks, as long as the alphabet has what stands between
            stop = end
            while stop < n and not symbols[stop][1] and symbols[stop][0] in self.letters:
                stop += 1
                while letter(stop):
                    stop += 1
                longer = self.results("".join(ch for ch, _ in symbols[k:stop]))
                if longer:
                    best, found, word = stop, longer, "".join(ch for ch, _ in symbols[k:stop])
            out.append(self._shown(word, found))
            k = best
        return "".join(out)

    def _shown(self, word: str, found: list[tuple[str, float]]) -> str:
        if self.mode == "tokenize":
            return f"^{escaped(word)}$"
        if self.form == "rows":
            rows = [f"{word}\t{a}" + (f"\t{w:f}" if self.weights else "") for a, w in found] or [f"{word}\t{word}\t+?"]
            return "\n".join(rows) + "\n"
        if self.form == "cohorts":
            return "\n".join([f'"<{word}>"', *(f'\t"{re.split(r"[+<]", a, maxsplit=1)[0]}"' + "".join(f"\t{t}" for t in re.findall(r"[+<]([^+<>]+)", a)) for a, _ in found or [("*" + word, 0.0)])]) + "\n"
        shown = "/".join(escaped(a) + (f"~{w:g}~" if self.weights else "") for a, w in found) or "*" + escaped(word)
        return f"^{escaped(word)}/{shown}$"
