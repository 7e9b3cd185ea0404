"""Families of rules by name, the tagger of files, vector files, paths as transducers, alignment with flags, shell and module functions."""

import io
import json
import struct

from tapeworks import api
from tapeworks.functions import vectors as V
from tapeworks.operators import tagging
from tapeworks.plans import algebra as A
from tapeworks.plans import paths as P
from tapeworks.plans import rules as R
from tapeworks.plans.fst import EPSILON, Fst, from_words
from tapeworks.plans.lookup import aligned_with_flags, compile_fst, is_lookdown_infinitely_ambiguous, lookup
from tapeworks.plans.shell import Shell
from tapeworks.plans.xre import regex
from tapeworks.tools import TOOLS


def outputs(f: Fst, text: str) -> set[str]:
    return {"".join(o) for _, o in lookup(compile_fst(f), text)}


def test_replacements_by_the_side_of_their_contexts():
    ab, after_b = regex("a:b"), [(regex("b"), regex("0"))]
    assert outputs(R.replace_up(ab, after_b), "baa") == {"bba"} and outputs(R.replace_right(ab, after_b), "baa") == {"bbb"}
    before_b = [(regex("0"), regex("b"))]
    assert outputs(R.replace_up(ab, before_b), "aab") == {"abb"} and outputs(R.replace_left_sided(ab, before_b), "aab") == {"bbb"} and outputs(R.replace_down(ab, before_b), "aab") == {"bbb"}
    assert outputs(R.replace_up(ab, after_b, optional=True), "ba") == {"ba", "bb"}
    many = regex("a:x | b:y")
    assert outputs(R.replace_up(many), "abc") == {"xyc"}


def test_left_replacements_are_inverses():
    relation, contexts = regex("b:a"), [(regex("c"), regex("0"))]
    for left, plain in ((R.left_replace_up, R.replace_up), (R.left_replace_right, R.replace_right), (R.left_replace_left, R.replace_left_sided), (R.left_replace_down, R.replace_down)):
        assert A.equivalent(left(relation, contexts), A.invert(plain(A.invert(relation), contexts)))
    assert outputs(R.left_replace_up(relation, contexts), "cb") >= {"ca"}


def strings_over(pairs, most):
    out = [()]
    for _ in range(most):
        out += [(*p, q) for p in out for q in pairs]
    return set(out)


def test_restrictions_and_coercions_of_pairs():
    pairs, centre = [("a", "a"), ("a", "b"), ("c", "b"), ("x", "x")], [("a", "b")]
    contexts = [(Fst([[("x", "x", 0.0, 1)], []], {1: 0.0}, {"x"}), regex("0"))]

    def holds(f, p):
        layer = {0}
        for q in p:
            layer = {d for s in layer for i, o, _, d in f.arcs[s] if (i, o) == q}
        return any(s in f.finals for s in layer)

    behind = lambda p, k: k > 0 and p[k - 1] == ("x", "x")
    laws = {
        R.surface_restriction: lambda p: all(behind(p, k) for k, q in enumerate(p) if q[1] == "b"),
        R.deep_restriction: lambda p: all(behind(p, k) for k, q in enumerate(p) if q[0] == "a"),
        R.deep_coercion: lambda p: all(q == ("a", "b") for k, q in enumerate(p) if behind(p, k) and q[0] == "a"),
        R.surface_coercion: lambda p: all(q == ("a", "b") for k, q in enumerate(p) if behind(p, k) and q[1] == "b"),
        R.restriction_and_coercion: lambda p: all(behind(p, k) for k, q in enumerate(p) if q == ("a", "b")) and all(q == ("a", "b") for k, q in enumerate(p) if behind(p, k) and q[0] == "a"),
    }
    for function, law in laws.items():
        f = A.remove_epsilons(function(centre, contexts, pairs))
        for p in strings_over(pairs, 3):
            assert holds(f, p) == law(p), (function.__name__, p)


def test_tagger_of_files():
    text = "".join("\n".join(f"{w}\t{t}" for w, t in (x.split("/") for x in s.split())) + "\n\n" for s in ["the/D cat/N sleeps/V"] * 6 + ["the/D dog/N runs/V"] * 6 + ["dogs/N run/V"] * 4 + ["the/D run/N ends/V"] * 2)
    model = TOOLS["build-tagger"]([], text=text)
    assert TOOLS["tag"]([], model=model, text="the\nrun\nsleeps\n\ndogs\nrun\n\nthe\nzats\n").split("\n\n")[:2] == ["the\tD\nrun\tN\nsleeps\tV", "dogs\tN\nrun\tV"]
    loaded = json.loads(model)
    assert tagging.tag_words(loaded, []) == [] and tagging.tag_words(loaded, ["jumps"]) == ["V"] and loaded["trigrams"]["# D"]["N"] == 14
    assert json.loads(TOOLS["reweight-tagger"]([], model=model, factor="2", addition="1"))["words"]["cat"]["N"] == 13


def test_vector_files(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 3\ncat 1 0.5 -2\ndog\t0 0 1\n")
    assert {r.word: r.embedding for r in V.read_text(spark, str(tmp_path / "v.txt")).collect()} == {"cat": [1.0, 0.5, -2.0], "dog": [0.0, 0.0, 1.0]}
    (tmp_path / "v.bin").write_bytes(b"2 2\n" + b"cat " + struct.pack("<2f", 1, 2) + b"\ndog " + struct.pack("<2f", 3, 4))
    assert {r.word: r.embedding for r in V.read_binary(spark, str(tmp_path / "v.bin")).collect()} == {"cat": [1.0, 2.0], "dog": [3.0, 4.0]}


def test_paths_flags_and_functions(capsys):
    f = from_words([("ab", "x", 2.0), ("c", 1.0)])
    parts = P.path_transducers(f)
    assert [P.strings(p) for p in parts] == [[("c", "c", 1.0)], [("ab", "x", 2.0)]] and A.equivalent(A.union(*parts), f)
    flag = "@P.F.A@"
    assert aligned_with_flags(["a", flag, "b"], ["x"]) == [("a", "x"), (flag, flag), ("b", EPSILON)] and aligned_with_flags([flag], [flag, "y"]) == [(flag, flag), (EPSILON, "y")]
    assert is_lookdown_infinitely_ambiguous(regex("a b:0*"), "a") and not is_lookdown_infinitely_ambiguous(regex("a"), "a")
    assert api.get_output_to_console() is False
    api.set_output_to_console(True)
    assert list(api.start_xfst(["regex {ab};", "words"]))[-1] == "ab" and "ab" in capsys.readouterr().out
    api.set_output_to_console(False)
    assert A.equivalent(api.read_att_input(io.StringIO("0\t1\ta\tb\n1\n"))[0], regex("a:b"))


def test_shell_views():
    s = Shell()
    out = s.run("regex a:b | c;\ninspect net\nview net\nprint properties\n")
    assert "State 0" in out and "digraph" in out
