import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeworks.functions.text import java_pattern
from tapeworks.plans.fst import FormatError, UnsupportedError
from tapeworks.plans.lookup import accepts, compile_fst, lookup
from tapeworks.plans.syntax import parse
from tapeworks.plans.xre import Compiler, regex


def down(expression, text, **names):
    return sorted({"".join(o) for _, o in lookup(compile_fst(regex(expression, **names)), text)})


@pytest.mark.parametrize(
    ("expression", "text", "want"),
    [
        ("a -> b", "aab", ["bbb"]), ("a (->) b", "aa", ["aa", "ab", "ba", "bb"]), ("a -> b || c _ d", "cadcacad", ["cbdcacbd"]), ("[a a] -> b", "aaa", ["ab", "ba"]),
        ("[a+] @-> x", "caaab", ["cxb"]), ("[a b|b|b a|a b a] @-> x", "aba", ["x"]), ("[a+] @> x", "aaa", ["xxx"]), ("[a b|b|b a|a b a] >@ x", "aba", ["ax"]), ("[a b|b|b a|a b a] ->@ x", "aba", ["x"]),
        ("a -> %[ ... %]", "bab", ["b[a]b"]), ("[..] -> x", "ab", ["xaxbx"]), ("[..] -> x || a _ b", "abab", ["axbaxb"]), ("a -> b // b _", "aaa ba", ["aaa bb"]), ("a -> b \\\\ _ b", "aab", ["bbb"]),
        ("a -> b || _ b", "aab", ["abb"]), ("a -> b || .#. _", "aa", ["ba"]), ("a -> b || _ .#.", "aa", ["ab"]), ("a -> b , b -> a", "ab", ["ba"]), ("a -> b || x _ ,, b -> a || y _", "xayb xbya", ["xbya xbya"]),
        ("a <- b", "a", ["a", "b"]), ("a -> b || c _ , d _", "cada", ["cbdb"]), ("[a b] -> x || _ c", "abcab", ["xcab"]), ("e -> 0 || _ .#.", "cafe", ["caf"]), ("[{x}|{xy}] @-> %< ... %>", "xyx", ["<xy><x>"]),
        ("? -> x || a _", "abc", ["axc"]), ("\\a -> x || a _", "abac", ["axax"]), ("a -> b || ? _", "aa", ["ab"]), ("{abc} .o. [b -> 0]", "abc", ["ac"]), ("a:b*", "aa", ["bb"]), ("[{ab}:{c}]", "ab", ["c"]),
        ("[a .x. b] .P. [[a .x. c] | [d .x. e]]", "d", ["e"]), ("[a .x. b] .P. [[a .x. c] | [d .x. e]]", "a", ["b"]), ("[a .x. b] .O. [c .x. d]", "a", ["b"]), ("[a .x. b] .O. [b .x. d]", "a", ["d"]),
        ("[a:b c].u", "ac", ["ac"]), ("[a:b c].l", "bc", ["bc"]), ("[a:b].i", "b", ["a"]), ("[a b c].r", "cba", ["cba"]), ("`[[a b], a, c d]", "cb", ["cb"]), ("V @-> %[ ... %]", "xabax", ["x[aba]x"]),
        ("[a b c] - [a ? b]", "abc", ["abc"]), ("%% %0 \"0\"", "%00", ["%00"]), ("[a|b|c] & [b|c] - c", "b", ["b"]),
    ],
)
def test_applications(expression, text, want):
    assert down(expression, text, V="[a|b]+") == want


@pytest.mark.parametrize(
    ("expression", "good", "bad"),
    [
        ("$.a", ["ba"], ["aa", "b"]), ("$?a", ["b", "ba"], ["aa"]), ("$[a b]", ["xabx"], ["ba"]), ("~[$[a a]] & [a|b]*", ["abab"], ["aab"]), ("a => b _ c", ["bac", "x"], ["ba", "a"]), ("a => .#. _ .#.", ["a"], ["aa"]),
        ("a => b _ , _ c", ["ba", "ac"], ["a"]), ("a < b", ["ab", "aabb"], ["ba"]), ("a > b", ["ba"], ["ab"]), ("a^2", ["aa"], ["a"]), ("a^{1,3}", ["a", "aaa"], ["", "aaaa"]), ("a^>1", ["aa"], ["a"]), ("a^<2", ["", "a"], ["aa"]),
        ("[a b]/x", ["xaxb"], ["xax"]), ("[a b] <> c", ["acb", "cab"], ["ba"]), ("(a) b+", ["b", "abb"], ["a"]), ("{a b}", ["a b"], ["ab"]), ("[]", [""], ["a"]), ("a | 0", ["a", ""], ["b"]),
    ],
)
def test_acceptors(expression, good, bad):
    c = compile_fst(regex(expression))
    assert [w for w in good if not accepts(c, w)] == [] and [w for w in bad if accepts(c, w)] == []


def test_definitions_functions_lists_and_files():
    c = Compiler(reader=lambda kind, name: {"words": "cat\ndog\t2\n", "re": "a b", "att": "0\t1\ta\tb\t1.0\n1\n"}[name])
    c.define("V", "a|e")
    c.define_function("Twice", ["x"], "x x")
    c.define_list("L", "p q")
    f = compile_fst(c.compile("Twice(V) L"))
    assert accepts(f, "aep") and not accepts(f, "apx")
    assert accepts(compile_fst(c.compile('@txt"words"')), "dog") and accepts(compile_fst(c.compile('@re"re"')), "ab") and [o for _, o in lookup(compile_fst(c.compile('@"att"')), "a")] == [("b",)]
    c.undefine("V")
    assert not accepts(compile_fst(c.compile("V")), "a")
    assert len(c.compile_all("a; b | c;")) == 2


@pytest.mark.parametrize("expression", ["a .-u. b", "a .-l. b", "a ./. b", "a \\\\\\ b", "a <= b _ c", "a <=> b _ c"])
def test_not_available(expression):
    with pytest.raises(UnsupportedError):
        regex(expression)


@pytest.mark.parametrize("expression", ["[a", "a ->", "a )", "|", "a => b"])
def test_malformed(expression):
    with pytest.raises(FormatError):
        regex(expression)


def test_tree():
    assert repr(parse("a b|c")) == "|(concat(symbol('a'), symbol('b')), symbol('c'))"


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.sampled_from(["a", "b", "?", '"a-c"', "[a|b]", "{ab}", "[{ab}|{a}]"]), lambda s: st.one_of(st.tuples(s, s).map(" ".join), s.map(lambda x: f"[{x}]+"), s.map(lambda x: f"[{x}]*"), s.map(lambda x: f"({x})")), max_leaves=4), st.text("abc", max_size=6))
def test_column_patterns_accept_the_same_texts(expression, text):
    pattern = java_pattern(expression)
    if pattern is not None:
        from tapeworks.plans.pmatch import compile_script

        m = compile_script(f"set need-separators off Define TOP [{expression}] EndTag(X);")
        assert re.sub(pattern, lambda k: f"<X>{k[0]}</X>" if k[0] else "", text) == m.match(text)
