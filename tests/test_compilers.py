import pytest

from tapeworks.plans import algebra as A
from tapeworks.plans import lexc, sfst, twolc
from tapeworks.plans import paths as P
from tapeworks.plans.fst import FormatError, FstError, UnsupportedError, from_words
from tapeworks.plans.lookup import compile_fst, correct, edit_model, is_infinitely_ambiguous_for, lookup, lookup_tags
from tapeworks.plans.shell import Shell
from tapeworks.plans.xre import regex
from tapeworks.sources import formats

LEXICON = """! a comment
Multichar_Symbols +N +Pl +Sg
Definitions
 X = x+ ;
LEXICON Root
Nouns ;
LEXICON Nouns
cat Infl ;
dog Infl "weight: 1.5" ;
mouse+N+Pl:mice # ;
LEXICON Infl
+N+Sg:0 # ;
+N+Pl:s # ;
END
"""


def test_lexicon():
    want = [("cat+N+Pl", "cats", 0.0), ("cat+N+Sg", "cat", 0.0), ("dog+N+Pl", "dogs", 1.5), ("dog+N+Sg", "dog", 1.5), ("mouse+N+Pl", "mice", 0.0)]
    f = lexc.compile_lexc(LEXICON)
    assert P.strings(f) == want
    g = lexc.compile_lexc(LEXICON, with_flags=True)
    assert P.strings(g, 10, flags=True) == want and A.equivalent(A.eliminate_flags(g), f)
    h = lexc.compile_lexc("LEXICON Root\n< a b* > # ;\n%#:%; # ;\n")
    assert P.strings(h, 3)[0][0] in ("#", "a") and ("#", ";") in {(u, lo) for u, lo, _ in P.strings(h, 5)}
    assert lexc.aligned(list("abc"), list("ac")) == [("a", "a"), ("b", "@_EPSILON_SYMBOL_@"), ("c", "c")]
    for bad in ("LEXICON Root\na Missing ;", "x\nLEXICON Root", "LEXICON Root\na b c d"):
        with pytest.raises(FormatError):
            lexc.compile_lexc(bad)


def test_two_level_rules():
    rules = twolc.compile_rules('Alphabet a b c k:g p:b k p ;\nSets V = a ;\nRules\n"voice" k:g <=> V _ b ;\n"only" p:b => _ c ;\n"never" p:b /<= a _ ;\n')
    ok = lambda name, *pairs: twolc.accepts_pairs(rules[name], [tuple(p.split(":")) if ":" in p else (p, p) for p in pairs])
    assert ok("voice", "a", "k:g", "b") and not ok("voice", "a", "k", "b") and not ok("voice", "a", "k:g") and ok("voice", "k", "b")
    assert ok("only", "p:b", "c") and not ok("only", "p:b") and not ok("never", "a", "p:b", "c") and ok("never", "p:b", "c")
    f = twolc.compose_intersect(from_words(["akb", "pc", "pa"]), list(rules.values()))
    assert {(u, lo) for u, lo, _ in P.strings(f)} == {("akb", "agb"), ("pa", "pa"), ("pc", "bc"), ("pc", "pc")}
    grammar = twolc.compile_grammar('Alphabet a b ;\nRules\n"vars" x:y <=> _ v ; where v in (a b) ;\n')
    assert twolc.accepts_pairs(grammar, [("x", "y"), ("a", "a")]) and not twolc.accepts_pairs(grammar, [("x", "y")])


def test_programs():
    s = lambda text: [(u, lo) for u, lo, _ in P.strings(sfst.compile_program(text))]
    assert s("ALPHABET = [a-d] a:b\n$V$ = a | b\n#S# = c d\n$W$ = $V$ #S#\n$W$ || .*\n") == [("ac", "ac"), ("ac", "bc"), ("ad", "ad"), ("ad", "bd"), ("bc", "bc"), ("bd", "bd")]
    assert s("$A$ = (a:b) ^-> ([c__])\n(ca | a) || $A$") == [("a", "a"), ("ca", "cb")]
    assert s("#X# = a b\n#=X# c #=X#") == [("aca", "aca"), ("bcb", "bcb")]
    assert s("{ab}:{cd} | a:<x>") == [("a", "<x>"), ("ab", "cd")] and s("^(a:b)") == [("b", "b")] and s("^_(a:b)") == [("b", "a")] and s("a - a | b") == [("b", "b")]
    with pytest.raises(FormatError):
        sfst.compile_program("$X$")


def test_shell():
    s = Shell()
    out = s.run("define V [a|e|i];\nregex [V b] | c;\nprint size\nwords\nregex {cat}:{dog} ;\napply down cat\napply up dog\napply down x\nregex a -> b || c _ ;\ndown ca\nset print-space ON\nregex [a b c];\nwords\ntest non-null\nregex a;\nregex a|b;\ntest sublanguage\nturn\ntest equivalent\n")
    lines = out.splitlines()
    assert lines[0].endswith("4 paths") and lines[1:5] == ["ab", "c", "eb", "ib"] and lines[5:9] == ["dog", "cat", "???", "cb"] and lines[9] == "a b c" and lines[10].startswith("1,") and lines[11].startswith("0,")
    t = Shell({"words.txt": "one\ntwo\n"})
    t.run("read text words.txt\nwrite prolog out.pl\npop\nread prolog out.pl\nlower-side\nreverse\nnegate\nprint sigma\nwrite att out.att")
    assert "network(" in t.files["out.pl"] and t.files["out.att"]
    assert Shell().run("define f(x) [x x];\nregex f(a);\nwords\nsubstitute symbol b for a\nwords\nprint stack").splitlines()[:2] == ["aa", "bb"]
    assert Shell().run("regex a b;\nregex c;\nconcatenate\nwords\nname N\nprint name") == "cab\nN"
    assert Shell().run('regex "^[" "a" "|" "b" "^]" ;\ncompile-replace lower\nwords').splitlines() == ["a", "b"]
    with pytest.raises(UnsupportedError):
        Shell().run("regex a;\napply med a")
    with pytest.raises(FstError):
        Shell().run("pop")
    with pytest.raises(FormatError):
        Shell().run("no such command")


def test_formats():
    f = regex("a:b::2 [c|%  | d:0]*")
    assert A.equivalent(formats.read_att(formats.write_att(f))[0], f) and A.equivalent(formats.read_prolog(formats.write_prolog(f))[0], f)
    g = lexc.compile_lexc(LEXICON)
    for weighted in (True, None):
        assert A.equivalent(formats.read_lookup(formats.write_lookup(g, weighted)), g)
    assert A.equivalent(formats.read_lookup(formats.write_lookup(g, magic=b"ABCD\0")), g) and formats.read_container(formats.write_lookup(g, magic=b"ABCD\0"))[0]["type"].startswith("ABCD_OL")
    u = A.without_weights(g)
    u.name = "TOP"
    back = formats.read_archive(formats.write_lookup(u) + formats.write_lookup(f))
    assert back[0].name == "TOP" and A.equivalent(back[0], u) and A.equivalent(back[1], f)
    assert len(formats.read_att("0\t1\ta\ta\n1\n--\n0\n")) == 2 and formats.read_att("0 1 a b 2.5\n1 1\n")[0].finals == {1: 1.0}
    assert [u for u, _, _ in P.strings(formats.read_words(["a\t2", "b"]))] == ["a", "b"] and P.strings(formats.read_spaced(["a:b c"])) == [("ac", "bc", 0.0)]
    shares = {u: w for u, _, w in P.strings(formats.read_pairs(["a:b\t1", "c:d\t3"], "norm"))}
    assert shares == {"a": 0.25, "c": 0.75}
    assert formats.write_listing(from_words(["ab", "c"])) == "Ss0: a -> s1, c -> fs3.\ns1: b -> fs2.\nfs2: (no arcs).\nfs3: (no arcs).\n"
    assert formats.write_dot(f).startswith("digraph") and formats.write_state_table(from_words(["ab"])).splitlines()[2] == "1.\t2\t0" and formats.write_words(from_words(["a"])) == "a\n"
    for bad in ("0\t1\ta\n", "x\n"):
        with pytest.raises(FormatError):
            formats.read_att(bad)
    with pytest.raises(FormatError):
        formats.read_prolog("arc(x)")
    with pytest.raises(FormatError):
        formats.read_archive(b"junk")


def test_lookup_details():
    f = regex('a "@P.F.X@":"@P.F.X@" b:0 | a b:c::1')
    c = compile_fst(f)
    assert lookup_tags(c, "ab", True) == ["@P.F.X@", ""] and lookup_tags(c, "ab", False) == ["a", "ac"]
    assert lookup(c, "ab", max_weight=0.5) == [(0.0, ("a",))] and len(lookup(c, "ab", most=1)) == 1
    assert lookup(compile_fst(regex("a:b")), "a", pairs=True) == [(0.0, (("a", "b"),))]
    loop = compile_fst(regex("a [0:x]*"))
    assert is_infinitely_ambiguous_for(loop, "a") and not is_infinitely_ambiguous_for(loop, "b") and len(lookup(loop, "a", cycles=2)) >= 2
    lexicon, errors = compile_fst(from_words([("cat", 1.0), ("cart", 0.0), ("dog", 0.0)])), compile_fst(edit_model(2, "catrdog"))
    assert correct(lexicon, errors, "caat") == [(1.0, "cart"), (2.0, "cat")] and correct(lexicon, errors, "caat", 1) == [(1.0, "cart")]
    assert correct(lexicon, compile_fst(edit_model(1, "catrdog")), "act") == [(2.0, "cat")]


def test_lookup_of_long_texts():
    rule, optional = compile_fst(regex("a -> b || c _")), compile_fst(regex("x (->) y"))
    text = "ca" * 20_000 + "a"
    assert [(w, "".join(out)) for w, out in lookup(rule, text)] == [(0.0, "cb" * 20_000 + "a")]
    assert ["".join(out).count("y") for _, out in lookup(optional, "a" * 3000 + "x")] == [0, 1]
    flags = compile_fst(regex('"@P.F.X@" a* "@R.F.X@" b | "@P.F.Y@" a* "@R.F.X@" b'))
    assert len(lookup(flags, "a" * 6000 + "b")) == 1 and lookup(flags, "a" * 6000) == [] and lookup(rule, "ca" * 3000, max_depth=50) == []
    late = compile_fst(regex("[a:x | a:y]* b | a* c"))
    assert [out[-1] for _, out in lookup(late, "a" * 5000 + "c")] == ["c"]
    loop = compile_fst(regex("a [0:x]*"))
    assert 2 <= len(lookup(loop, "a", cycles=3)) <= 5


def test_default_arcs():
    att = "0\t1\ta\tx\n0\t1\t@_DEFAULT_SYMBOL_@\t@_DEFAULT_SYMBOL_@\n1\n"
    c = compile_fst(formats.read_att(att)[0])
    assert [o for _, o in lookup(c, "a")] == [("x",)] and [o for _, o in lookup(c, "q")] == [("q",)]
    d = compile_fst(formats.read_att(att + "0\t2\t@0@\t@0@\n")[0])
    assert lookup(d, "q") == []
