import subprocess
import sys
from pathlib import Path

from tapeworks import api
from tapeworks.plans import algebra as A
from tapeworks.plans import paths as P
from tapeworks.sources import formats
from tapeworks.tools import TOOLS

ROOT = Path(__file__).resolve().parent.parent
CAT = api.fst({"cat+N": "cat", "cat+N+Pl": "cats", "dog+N": ["dog", ("hound", 2.0)]})


def test_api():
    assert P.strings(api.fsa("ab")) == [("ab", "ab", 0.0)] and P.strings(api.fsa(("ab", 2))) == [("ab", "ab", 2.0)] and len(P.strings(api.fsa(["a", ("b", 1)]))) == 2
    f = api.fst({"a": "b"})
    assert A.equivalent(api.fsa_to_fst(api.fst_to_fsa(f, "|"), "|"), f) and P.strings(api.fsa_to_fst(api.fst_to_fsa(f))) == [("a", "b", 0.0)]
    assert P.strings(api.tokenized_fst(["<x>", ("a", "")], 1.5)) == [("<x>a", "<x>", 1.5)]
    a, b = api.fsa(["a", "b"]), api.fsa(["b", "c"])
    assert len(P.strings(api.disjunct([a, b]))) == 3 and P.strings(api.intersect([a, b])) == [("b", "b", 0.0)] and len(P.strings(api.concatenate([a, b]))) == 4
    assert P.strings(api.compose([api.fst({"a": "b"}), api.fst({"b": "c"})])) == [("a", "c", 0.0)] and len(P.strings(api.cross_product([a, b]))) == 4
    assert list(api.start_xfst(["regex a;", "words", "quit", "words"])) == ["", "a", ""]
    assert A.is_empty(api.empty_fst()) and P.strings(api.epsilon_fst(1.0)) == [("", "", 1.0)]


def test_tools(tmp_path):
    t = lambda name, *fsts, **o: TOOLS[name](list(fsts), **o)
    up = A.invert(CAT)
    assert t("lookup", up, text="cats\nx") == "cats\tcat+N+Pl\t0.000000\n\nx\tx+?\tinf\n" and t("flookup", CAT, text="cat") == "cat\tcat+N\n"
    assert t("compare", CAT, A.minimize(CAT)) == "equal" and t("compare", CAT, up) == "different"
    assert "states" in t("summarize", CAT) and "only first" in t("check-alpha", CAT, api.fsa("z"))
    assert t("fst2strings", up, nbest="1").count("\n") == 0 and t("fst2strings", up, in_prefix="cat").splitlines() == ["cat:cat+N", "cats:cat+N+Pl"]
    assert len(t("multiply", CAT, n="3")) == 3 and len(t("head", CAT, up, n="1")) == 1 and t("tail", CAT, up, n="1")[0] is up
    assert P.strings(t("reweight", api.fsa(("a", 2)), multiplier="2", addition="1")[0])[0][2] == 6.0
    assert P.strings(t("substitute", api.fsa("ab"), old="a", new="x")[0]) == [("xb", "xb", 0.0)] and {u for u, _, _ in P.strings(t("expand-equivalences", api.fsa("ab"), classes=[["a", "c"]])[0])} == {"ab", "cb"}
    assert t("proc", up, text="Cats [b x] zz") == "^Cats/Cat+N+Pl$ [b x] ^zz/*zz$" and t("proc", up, text="^cat+N+Pl$ ^q$", mode="generation") == "cats #q"
    assert t("grep", pattern="a b", text="xab\nb\nab") == "xab\nab" and t("grep", pattern="a b", text="xab\nb", count=True) == "1" and t("grep", pattern="a b", text="xab\nb", only=True, number=True) == "1:ab"
    assert t("pmatch", script="Define TOP {a} EndTag(A);", text="a b") == "<A>a</A> b" and t("tokenize", script="Define TOP Alpha+;", text="a b") == "a\nb\n\n"
    assert t("guess", CAT, text="bats").startswith("bats\tbat+N+Pl") and t("traverse", up, text="cat") == "s #"
    assert t("pair-test", *t("twolc", text='Alphabet a b ;\nRules\n"r" x:y => a _ ;\n'), text="a x:y\nx:y") == "a x:y\tok\nx:y\tfailed: r"
    assert t("regexp2fst", text="a\nb", disjunct=True)[0].n_arcs == 2 and "0" in t("fst2txt", CAT) and t("xfst", CAT, text="print name") == ""
    (tmp_path / "a.att").write_text(formats.write_att(up))
    done = subprocess.run([sys.executable, "-m", "tapeworks.tools", "lookup", str(tmp_path / "a.att")], input="cat\n", capture_output=True, text=True, cwd=ROOT, timeout=60)
    assert done.stdout.startswith("cat\tcat+N")
