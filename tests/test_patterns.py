import pytest

from tapeworks.operators import tokens as T
from tapeworks.plans import algebra as A
from tapeworks.plans import lexc
from tapeworks.plans.fst import FormatError, FstError, UnsupportedError
from tapeworks.plans.pmatch import NON_MATCHING, Location, Matcher, PatternCompiler, compile_script, from_networks
from tapeworks.plans.xre import regex
from tapeworks.sources import formats

OFF = "set need-separators off "


@pytest.mark.parametrize(
    ("script", "text", "want"),
    [
        (OFF + 'Define Digits "0-9"+; Define TOP [Digits {px}] EndTag(SIZE);', "w12px 7 px40px", "w<SIZE>12px</SIZE> 7 px<SIZE>40px</SIZE>"),
        (OFF + "Define TOP [{::}] EndTag(SCOPE);", "std::map:x", "std<SCOPE>::</SCOPE>map:x"),
        ("Define TOP [? - Whitespace]+ EndTag(WORD);", "go on  now", "<WORD>go</WORD> <WORD>on</WORD>  <WORD>now</WORD>"),
        (OFF + "Define TOP {km} RC({/h}) EndTag(SPEED);", "9km/h 9km", "9<SPEED>km</SPEED>/h 9km"),
        ("Define year [ {19} | {20} ] \"0-9\" \"0-9\"; Define TOP Ins(year) EndTag(YEAR);", "in 1987 or 2187", "in <YEAR>1987</YEAR> or 2187"),
        (OFF + "Define TOP [LC({ }) {-} EndTag(MINUS)] | [{+} RC({ }) EndTag(PLUS)];", " -4+ 3-1", " <MINUS>-</MINUS>4<PLUS>+</PLUS> 3-1"),
        ("Define TOP Define([{mr} | {ms}] EndTag(TITLE)) {. } Define(Alpha+ EndTag(NAME));", "ms. Reed", "<TITLE>ms</TITLE>. <NAME>Reed</NAME>"),
        ("Define TOP UpCase({iso}) EndTag(CODE);", "ISO iso", "<CODE>ISO</CODE> iso"),
        ("Define TOP OptCap({monday}) EndTag(DAY);", "Monday monday mOnday", "<DAY>Monday</DAY> <DAY>monday</DAY> mOnday"),
        ("Define TOP LC({no. }) \"0-9\"+ EndTag(NUMBER);", "no. 7 or 8", "no. <NUMBER>7</NUMBER> or 8"),
        ("Define TOP NLC({not }) {here} EndTag(PLACE);", "not here here", "not here <PLACE>here</PLACE>"),
        ("Define TOP {may} NRC({ not}) EndTag(MODAL);", "may not, may be", "may not, <MODAL>may</MODAL> be"),
        ("DefFun twice(part) part {, } part ; Define TOP twice({knock}) EndTag(JOKE);", "knock, knock", "<JOKE>knock, knock</JOKE>"),
        ('Define W Alpha+ ; Define TOP [W EndTag(WORD)] | ["0-9"+ EndTag(NUM)];', "route 66", "<WORD>route</WORD> <NUM>66</NUM>"),
        ("Define L [ {[} [Ins(L) | Alpha]* {]} ] ; Define TOP L EndTag(LIST);", "[a[b][[c]]] d", "<LIST>[a[b][[c]]]</LIST> d"),
        ("Define TOP [Alpha+ Capture(one)] {=} Captured(one) EndTag(SAME);", "x=x y=z", "<SAME>x=x</SAME> y=z"),
        ("Define TOP Interpolate({; }, {red}, {green}) EndTag(PAIR);", "red; green", "<PAIR>red; green</PAIR>"),
        ("Define TOP [{yes}|{no}].t(REPLY);", "yes no", "<REPLY>yes</REPLY> <REPLY>no</REPLY>"),
        ("Define TOP # Alpha+ EndTag(FIRST);", "one two", "<FIRST>one</FIRST> two"),
        ("Define TOP Lst({u}|{v})+ EndTag(UV);", "uvvu xu", "<UV>uvvu</UV> xu"),
        (OFF + "set unicode-character-classes on Define TOP Alpha+ EndTag(A);", "1жы2", "1<A>жы</A>2"),
        ("regex [{stop} EndTag(END)];", "stop", "<END>stop</END>"),
        ("Define TOP AnyCase({ok}) EndTag(OK);", "oK Ok no", "<OK>oK</OK> <OK>Ok</OK> no"),
        (OFF + "Define TOP [{i}|{ii}|{iii}] EndTag(ROMAN);", "iiiii", "<ROMAN>iii</ROMAN><ROMAN>ii</ROMAN>"),
        ("! a comment\nDefine TOP {go} EndTag(GO) ;", "go", "<GO>go</GO>"),
    ],
)
def test_match(script, text, want):
    assert compile_script(script).match(text) == want


def test_options():
    base = 'set need-separators off Define TOP "0-9"+ EndTag(N);'
    assert compile_script(base, delete_patterns="on").match("a1b22") == "ab"
    assert compile_script(base, extract_patterns="on", mark_patterns="off").match("a1b22") == "122"
    assert compile_script(base, mark_patterns="off").match("a1") == "a1"
    m = compile_script(base, count_patterns="on")
    m.match("1 2 3")
    assert m.counts == {"N": 3} and m.tag_counts("4 5") == {"N": 2}
    assert compile_script("set need-separators off Define TOP [{a} Counter(c)] | {b};").counters("aab") == {"c": 2}


def test_locate_keeps_all_of_the_longest_and_gaps():
    m = compile_script("set need-separators off Define TOP [[{a}:{x}::1 | {a}:{y}::2] EndTag(T)];")
    got = m.locate("ba")
    assert [g[0].output for g in got] == [NON_MATCHING, "x"] and [x.output for x in got[1]] == ["x", "y"]
    assert [(x.start, x.length, x.tag, x.weight) for x in got[1]] == [(1, 1, "T", 1.0), (1, 1, "T", 2.0)]


def test_errors():
    with pytest.raises(FstError):
        compile_script("Define A {a};")
    with pytest.raises(FstError):
        compile_script("Define TOP [TOP | {a}];")
    with pytest.raises(FormatError):
        compile_script("Nonsense X;")
    with pytest.raises(UnsupportedError):
        compile_script("Define TOP Like(word, 3);")


def test_neighbours():
    m = compile_script("Define TOP Like(cat, 2) EndTag(L);", neighbours=lambda words, n, like: ["dog", "cow"][:n] if like else [])
    assert m.match("dog cat") == "<L>dog</L> cat"


def loc(output, weight=0.0, tag="", text="abc", symbols=None):
    return Location(0, len(text), text, output, tag, weight, (), (), tuple(symbols or output))


def test_picking():
    group = [loc("abc+N", 1.0), loc("abc+V", 2.0), loc("abc+V", 2.0), loc("a#bc", 3.0)]
    assert len(T.deduped(group)) == 3 and len(T.deduped([loc("x", 1.0), loc("x", 2.0)], weights=False)) == 1
    assert [x.output for x in T.lightest_classes(group, 2)] == ["abc+N", "abc+V", "abc+V"] and len(T.lightest_classes([loc("", 0.0), *group], 1)) == 2
    assert len(T.within(group, 1.0)) == 3
    assert T.is_tag("+N") and not T.is_tag("a") and not T.is_tag("é") and not T.is_tag("tʰ") and T.is_tag("tʰx")
    with pytest.raises(ValueError):
        T.Printer("other")


# Stems with endings; a stem joined to further words, with a part mark in the analysis; a verb and its particle over a blank; and a name that may also be read word by word.
LEXICON = """Multichar_Symbols
+Noun +Plural +Verb +Adv +Name @PMATCH_INPUT_MARK@ @PMATCH_BACKTRACK@
LEXICON Root
Word ;
turn+Verb:turn Particle ;
< {lamp} "@PMATCH_BACKTRACK@":0 "@PMATCH_INPUT_MARK@":" " {oil} "+Name":0 > # ;
LEXICON Word
lamp Noun ;
post Noun ;
oil Noun ;
oil+Verb:oil # ;
lamp%#:lamp Word ;
LEXICON Noun
+Noun:0 # ;
+Noun+Plural:s # ;
LEXICON Particle
# ;
@PMATCH_INPUT_MARK@:%  Off ;
LEXICON Off
off+Adv:off # ;
"""
SCRIPT = """Define words @bin"lexicon" ;
Define letters Alpha+ ;
Define strange [letters - [words].u]:0 ;
Define TOP [words | strange] EndTag(word) ;"""


@pytest.fixture(scope="module")
def analyser():
    f = A.invert(lexc.compile_lexc(LEXICON))
    c = PatternCompiler(reader=lambda kind, name: f)
    c.script(SCRIPT)
    return Matcher.of(c)


def test_lines_and_columns(analyser):
    show = lambda form, text, **o: T.Printer(form, **o).text(analyser, text)
    assert show("tokenize", "turn off lamps ab") == "turn off\nlamps\nab\n\n" and show("space_separated", "turn off lamps ab") == "turn off lamps ab "
    assert show("tokenize", "post", weights=True) == "post\t0\n\n" and show("tokenize", "post ?", everything=True) == "post\n ?\n\n"
    assert show("cg", "ab posts") == '"<ab>"\n\t\n\n"<posts>"\n\tpost+Noun+Plural\n\n' and show("cg", "post") == '"<post>"\n\t"post"+Noun\n\n'
    assert show("xerox", "ab oil") == "ab\t\n\noil\toil+Noun\noil\toil+Verb\n\n\n"
    spaced = T.Printer("finnpos").group([loc("lamp N Pl", text="lamps"), loc("lamp V", text="lamps")], analyser)
    assert spaced == "lamps\t_\tlamp\tPl V\t_\n"
    assert show("conllu", "post oil") == "1\tpost\t_\t_\t_\t_\t_\t_\t_\tpost+Noun\n2\toil\t_\t_\t_\t_\t_\t_\t_\toil+Noun\n"
    x = loc("x[UPOS=NOUN][XPOS=N][WORD_ID=w][NUM=SG][CASE=NOM]", 1.0)
    assert T.Printer("conllu").group([x], analyser) == "1\tabc\tw\tNOUN\tN\tCase=NOM|Number=SG\t_\t_\t_\tx\n"
    assert T.Printer("xerox", beam=0.5).group([loc("p", 1.0), loc("q", 2.0)], analyser) == "abc\tp\n\n" and T.Printer("xerox").group([loc("abc")], analyser) == "abc\tabc\n\n"


def cohort(form, *readings):
    return f'"<{form}>"\n' + "".join("\t" * (1 + k) + part + "\n" for r in readings for k, part in enumerate(r))


def test_cohorts(analyser):
    show = lambda text, **o: T.Printer("giellacg", **o).text(analyser, text)
    post, oil, oils = ['"post"+Noun <W:0.0>'], ['"oil"+Noun <W:0.0>'], ['"oil"+Verb <W:0.0>']
    assert show("post") == cohort("post", post) and show("oil") == cohort("oil", oil, oils) and show("ab") == cohort("ab", ['"ab" ?'])
    # what stands between tokens is a line of its own
    assert show("post ab\n") == cohort("post", post) + ": \n" + cohort("ab", ['"ab" ?']) + ":\\n\n"
    # part marks cut the analysis, the last part first
    assert show("lampposts") == cohort("lampposts", ['"post"+Noun+Plural <W:0.0>', '"lamp" <W:0.0>'])
    assert show("lamplamppost") == cohort("lamplamppost", ['"post"+Noun <W:0.0>', '"lamp" <W:0.0>', '"lamp" <W:0.0>'])
    # input marks cut the form too
    assert show("turn off") == cohort("turn off", ['"off"+Adv <W:0.0> "<off>"', '"turn"+Verb <W:0.0> "<turn >"'])
    # behind a backtracking mark the form is read again in stretches
    again = [[f'{o[0]} "<oil>"', '"lamp"+Noun <W:0.0> "<lamp >"'] for o in (oil, oils)]
    assert show("lamp oil") == cohort("lamp oil", ['"lampoil"+Name <W:0.0>'], again[1], again[0])
    assert show("post", weights=False) == cohort("post", ['"post"+Noun']) and T.Printer()._part(T.Part(("a", "+N"), 0.25)) == '"a"+N\n'
    assert show("post[\\\n<x>]post", superblanks=True) == cohort("post", post) + ":[\\\\n<x>]\n" + cohort("post", post)
    assert show("post\0", superblanks=True).endswith("\n<STREAMCMD:FLUSH>\n")
    assert T.Printer("visl").text(analyser, "post ") == cohort("post", post) + " \n"


def test_parts_of_readings():
    def reading(output, form, marks=(), back=()):
        symbols = tuple(T.BACKTRACK if c == "|" else c for c in output)
        return Location(0, len(form), form, output, "", 0.5, tuple(at for at, _ in marks), tuple(o for _, o in marks), symbols)

    show = lambda x, **o: [("".join(p.symbols), p.form) for p in T.sub_readings(x, **o)]
    assert show(reading("ab#c", "abc")) == [("c", None), ("ab", None)] and show(reading("ab#c", "abc"), named=True) == [("c", "abc"), ("ab", None)]
    assert show(reading("ab#cd", "x y", [(2, 2)])) == [("#cd", "y"), ("ab", "x ")]
    assert show(reading("abc#d", "x yz", [(2, 2)])) == [("d", None), ("c", "yz"), ("ab", "x ")]
    back = reading("ab|cd", "x yz", [(2, 3)])
    assert T.form_cuts(back) == (0, 2, 4) and len(T.sub_readings(back)) == 1 and T.form_cuts(reading("ab", "ab")) == ()


def test_calls_nest_as_deep_as_texts_do():
    m = compile_script("Define P {(} Ins(P)* {)}; Define TOP P EndTag(T);")
    deep, wide = "(" * 1000 + ")" * 1000, "(" + "()" * 600 + ")"
    assert m.tag_counts(deep) == {"T": 1} and m.match(wide) == f"<T>{wide}</T>" and m.tag_counts("(" * 300) == {}
    shallow = compile_script("Define P {(} Ins(P)* {)}; Define TOP P EndTag(T);", max_recursion="3")
    assert shallow.match("(((())))") == "<T>(((())))</T>" and shallow.match("((((()))))") == "(<T>(((())))</T>)"


def test_long_outputs_and_weights_of_calls():
    m = compile_script('set need-separators off Define TOP [a:{' + "x" * 200 + '}]+ EndTag(T);', mark_patterns="off")
    assert m.match("a" * 30) == "x" * 6000
    called = compile_script("Define W [{a}::2 | {a}:{b}::1]; Define TOP Ins(W) EndTag(T);").locate("a")[0]
    assert [(x.output, x.weight) for x in called] == [("b", 1.0), ("a", 2.0)]


def test_stored_networks():
    def net(name, expression):
        f = regex(expression)
        f.name = name
        return f

    word = net("W", '"@PMATCH_ENTRY@" "@L.a_b@" "@L.a_b@"* "@PMATCH_ENDTAG_A@" "@PMATCH_EXIT@"')
    top = net("TOP", '"@I.W@" | "@PMATCH_ENTRY@" c "@PMATCH_RC_ENTRY@" d "@PMATCH_RC_EXIT@" "@PMATCH_ENDTAG_C@" "@PMATCH_EXIT@" | "@PMATCH_ENTRY@" "@X.a_b_c@" "@PMATCH_NLC_ENTRY@" e "@PMATCH_NLC_EXIT@":"@PMATCH_NLC_EXIT@" 0:"@PMATCH_ENDTAG_X@" "@PMATCH_EXIT@"')
    m = from_networks([top, word], need_separators="off")
    assert m.match("abc cd") == "<A>ab</A>c<X> </X><C>c</C><X>d</X>"
    assert from_networks(formats.read_archive(formats.write_lookup(top) + formats.write_lookup(word)), need_separators="off").match("ab") == "<A>ab</A>"
    with pytest.raises(FormatError):
        from_networks([word])


@pytest.mark.parametrize(
    ("script", "plain"),
    [
        ("Define TOP Alpha+ EndTag(W);", True), ('Define W Alpha+; Define TOP [W EndTag(A)] | ["0-9"+ EndTag(N)] | [{the} EndTag(T)];', True), (OFF + "Define TOP [[{a}|{ab}|{abc}] EndTag(X)] | [? - Whitespace];", True),
        (OFF + "set unicode-character-classes on Define TOP [Alpha+ EndTag(A)] | \\Alpha;", True), (OFF + "Define TOP Define([{a} EndTag(A)]) {b} Define([{c} EndTag(C)]);", False), ("Define TOP {a}:{b};", False), ("Define TOP {a} RC({b});", False), ("Define TOP {a}::1;", False),
    ],
)
def test_the_automaton_of_plain_patterns_finds_the_same(script, plain):
    a, b = compile_script(script), compile_script(script)
    assert (a.fast() is not None) == plain
    b.__dict__["_fast"] = None
    for text in ("the ab1 abcabd  12 xé the", "", "a", "abc ab a b c", "жуки 3 the"):
        assert a.locate(text) == b.locate(text) and a.match(text) == b.match(text) and a.tag_counts(text) == b.tag_counts(text)
