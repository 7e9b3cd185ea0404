from tapeworks.operators.running_text import Stream
from tapeworks.plans import algebra as A
from tapeworks.plans.fst import from_words

LEXICON = [("rose", "rose+n", 0.0), ("Rose", "Rose+np", 0.0), ("roses", "rose+n+pl", 1.5), ("rose bush", "rosebush+n", 0.0), ("a@b", "a@b+url", 0.0), ("well-known", "well-known+a", 0.0)]
F = from_words(LEXICON)


def show(text, **options):
    return Stream(F, **options).text(text)


def test_case():
    assert show("rose") == "^rose/rose+n$" and show("Rose") == "^Rose/Rose+np/Rose+n$" and show("ROSE") == "^ROSE/ROSE+np/ROSE+n$" and show("roSe") == "^roSe/rose+n$" and show("RoSe") == "^RoSe/Rose+np/Rose+n$"
    assert show("ROSE", case="sensitive") == "^ROSE/*ROSE$" and show("ROSE", case="dictionary") == "^ROSE/Rose+np/rose+n$"


def test_stretches_and_marks():
    assert show("rose bush, rose x [b rose]") == "^rose bush/rosebush+n$, ^rose/rose+n$ ^x/*x$ [b rose]"
    assert show("well-known well-x") == "^well-known/well-known+a$ ^well-x/*well-x$" and show("a\\@b.[][\n]") == "^a\\@b/a\\@b+url$.[][\n]"
    assert show("roses", weights=True) == "^roses/rose+n+pl~1.5~$" and show("rose", mode="tokenize") == "^rose$"
    assert show("roses\n", form="rows") == "roses\trose+n+pl\n\n" and show("x", form="rows") == "x\tx\t+?\n" and show("Rose", form="cohorts", case="dictionary") == '"<Rose>"\n\t"Rose"\tnp\n\t"rose"\tn\n'
    g = from_words([("w", "a", 0.0), ("w", "b", 1.0)])
    assert Stream(g, classes=1).text("w") == "^w/a$"


def test_generation():
    made = lambda t, mode="generation": Stream(F, mode=mode).text(t)
    assert made("^rose+n+pl$ ^Rose+n$ ^ROSE+n+pl$ ^q+n$ ^*zz$") == "roses Rose ROSES #q+n zz"
    assert made("^q+n$", "generation-bare") == "q+n" and made("^q+n$!", "generation-none") == "!"


def test_column(spark):
    from tapeworks.operators import apply as ops

    assert spark.createDataFrame([("rose x",), (None,)], "t string").select(ops.running_text(F)("t").alias("o")).collect()[0].o == "^rose/rose+n$ ^x/*x$"
    assert A.is_cyclic(F) is False
