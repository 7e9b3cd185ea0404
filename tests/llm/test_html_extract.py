from tapeworks.llm import html_extract
from tapeworks.llm.html_extract import extract, infer

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>x</article>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<!-- x <p>no</p> --><div class="ad">Buy</div><article><h1>{title}</h1>{body}<form><input><button>Go</button></form><div id="comments"><p>reader says</p></div></article>
<aside>side</aside><footer>&copy; foot</footer></body></html>"""


def test_roles_and_blocks():
    body = "<p>One &amp; two\n  three</p><p><b>Four &lt;five&gt;<br><p>Six</p><ul><li>a<li>b</ul>tail"
    assert extract(PAGE.format(title="Head  line", body=body), None) == "Head line\nOne & two three\nFour <five>\nSix\na\nb\ntail"


def test_cut_off_and_broken_pages():
    whole = PAGE.format(title="Head", body="<p>One</p><p>Two words</p>")
    at = whole.index("words")
    assert extract(whole[:at], None) == "Head\nOne\nTwo"
    assert extract(whole[: whole.index("Two")] + "<p class='x", None) == "Head\nOne"
    for broken in ("<", "<a", "< b", "</", "<!--", "<script>", "&am", '<p title="a>b">c</p>', "a < b", "<p a='>x"):
        assert isinstance(extract(broken, None), str)
    assert extract('<p title="a>b">c</p>', None) == "c" and extract("a < b &am", None) == "a < b &am"
    assert extract(None, None) == "" == extract("", None)


def test_unclosed_advert_ends_with_the_next_block():
    assert extract("<article><p class=ad>Buy<p>Text</article>", None) == "Text"


def test_named_parts():
    page = '<div class="post"><div class="post-header"><h1>T</h1></div><p>a</p><div class="post-comments"><p>c</p></div><div class="site-header">s</div><div id="sidebar-left">x</div><p hidden>h</p><span class="share">ok</span></div>'
    assert extract(page, None) == "T\na\nok"


def test_wrapper_finds_the_varying_part_of_unmarked_pages():
    def page(k):
        rows = "".join(f"<p>paragraph {k} {i} with words of its own</p>" for i in range(2 + k % 3))
        return f"<html><body><div class=top><span>Home</span></div><div class=box><div class=inner><h1>Title {k}</h1>{rows}</div></div><div class=low>All rights reserved</div></body></html>"

    rule = infer([page(k) for k in range(6)])
    assert rule["root"] == "div/div"
    assert extract(page(9), rule) == "\n".join(["Title 9", *(f"paragraph 9 {i} with words of its own" for i in range(2))])


def test_wrapper_has_slots_groups_and_options():
    streams = [html_extract.stream(p) for p in ("<div><h3>x</h3><p>a</p><p>b</p></div>", "<div><h3>y</h3><p>c</p></div>", "<div><p>c</p><p>d</p><p>e</p></div>")]
    wrapper = streams[0]
    for s in streams[1:]:
        wrapper = html_extract.align(wrapper, s)
    kinds = [(i.kind, i.value, i.optional) for i in wrapper]
    assert ("group", None, False) in kinds and ("tag", "h3", True) in kinds and ("text", None, True) in kinds


def test_table(spark):
    pages = [(k, f"http://h{k % 3}.example/{k}", PAGE.format(title=f"T{k}", body=f"<p>text {k}</p>"), 1, 2) for k in range(40)] + [(90, None, None, 1, 2), (91, "", "", 1, 2), (92, "no url", "<article>x" + "y" * 200000, 1, 2), (1, "http://h1.example/1", None, 1, 2), (None, "http://h1.example", "<article>z</article>", 1, 2)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host int, wrapper int")
    rows = html_extract.main_texts(df).collect()
    assert len(rows) == len(pages)
    by = {(r.page_id, r.text): r for r in rows}
    assert (5, "T5\ntext 5") in by and (90, "") in by and (92, "x" + "y" * 200000) in by and (None, "z") in by
    assert all(r.n_chars == len(r.text) for r in rows)
    assert html_extract.main_texts(df.where("page_id < -5")).count() == 0


def _pages(spark, rows):
    df = spark.createDataFrame([(k, f"http://one.example/{k}", p) for k, p in enumerate(rows)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extract.main_texts(df).collect()}


def test_fixed_texts_go_from_marked_articles_too(spark):
    page = "<html><body><article><h1>Title {0}</h1><div class=x7><p>Tell your friends about us</p></div><p>All the words of article {0} and some more</p></article></body></html>"
    got = _pages(spark, [page.format(k) for k in range(12)])
    assert got == {k: f"Title {k}\nAll the words of article {k} and some more" for k in range(12)}


def test_copies_of_an_unmarked_page_keep_their_text(spark):
    page = "<html><body><div><h1>The one title</h1><p>The one paragraph</p></div></body></html>"
    assert set(_pages(spark, [page] * 9).values()) == {"The one title\nThe one paragraph"}
    versions = [page.replace("</p>", f" in version {k}</p><p>and much more that all of the versions have, word for word</p>") for k in range(4)]
    assert all(t.startswith("The one title\n") and t.endswith("word for word") for t in _pages(spark, versions).values())


def test_rare_templates_and_many_fixed_texts(spark):
    lines = "".join(f"<p>fixed line {k}</p>" for k in range(700))
    often = "<html><body><section><h1>A{0}</h1><p>" + "words {0} of the first template " * 3 + "</p></section><div>" + lines + "</div></body></html>"
    rare = "<html><body><div><ul><li>Rare home</ul><div><h1>B{0}</h1><p>" + "words {0} of the second template " * 3 + "</p></div></div></body></html>"
    got = _pages(spark, [often.format(k) for k in range(60)] + [rare.format(k) for k in range(60, 64)])
    assert all(got[k] == f"A{k}\n" + " ".join([f"words {k} of the first template"] * 3) for k in range(60))
    assert all(got[k] == f"B{k}\n" + " ".join([f"words {k} of the second template"] * 3) for k in range(60, 64))


LAYOUTS = ["content-sidebar-wrap", "no-sidebar", "has-header", "page-with-comments", "content header-fixed", "share-enabled", "sidebar", "menu"]


def test_layout_classes_around_an_article_keep_it():
    for name in LAYOUTS:
        page = f'<body><div class="menu">Home</div><div class="{name}"><article><h1>T</h1><p>Some text</p><div class="comments">no</div></article><div class="sidebar">Side</div></div></body>'
        assert extract(page, None) == "T\nSome text", name
        bare = f'<body><div class="{name}"><h1>T</h1><p>Some text of this page</p><div class="sidebar">Side</div></div></body>'
        assert extract(bare, None) == "T\nSome text of this page", name
    comments = '<article><p>Text</p></article><div id="comments"><article>A reader</article></div>'
    assert extract(comments, None) == "Text" and extract('<div class="notice">x</div><p>y</p>', None) == "y"


def test_unmarked_pages_of_many_templates(spark):
    """Ten templates of one host without any marks, hosts of one page, and equal pages, against what was put in."""
    import random

    rng, rows, want = random.Random(5), [], {}
    for k in range(200):
        t = k % 10
        words = [" ".join(rng.choice("ab cd ef gh ij kl".split()) + str(rng.randrange(99)) for _ in range(rng.randint(8, 20))) for _ in range(rng.randint(1, 4))]
        lines = [f"Head {k}", *words]
        inner = f"<h2>{lines[0]}</h2>" + "".join(f"<p>{w}</p>" for w in words)
        top, low = f"<div><ul><li>Start {t}<li>News {t}</ul></div>", f"<div><span>All rights of {t}</span></div>"
        rows.append((k, f"http://many.example/{k}", f"<html><body>{'<div>' * t}{top}<section><div>{inner}</div></section>{low}{'</div>' * t}</body></html>"))
        want[k] = "\n".join(lines)
    for k in range(300, 310):
        rows.append((k, f"http://single{k}.example/", f"<body><div><h1>One {k}</h1><p>words of {k}</p></div></body>"))
        want[k] = f"One {k}\nwords of {k}"
    for k in range(400, 406):
        rows.append((k, "http://equal.example/x", "<body><div><p>Only this</p></div></body>"))
        want[k] = "Only this"
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.main_texts(df).collect()}
    assert got == want
    bare = {k: extract(p, None) for k, _, p in rows}
    assert sum(got[k] != bare[k] for k in got) == 200
