"""Token streams of HTML pages: tags with what tells their role, and texts. Lenient: unclosed and cut-off mark-up is read as far as it goes."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: Elements whose content isn't mark-up, up to their end tag.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that neither end a block nor take part in a page's structure.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end a block but whose end tags pages leave out.
LOOSE = {"p", "li", "dt", "dd", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "option", "figcaption", "pre", "blockquote", "center", "html", "body", "head"}
ENDED_BY_ANY = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold no part of an article.
OUTSIDE = {"head", "nav", "footer", "aside", "form", "button", "select", "datalist", "object", "svg", "canvas", "dialog", "menu", "audio", "video", "map", "math"} | RAW
MAIN = {"article", "main"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
_WORDS = re.compile(
    r"ads?|advert\w*|sponsor\w*|banner|promo\w*|cookies?|consent|gdpr|notices?|notification|alert|nav|navbar|navigation|menu|sidebar|sidenav|footer|masthead|site-?header|page-?header|header|topbar"
    r"|comments?|commentlist|disqus|repl(?:y|ies)|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|breadcrumbs?|popup|modal|overlay|login|signup|paywall|disclaimer|widget|pagination|pager|skip-?link|toolbar"
)
_CONTENT = {"article", "post", "entry", "content", "story"}
#: Parts of class names that tell how a page is laid out, not what an element holds.
_LAYOUT = {"no", "not", "has", "have", "with", "without", "enabled", "disabled", "fixed", "sticky", "collapsed"}
_WRAPS = {"wrap", "wrapper", "container", "layout", "area", "inner", "outer"}
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_QUOTE = re.compile(r"[\"'>]")


def _tag_end(page: str, at: int) -> int:
    """Where the tag that starts at ``at`` ends (after its >), past quoted values; the next > if a quote is never closed."""
    k = at + 1
    while m := _QUOTE.search(page, k):
        if m[0] == ">":
            return m.end()
        if not page[max(at, m.start() - 8) : m.start()].rstrip().endswith("="):
            k = m.end()
            continue
        close = page.find(m[0], m.end())
        if close < 0:
            break
        k = close + 1
    end = page.find(">", at)
    return end + 1 if end >= 0 else len(page)


def tokens(page: str | None) -> Iterator[tuple[str, str, str]]:
    """("open" or "close", element, role) and ("text", characters decoded, ""). role is "out" for what no article holds, "named" where only a class or id says so, "main", "header", or empty."""
    page = page or ""
    at, n = 0, len(page)
    while at < n:
        less = page.find("<", at)
        if less < 0:
            less = n
        if less > at:
            yield "text", html.unescape(page[at:less]), ""
        if less >= n:
            return
        if page.startswith("<!--", less):
            end = page.find("-->", less + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith(("<!", "<?"), less):
            at = _tag_end(page, less)
            continue
        m = _NAME.match(page, less)
        if not m:
            yield "text", "<", ""
            at = less + 1
            continue
        at, name = _tag_end(page, less), m[1].lower()
        if page[less + 1] == "/":
            yield "close", name, ""
            continue
        yield "open", name, role(name, page[m.end() : at - 1])
        if name in RAW and not page[less:at].endswith("/>"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)", re.I).search(page, at)
            if not end and name not in ("script", "style"):
                continue
            at = _tag_end(page, end.start()) if end else n
            yield "close", name, ""


def role(name: str, attributes: str) -> str:
    if name in OUTSIDE:
        return "out"
    found = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in _ROLES or re.search(r"display\s*:\s*none", found.get("style", "")):
        return "out"
    if name in MAIN or found.get("role") in ("main", "article") or found.get("itemprop") == "articlebody":
        return "main"
    if name not in INLINE and name not in ("html", "body") and any(_named_out(word) for k in ("class", "id") for word in found.get(k, "").split()):
        return "named"
    return "header" if name == "header" else ""


def _named_out(word: str) -> bool:
    """Whether a class or id names something that no article holds, as a whole or by a part; the header of an article is a part of it."""
    parts = re.split(r"[-_]+", word)
    own = not _CONTENT.isdisjoint(parts)
    if not _LAYOUT.isdisjoint(parts) or (own and not _WRAPS.isdisjoint(parts)):
        return False
    return any(_WORDS.fullmatch(p) and not (own and p == "header") for p in {word, *parts})


class Walk:
    """The open elements of a page while its tokens go by; each is (element, role, number)."""

    def __init__(self):
        self.open: list[tuple[str, str, int]] = []
        self.count = 0

    def step(self, kind: str, name: str, part: str) -> None:
        if kind == "open" and name not in INLINE and name not in VOID:
            # a block ends an unclosed paragraph or heading, an item the item before it
            while self.open and (self.open[-1][0] in ENDED_BY_ANY or self.open[-1][0] == name in LOOSE):
                self.open.pop()
            if name not in LOOSE or part:
                self.count += 1
                self.open.append((name, part, self.count))
        elif kind == "close" and name not in INLINE:
            self._close(name)

    def _close(self, name: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == name:
                del self.open[k:]
                return

    def path(self) -> str:
        return "/".join(name for name, *_ in self.open)

    def outside(self, named: bool = True) -> bool:
        """Whether this place is in no article: below an element with such a role, or in a header that isn't an article's own. Without named, classes and ids don't count."""
        main = False
        for _, part, _ in self.open:
            if part == "out" or (named and part == "named") or (part == "header" and not main):
                return True
            main |= part == "main"
        return False

    def main(self) -> int:
        """The number of the outermost marked article here; 0: none."""
        return next((n for _, part, n in self.open if part == "main"), 0)

    def named(self) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """The numbers of the elements that their class or id puts outside of articles: around the outermost marked article, and in it."""
        at = next((k for k, (_, part, _) in enumerate(self.open) if part == "main"), len(self.open))
        return tuple(n for _, part, n in self.open[:at] if part == "named"), tuple(n for _, part, n in self.open[at:] if part == "named")
