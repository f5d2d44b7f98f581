"""A page as a tree of blocks: which text stands where, and whether its region can hold content."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: A start tag that ends an open one, and what stops the search for it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"ul", "ol", "dl", "table", "body", "html", "article", "section", "div", "select"}
#: Regions that hold no main text: by tag, by a name of class or id, and by role. A name counts if one
#: of its words is of the first list and all others are of the second (``site-footer``, not ``no-sidebar``).
APART = {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset"}
APART_WORDS = {
    "nav", "navbar", "navigation", "menu", "sidebar", "aside", "footer", "masthead", "topbar", "banner", "ad", "ads", "adbox", "advert",
    "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice",
    "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "search", "share", "sharing", "social",
    "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "comment", "comments", "disqus", "reply", "replies",
    "respond", "discussion", "feedback", "toolbar", "widget", "copyright", "disclaimer", "skip", "hidden",
}
PLACE_WORDS = {
    "site", "page", "main", "global", "top", "bottom", "left", "right", "header", "head", "primary", "secondary", "mobile", "desktop", "sticky",
    "fixed", "box", "wrap", "wrapper", "container", "block", "list", "section", "area", "bar", "slot", "unit", "panel", "region", "links", "link",
    "item", "items", "group", "inner", "outer", "post", "article", "form", "message", "policy", "banner", "js", "the",
}
#: Of those tags the ones that stay apart whatever lies in them.
ALWAYS_APART = APART - {"form"}
#: A form with at most so many characters of text that is no label is apart.
FORM_TEXT = 300
FIELDS = {"input", "select", "textarea", "button"}
APART_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
#: Blocks that are nested deeper are listed at this depth.
DEEPEST = 100
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Node:
    label: str
    depth: int
    above: Node | None
    zone: int  # 2 inside an article, 1 inside the main part, else 0
    tag: str = ""
    marked: bool = False  # told apart by tag, name or role
    hidden: bool = False
    holds_zone: bool = False  # outside of zones, and the main part or an article lies in it
    fields: int = 0  # of a form, without hidden ones
    letters: int = 0  # of all text in a form
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def apart(self, letters: int) -> bool:
        """Whether it holds no main text, on a page of so many letters.

        That is hidden, or told apart without the main part in it. A form is apart only if it
        has little text; outside of the main part it also needs fields, and not most of the page's text.
        """
        if self.hidden:
            return True
        if not self.marked or (self.holds_zone and self.tag not in ALWAYS_APART):
            return False
        if self.tag != "form" or self.letters > FORM_TEXT:
            return self.tag != "form"
        return self.zone > 0 or (self.fields > 0 and 2 * self.letters <= letters)


@dataclass
class Page:
    """``skeleton``: a line ``depth label`` for each block, ``depth #`` for each text.

    ``texts``: content of the page's highest zone, else None. ``around``: content of the other zones, else None.
    """

    skeleton: str
    texts: list[str | None]
    around: list[str | None]
    everything: list[str]


def attributes(raw: str) -> dict[str, str]:
    return {name.lower(): html.unescape(value.strip("\"'")) for name, value in ATTRIBUTE.findall(raw)} if raw.strip(" /") else {}


def tells_apart(name: str) -> bool:
    """Whether a name of class or id is that of a region apart."""
    words = {w.lower() for w in WORD.findall(name)}
    return bool(words & APART_WORDS) and words <= APART_WORDS | PLACE_WORDS | {w for w in words if w.isdigit()}


def is_marked(tag: str, attrs: dict[str, str], zone: int) -> bool:
    if tag in APART or (tag == "header" and zone < 2):
        return True
    if tag in ("html", "body", "main"):
        return False
    if attrs.get("role", "").lower() in APART_ROLES:
        return True
    return any(map(tells_apart, f"{attrs.get('class', '')} {attrs.get('id', '')}".split()))


def is_hidden(tag: str, attrs: dict[str, str]) -> bool:
    if tag in ("html", "body"):
        return False
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))


def parse(source: str | None) -> Page:
    """The blocks of a page in order. Unclosed tags end with the block that holds them."""
    source = source or ""
    stack = [Node("", 0, None, 0)]
    lines: list[str] = []
    texts: list[tuple[Node, str, bool]] = []
    forms: list[Node] = []
    links = 0
    at = 0

    def line(depth: int, label: str) -> None:
        lines.append(f"{min(depth, DEEPEST)} {label}")

    def flush() -> None:
        top = stack[-1]
        text = " ".join(html.unescape("".join(top.parts)).split())
        if text:
            line(top.depth + 1, "#")
            only_links = top.linked * 10 >= 8 * sum(map(len, top.parts)) and top.tag not in ("p", "h1", "h2", "h3", "blockquote", "pre")
            texts.append((top, text, only_links))
            for form in forms:
                form.letters += len(text)
        top.parts, top.linked = [], 0

    def leave() -> None:
        node = stack.pop()
        if forms and forms[-1] is node:
            forms.pop()

    def add(text: str) -> None:
        if text:
            stack[-1].parts.append(text)
            if links:
                stack[-1].linked += len(text)

    def close(tags: set[str], fences: set[str]) -> None:
        for place in range(len(stack) - 1, 0, -1):
            if stack[place].tag in tags:
                while len(stack) > place:
                    flush()
                    leave()
                return
            if stack[place].tag in fences:
                return

    while found := TOKEN.search(source, at):
        add(source[at : found.start()])
        at = found.end()
        if found["tag"] is None:
            continue
        tag, opens = found["tag"].lower(), not found["close"]
        if opens and tag in RAW:
            if not found["attrs"].endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            continue
        if tag in INLINE:
            if tag == "a":
                links = 1 if opens else 0
            elif tag == "br":
                add(" ")
            continue
        links = 0
        if not opens:
            close({tag}, set())
            continue
        close({"p"}, FENCES)
        if tag in ENDS:
            close(ENDS[tag], FENCES)
        flush()
        attrs, above = attributes(found["attrs"]), stack[-1]
        if tag in FIELDS and attrs.get("type", "").lower() != "hidden":
            for form in forms:
                form.fields += 1
        if tag in VOID:
            continue
        marked = is_marked(tag, attrs, above.zone)
        own = 2 if tag == "article" and not marked else 1 if tag == "main" or attrs.get("role") == "main" else 0
        for node in reversed(stack if own else ()):
            if node.holds_zone:
                break
            node.holds_zone = node.zone == 0
        label = ".".join([tag, *attrs.get("class", "").split()])
        line(above.depth + 1, label)
        stack.append(Node(label, above.depth + 1, above, max(above.zone, own), tag, marked and not own, is_hidden(tag, attrs)))
        if tag == "form":
            forms.append(stack[-1])
        if found["attrs"].endswith("/"):
            leave()
    add(source[at:])
    while stack:
        flush()
        leave()
    # Links alone are a menu outside the zones; inside they are content, such as references.
    letters = sum(len(text) for _, text, _ in texts)
    told: dict[int, bool] = {}

    def inside(node: Node | None) -> bool:
        """Whether the node lies in a region apart; each node is asked once."""
        way = []
        while node is not None and id(node) not in told:
            way.append(node)
            node = node.above
        known = node is not None and told[id(node)]
        for one in reversed(way):
            known = told[id(one)] = known or one.apart(letters)
        return known

    content = [not inside(node) and (node.zone > 0 or not only_links) for node, _, only_links in texts]
    zone = max((node.zone for (node, *_), good in zip(texts, content) if good), default=0)
    inner = [text if good and node.zone == zone else None for (node, text, _), good in zip(texts, content)]
    around = [text if good and node.zone != zone else None for (node, text, _), good in zip(texts, content)]
    return Page("\n".join(lines), inner, around, [text for _, text, _ in texts])
