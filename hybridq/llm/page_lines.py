"""HTML as lines of text, each with the part of the page it stands in.

A single pass over the markup, linear in its length: comments, scripts and styles are skipped, block
elements and line breaks end a line, character references are decoded and white space becomes one space.
Broken markup is read as browsers read it: an end tag closes what is open inside its
element, unknown end tags and unclosed inline elements change nothing.
"""

from __future__ import annotations

import html as entities
import re

#: What a line stands in: nothing that says so, page furniture, a main element, an article.
OPEN, FURNITURE, MAIN, ARTICLE = 0, 1, 2, 3
#: Furniture by a hint only, which an article or a main element inside it overrules.
HINTED = 4

# Element names and words of class, id and role attributes, by what they hold.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre "
    "script search section select style summary table tbody td template textarea tfoot th thead title tr ul".split()
)
#: Elements whose end is usually left out; they matter only where they are marked.
LOOSE = set("p li dt dd option tr td th".split())
CONTAINERS = BLOCKS - VOID - RAW - LOOSE - {"html", "body"} - set("h1 h2 h3 h4 h5 h6 pre caption summary legend address".split())
FURNITURE_TAGS = set("aside button dialog fieldset footer head menu nav noscript object search select svg template canvas audio video".split())
HEAD_TAGS = set("base link meta noscript script style template title".split())
ROLES = {
    "main": MAIN, "article": ARTICLE,
    **dict.fromkeys("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split(), FURNITURE),
}
WORDS = set(
    "ad ads adbox adsense advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion promotions "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe "
    "subscription signup login paywall sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager "
    "footer comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations "
    "search form copyright".split()
)
#: Only outside of articles and main elements, where they can't be a heading.
OUTER_WORDS = {"header", "masthead", "banner", "topbar"}
NOT_WORDS = {"no", "has", "with", "without", "not", "hide", "non"}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")


def hinted(name: str, text: str, kind: int) -> int | None:
    """What class, id and role of an element say, if anything."""
    found = None
    for m in ATTRIBUTE.finditer(text):
        value = m.group(2) or m.group(3) or m.group(4) or ""
        if m.group(1).lower() == "role":
            if (role := value.strip().lower()) in ROLES and not (role == "banner" and kind in (MAIN, ARTICLE)):
                return ROLES[role]
            continue
        for token in value.split():
            words = [w.lower() for w in CAMEL.findall(token)]
            if not words or words[0] in NOT_WORDS:
                continue
            for i, w in enumerate(words):
                if w in WORDS or (w in OUTER_WORDS and kind not in (MAIN, ARTICLE)):
                    # the last word names the thing: "left-sidebar" is one, "sidebar-layout" only has one
                    found = FURNITURE if i == len(words) - 1 or found == FURNITURE else HINTED
    return found


def marked(name: str, text: str, kind: int) -> int | None:
    """The part of the page that an element opens, or None if it opens none."""
    if kind == FURNITURE:
        return None
    hint = hinted(name, text, kind) if text and name not in ("html", "body", "main") else None
    if name in ("article", "main"):
        if hint == FURNITURE and name == "article":
            return FURNITURE  # a reader's comment, say
        return ARTICLE if name == "article" or kind == ARTICLE else MAIN
    if name in FURNITURE_TAGS or (name == "header" and kind not in (MAIN, ARTICLE)):
        return FURNITURE
    if kind == HINTED:
        return hint if hint in (MAIN, ARTICLE, FURNITURE) else None
    if name == "form":
        return HINTED
    if hint == MAIN and kind == ARTICLE:
        return None
    return hint


class _Reader:
    def __init__(self):
        self.lines: list[str] = []
        self.kinds: list[int] = []
        self.buffer: list[str] = []
        self.kind = OPEN
        self.stack: list[tuple[str, int]] = []
        #: Places in the stack of each open element, and of all open containers.
        self.open: dict[str, list[int]] = {}
        self.containers: list[int] = []

    def end_line(self):
        if self.buffer:
            line = " ".join(entities.unescape("".join(self.buffer)).split())
            if line:
                self.lines.append(line)
                self.kinds.append(FURNITURE if self.kind == HINTED else self.kind)
            self.buffer.clear()

    def push(self, name: str, kind: int):
        self.open.setdefault(name, []).append(len(self.stack))
        if name in CONTAINERS:
            self.containers.append(len(self.stack))
        self.stack.append((name, self.kind))
        self.kind = kind

    def pop(self):
        name, self.kind = self.stack.pop()
        self.open[name].pop()
        if name in CONTAINERS:
            self.containers.pop()

    def start(self, name: str, text: str):
        if name in BLOCKS:
            self.end_line()
            if self.stack and self.stack[-1][0] == "head" and name not in HEAD_TAGS:
                self.pop()
            while self.stack and (self.stack[-1][0] == "p" or (name in LOOSE and self.stack[-1][0] == name)):
                self.pop()
        if name in VOID or name in RAW:
            return
        mark = marked(name, text, self.kind)
        if mark is not None or name in CONTAINERS or self.open.get(name):
            if mark is not None:
                self.end_line()
            self.push(name, self.kind if mark is None else mark)

    def end(self, name: str):
        if name in BLOCKS:
            self.end_line()
        if not self.open.get(name):
            return
        if name not in CONTAINERS and self.containers and self.containers[-1] > self.open[name][-1]:
            return  # an inline end reaches no further than its block
        while True:
            if self.stack[-1][1] != self.kind:
                self.end_line()
            last = self.stack[-1][0]
            self.pop()
            if last == name:
                return


def page_lines(html: str) -> tuple[list[str], list[int]]:
    """(lines, part of the page of each line) in page order."""
    reader, at, size = _Reader(), 0, len(html)
    missing: set[str] = set()  # what is known not to come any more

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        place = html.find(what, start)
        if place < 0:
            missing.add(what)
        return place

    while at < size:
        tag = find("<", at)
        if tag < 0:
            reader.buffer.append(html[at:])
            break
        if tag > at:
            reader.buffer.append(html[at:tag])
        after = html[tag + 1 : tag + 2]
        if html.startswith("<!--", tag):
            # "<!-->" and "<!--->" are whole comments
            close = tag + 2 if html.startswith((">", "->"), tag + 4) else find("-->", tag + 4)
            at = size if close < 0 else html.index(">", close + 2) + 1
            continue
        if after in ("!", "?"):
            close = find(">", tag)
            at = size if close < 0 else close + 1
            continue
        closing = after == "/"
        name = NAME.match(html, tag + 1 + closing)
        if name is None:
            if closing:  # "</>" and the like are comments
                close = find(">", tag)
                at = size if close < 0 else close + 1
            else:
                reader.buffer.append("<")
                at = tag + 1
            continue
        close = _tag_end(html, name.end(), find)
        if close < 0:
            break  # a tag that never ends holds the rest
        word = name.group().lower()
        at = close + 1
        if closing:
            reader.end(word)
            continue
        reader.start(word, html[name.end() : close])
        if word in RAW:
            at = _raw_end(html, at, word, missing)
    reader.end_line()
    return reader.lines, reader.kinds


def _tag_end(html: str, at: int, find) -> int:
    """Place of the `>` that ends a tag; quoted values may hold others."""
    while True:
        m = STOP.search(html, at)
        if m is None:
            return -1
        if m.group() == ">":
            return m.start()
        at = m.end()
        if html[max(0, m.start() - 16) : m.start()].rstrip().endswith("="):
            quote = find(m.group(), at)
            at = at if quote < 0 else quote + 1


def _raw_end(html: str, at: int, word: str, missing: set[str]) -> int:
    """Place behind the end tag of an element whose content is no markup."""
    key = f"</{word}"
    if key not in missing:
        m = re.compile(rf"</{word}(?=[\s/>])", re.I).search(html, at)
        if m is not None:
            close = html.find(">", m.end())
            return len(html) if close < 0 else close + 1
        missing.add(key)
    return len(html)
