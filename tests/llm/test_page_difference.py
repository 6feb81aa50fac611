"""Page lines by hand, alignment against a plain table, main text against a brute-force version."""

import random
from urllib.parse import urlsplit

import pytest

from hybridq.llm import page_difference as D
from hybridq.llm.page_lines import ARTICLE, FURNITURE, MAIN, OPEN, page_lines


def text(html):
    lines, kinds = page_lines(html)
    return " ".join(x for x, k in zip(lines, kinds) if k == D.main_kind(kinds))


@pytest.mark.parametrize(
    "html,want",
    [
        ("", ""),
        ("<p>just <b>t</b>ext", "just text"),
        ("<nav>menu</nav><article><h1>T</h1><p>a<br>b<p>c</article><footer>f", "T a b c"),
        ("<article>a<script>if (x < '</p>') y()</script>b<style>p{}</style><!-- <p>no --> c</article>", "a b c"),
        ("<article>x &amp;amp; &lt;b&gt; &eacute;&#8364;&nbsp;\n\t y 1 < 2</article>", "x &amp; <b> é€ y 1 < 2"),
        ("<main><h1>m</h1><article>a</article><article class='comment'>c</article></main>", "a"),
        ("<main><header><h1>m</h1></header><p>t</p><aside>s</aside></main><header>h</header>", "m t"),
        ("<article><header><h1>T</h1></header><p>x</p><footer>by</footer></article>", "T x"),
        ("<article>a <span class='ad'><span>buy</span> now</span> b</article>", "a b"),
        ("<article>a<div class='share-buttons'>s</div><div id=comments><p>c</div><form><label>q</label></form>b</article>", "a b"),
        ("<div class='content-sidebar-wrap'><article>a</article><div class='left-sidebar'>s</div></div>", "a"),
        ("<body class='no-sidebar'><div class='cookie-notice'><p>We use</div><p>body", "body"),
        ("<form id=aspnet><nav>n</nav><main>m</main></form>", "m"),
        ("<div role=navigation>n</div><div role='main'>m</div>", "m"),
        ("<article><p class=notice>n<p>a</article>", "a"),
        ("<article>a</article", "a"),
        ("<article>a<!-- never closed", "a"),
        ("<article>a<p title='x > y'>b</article>", "a b"),
        ("<html><head><title>T</title><p>no body tag", "no body tag"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>c<td>d</table></article>", "one two c d"),
        ("</div></p><article></span>a</b></article></article>", "a"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
    ],
)
def test_lines_by_hand(html, want):
    assert text(html) == want


@pytest.mark.parametrize(
    "piece", ["<", "<a href=\"x", "<!--", "<div>", "<script>", "<p class=ad>", "<a title='", "</span>", "<span class=ad></b>", "&", "<b class=ad><div>"]
)
def test_broken_markup_is_linear(piece):
    page_lines(piece * 60_000 + "x" * 1_000_000)


def length(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("seed", range(40))
@pytest.mark.parametrize("table_bits", [D.TABLE_BITS, 8])
def test_alignment(seed, table_bits):
    rnd = random.Random(seed)
    a, b = ([rnd.randrange(seed % 6 + 2) for _ in range(rnd.randrange(40))] for _ in range(2))
    pairs = D.common_lines(a, b, table_bits)
    assert len(pairs) == length(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def brute(pages):
    """{(page_id, url): (text, n_shared)} by the rules of main_text, pair by pair."""
    read = {}
    for page, url, html in pages:
        u = urlsplit(url or "")
        read[page, url] = (u.netloc.lower(), u.path if u.netloc else "", page_lines(html or ""))
    first = {}
    for host, path, (lines, kinds) in read.values():
        if lines:
            content = D.hashlib.blake2b(D._line_hashes(lines) + bytes(kinds), digest_size=16).digest()
            key = (host, content)
            first[key] = min(first.get(key, (path, lines, kinds)), (path, lines, kinds))
    order = sorted((host, path, content, lines, kinds) for (host, content), (path, lines, kinds) in first.items())
    shared = {}
    for i, (host, path, content, lines, kinds) in enumerate(order):
        options = []
        for j in (i - 1, i + 1):
            if 0 <= j < len(order) and order[j][0] == host:
                other = order[j]
                # pairs are aligned in their order
                pairs = D.common_lines(other[3], lines) if j < i else D.common_lines(lines, other[3])
                pairs = [p[::-1] for p in pairs] if j < i else pairs
                size = [sum(len(x) for x, k in zip(ls, ks) if k != FURNITURE) for ls, ks in ((lines, kinds), other[3:])]
                same = sum(len(lines[p]) for p, q in pairs if kinds[p] != FURNITURE and other[4][q] != FURNITURE)
                copy = same > 0 and same >= D.NEAR_COPY * min(size)
                options.append((not copy, D.nearness(path, other[1]), j < i, {p for p, _ in pairs}))
        if options and max(options, key=lambda o: o[:3])[0]:
            shared[host, content] = max(options, key=lambda o: o[:3])[3]
    out = {}
    for key, (host, path, (lines, kinds)) in read.items():
        content = D.hashlib.blake2b(D._line_hashes(lines) + bytes(kinds), digest_size=16).digest()
        mine, best = shared.get((host, content), set()), D.main_kind(kinds)
        gone = {i for i in mine if kinds[i] != best or best == OPEN}
        out[key] = (" ".join(x for i, (x, k) in enumerate(zip(lines, kinds)) if k == best and i not in gone), len(gone))
    return out


def site(seed):
    rnd = random.Random(seed)
    say = lambda n: " ".join(rnd.choice("abcdefghij") + str(rnd.randrange(50)) for _ in range(n))
    pages = []
    for host in ["a.example", "b.example", "A.example", None]:
        top, bottom = say(6), say(5)
        for _ in range(40 if host == "a.example" else 7):
            url = host and f"https://{host}/{rnd.choice('xy')}/{rnd.randrange(60)}{rnd.choice(['', '/', '.html', '?p=2', '#top'])}"
            body = "".join(f"<p>{say(8)}</p>" for _ in range(rnd.randrange(4)))
            style = rnd.randrange(4)
            if style == 0:
                body = f"<article>{body}<p>{bottom}</p></article>"
            elif style == 1:
                body = f"<div class=promo>{say(2)}</div><p>{body}"
            pages.append((len(pages), url, f"<div>{top}</div><nav><ul><li>{say(1)}<li>home</ul></nav>{body}<div>{bottom}</div>"))
    copied = pages[3][2]
    pages += [(900 + i, f"https://a.example/x/{i}", copied) for i in range(50)]  # equal pages
    near = "".join(f"<p>{say(9)}</p>" for _ in range(5))
    pages += [(1000 + i, f"https://c.example/x/{i}", f"<div>{near}</div><p>{i}") for i in range(30)]  # near copies
    return pages + [(2000, "no url", "<p>alone"), (2001, "", ""), (2002, "https://d.example/", None), (2003, "//e.example/p", "<p>w" + "w" * 3_000_000)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    pages = site(seed)
    schema = "page_id long, url string, html string, row long, text string, kinds int, host string"
    frame = spark.createDataFrame([(*p, 1, "t", 2, "h") for p in pages], schema).repartition(6)
    found = D.main_text(frame)
    assert found.columns == ["page_id", "url", "text", "n_chars", "n_shared"]
    got = {(r.page_id, r.url): (r.text, r.n_shared) for r in found.collect()}
    want = brute(pages)
    assert got == want
    assert all(r.n_chars == len(r.text) for r in found.collect())
    assert sum(n for _, n in want.values()) > 20
    assert all(t.split()[-1] == str(p - 1000) and len(t.split()) == 46 for (p, _), (t, _) in want.items() if 1000 <= p < 1030)


def test_template_goes_without_any_markup(spark):
    """Two unmarked pages of one host keep what is their own."""
    page = "<div>Site name</div><div>{}</div><div>All rights reserved</div>"
    rows = [(1, "https://h/a/1", page.format("first text")), (2, "https://h/a/2", page.format("second text")), (None, "https://h/a/2", page.format("second text"))]
    got = D.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_shared) for r in got) == [(0, "second text", 2), (1, "first text", 2), (2, "second text", 2)]


def test_odd_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert D.main_text(none).collect() == []
    same = spark.createDataFrame([(None, None, None)] * 3 + [(1, None, " ")] * 2, "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in D.main_text(same).collect()] == [("", 0)] * 5


def test_kinds():
    lines, kinds = page_lines("a<nav>b</nav><main>c<article>d</article></main>")
    assert (lines, kinds) == (["a", "b", "c", "d"], [OPEN, FURNITURE, MAIN, ARTICLE])
