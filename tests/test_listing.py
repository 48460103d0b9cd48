"""Lists of posts by selectors: the matcher, every site's spec, places over pages, and the query against a plain parser."""

from datetime import datetime
from html import unescape
import re

import pytest
from pyspark.sql import functions as F

from tidemark.plans.registry import QUERIES
from tidemark.session import table
from tidemark.sources import listing, selectors

PAGE = """
<html><body><div id="top" class="a b"><p>one</p><p class="x">two <b>bold</b></p><span data-k="abc">three</span></div>
<ul class="list"><li class="notice"><a href="/n">note</a></li><li><a href="/1" title="t">first</a><i>9</i></li><li><a href="/2">second<br>line</a></li><li>none</li></ul>
<table><tr><td class="n">1</td><td class="n">2</td><td class="n">3</td></tr></table><script>var x = "<p>";</script><p>last
"""


@pytest.mark.parametrize("selector, texts", [
    ("p", ["one", "two  bold", "last\n"]), ("div p.x", ["two  bold"]), ("#top > span", ["three"]), (".a.b > p", ["one", "two  bold"]), ("body > p", ["last\n"]),
    ('span[data-k="abc"]', ["three"]), ('[data-k^="ab"]', ["three"]), ('[data-k*="bc"]', ["three"]), ('[data-k="ab"]', []), ("a[title]", ["first"]), ('a[title^=""]', []),
    ("ul.list li:not(.notice) a", ["first", "second line"]), ("li:has(i) a", ["first"]), ("li:not(:has(a))", ["none"]), ("p:first-of-type", ["one", "last\n"]),
    ("li:last-child", ["none"]), ("td.n + td.n", ["2", "3"]), ("td.n + td.n + td.n", ["3"]), ("i, b", ["bold", "9"]), ("ul a , td", ["note", "first", "second line", "1", "2", "3"]), ("*.x", ["two  bold"]), ("h1", []),
])
def test_selectors(selector, texts):
    assert [e.text() for e in selectors.select(selectors.page(PAGE), selector)] == texts


@pytest.mark.parametrize("selector", ["", "a >", "a:hover", "> a", "a[b=c]", "a,,b", "::before"])
def test_other_selectors_are_refused(selector):
    with pytest.raises(ValueError):
        selectors.compiled(selector)


def test_scope_and_text():
    root = selectors.page(PAGE)
    row = selectors.first(root, "ul")
    assert selectors.first(row, "body li a").attrs["href"] == "/n"  # what stands before may lie outside
    second = selectors.first(root, "p.x")
    assert second.text(frozenset(selectors.select(second, "b"))).strip() == "two"
    assert selectors.first(root, "script").tag == "script" and "<p>" not in root.text()
    assert selectors.page("</div><b>x</i></b>y").text() == "x y"


def markup(tag_classes, inner="", **attrs):
    tag, *classes = tag_classes.split(".")
    more = "".join(f' {k}="{v}"' for k, v in attrs.items())
    return f"<{tag} class=\"{' '.join(classes)}\"{more}>{inner}</{tag}>"


def site_row(source, i):
    """A row as a site writes it, by hand for each kind."""
    title, at = f"post {source} number {i}", f"2026.10.0{i % 9 + 1}"
    rows = {
        "clien": f'<div class="list_item"><a class="list_subject" href="/p/{i}"><span class="subject_fixed">{title}</span></a><div class="list_hit"><span class="hit">1.2k</span></div><div class="list_symph"><span>3</span></div><div class="list_time"><span class="timestamp">2026-10-0{i % 9 + 1} 11:22:33</span></div></div>',
        "dcinside": f'<tr class="ub-content us-post"><td class="gall_tit"><a href="/b/{i}">{title}</a><a class="reply_numbox" href="#">[3]</a></td><td class="gall_date" title="2026-10-0{i % 9 + 1} 11:22:33">11:22</td><td class="gall_count">1,200</td><td class="gall_recommend">3</td></tr>',
        "ppomppu": f'<tr class="baseList"><td><a class="baseList-title" href="/z/{i}">{title}<span class="list_comment2">[55]</span></a></td><td class="board_date">{at}</td><td class="board_date">3 - 1</td><td class="board_date">1200</td></tr>',
        "etoland": f'<a class="row grid-cols-[21px_1fr]" href="/e/{i}"><b>{i}</b><span class="subject">{title}</span></a>',
        "ygosu": f'<tr><td class="tit"><a href="/y/{i}"><span class="category">x</span>{title}<span class="reply_cnt">(4)</span></a></td><td class="read">1200</td><td class="vote">3</td><td class="date">{at}</td></tr>',
        "dogdrip": f'<li class="webzine"><a class="title-link" href="/d/{i}">{title}</a><div class="list-meta"><span class="margin-right-xsmall"><span class="text-primary">3</span></span><span class="text-muted">{at}</span></div></li>',
        "natekorea": f'<ul><li><dl><dt><h2><a href="/talk/{i}">{title}</a></h2></dt><dd class="txt">{"body " * 40}</dd><dd class="info"><span class="count">조회 1,200</span><span class="rcm">추천 3</span></dd></dl></li></ul>',
    }
    wrap = {"dcinside": '<table class="gall_list"><tbody>{}</tbody></table>', "ygosu": '<table class="bd_list"><tbody>{}<tr><td class="bdname">ad</td><td class="tit"><a href="/ad">an advertisement</a></td></tr></tbody></table>', "natekorea": '<div class="cntList">{}</div>'}
    return rows[source], wrap.get(source, "{}")


SOURCES = ("clien", "dcinside", "ppomppu", "etoland", "ygosu", "dogdrip", "natekorea")
AS_OF = datetime(2026, 10, 12, 9)


def site_page(source, numbers):
    made = [site_row(source, i) for i in numbers]
    return f"<html><body>{(made[0][1] if made else '{}').format(''.join(m[0] for m in made))}</body></html>"


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "source string, page_no int, url string, html string, status int")


def read(spark, rows):
    posts, status = listing.listed(pages_of(spark, rows), listing.specs(spark), F.lit(AS_OF).cast("timestamp_ntz"))
    return sorted(posts.collect(), key=lambda r: (r.source, r.place)), {r.source: (r.status, r.why, r.n) for r in status.collect()}


def test_every_spec_compiles():
    assert len(listing.SPECS) == len(listing.LISTS) == 17 and {s[0] for s in listing.SPECS} == set(listing.LISTS)
    for spec in listing.SPECS:
        for part in (*spec[1:8], spec[9]):
            assert part is None or selectors.compiled(part)


def test_sites(spark):
    posts, status = read(spark, [(s, 0, listing.LISTS[s][0], site_page(s, range(3)), 200) for s in SOURCES])
    for s in SOURCES:
        mine = [p for p in posts if p.source == s]
        assert [p.title for p in mine] == [f"post {s} number {i}" for i in range(3)] and [p.place for p in mine] == [0, 1, 2]
        assert all(p.url.startswith(listing.LISTS[s][0].split("/")[0] + "//" + listing.LISTS[s][0].split("/")[2]) for p in mine)
        assert status[s] == ("ok", "", 3)
    by = {s: next(p for p in posts if p.source == s and p.place == 1) for s in SOURCES}
    assert {s: by[s].views for s in SOURCES} == {"clien": 1200, "dcinside": 1200, "ppomppu": 1200, "etoland": 0, "ygosu": 1200, "dogdrip": 0, "natekorea": 1200}
    assert {s: by[s].likes for s in SOURCES} == {"clien": 3, "dcinside": 3, "ppomppu": 3, "etoland": 0, "ygosu": 3, "dogdrip": 3, "natekorea": 3}
    assert by["dcinside"].event_ts == datetime(2026, 10, 2, 11, 22, 33) and str(by["ppomppu"].event_date) == "2026-10-02" and by["etoland"].event_date is None
    assert len(by["natekorea"].summary) == 131 and by["natekorea"].position == 98.5


def test_places_do_not_depend_on_how_pages_are_cut(spark):
    url = listing.LISTS["clien"][0]
    one, _ = read(spark, [("clien", 0, url, site_page("clien", range(12)), 200)])
    for cuts in ((5,), (1, 2, 11), tuple(range(1, 12))):
        edges = [0, *cuts, 12]
        several, status = read(spark, [("clien", k, url, site_page("clien", range(a, b)), 200) for k, (a, b) in enumerate(zip(edges, edges[1:]))])
        assert [(p.title, p.place, p.position) for p in several] == [(p.title, p.place, p.position) for p in one] and status["clien"] == ("ok", "", 12)


def test_reading_ends_at_the_first_page_without_posts(spark):
    url = listing.LISTS["clien"][0]
    full = lambda k: ("clien", k, url, site_page("clien", range(3 * k, 3 * k + 3)), 200)
    for bad, why in [
        (("clien", 1, url, "<p>Just a moment...</p>", 200), "blocked: Just a moment"), (("clien", 1, url, "<p>empty</p>", 200), "blocked: no rows"), (("clien", 1, url, None, 200), "blocked: no rows"),
        (("clien", 1, url, site_page("clien", range(3)), 403), "blocked: HTTP 403"), (("clien", 1, url, "x", 502), "error: HTTP 502"), (("clien", 1, url, None, None), "error: no answer"),
        (("clien", 1, "https://x.com/msg.html", site_page("clien", range(3)), 200), "blocked: msg.html"),
    ]:
        posts, status = read(spark, [full(0), bad, full(2)])
        assert len(posts) == 3 and status["clien"] == ("ok", why, 3)
        posts, status = read(spark, [(*bad[:1], 0, *bad[2:]), full(2)])
        assert posts == [] and status["clien"] == (why.split(":")[0], why, 0)


def test_what_is_no_post_has_no_place(spark):
    row = lambda title, href: f'<div class="list_item"><a class="list_subject" href="{href}"><span class="subject_fixed">{title}</span></a></div>'
    html = row("[공지] read me first", "/1") + row("abc", "/2") + row("good one [12]", "/3") + row("[19]", "/4") + row("comments here", "/5#comment") + row("mail to me", "mailto:x@y") + row("ads ads ads", "/event/6") + row("", "/7") + row("good two", "http://[bad") + row("good three", " /8 ")
    posts, _ = read(spark, [("clien", 0, "https://www.clien.net/list", html, 200), ("elsewhere", 0, "https://a.b/", html, 200)])
    assert [(p.title, p.url, p.place) for p in posts] == [("good one", "https://www.clien.net/3", 0), ("good three", "https://www.clien.net/8", 1)]
    assert read(spark, []) == ([], {})


def test_query_against_a_plain_parser(spark):
    sf_dir = "/root/testdata/sf0.001"
    by_host: dict = {}
    for r in table(spark, sf_dir, "pages").orderBy("page_id").collect():
        host = (re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", r.url or "") or [None, ""])[1].lower()
        by_host.setdefault(host, []).append(r)
    want = set()
    for host, pages in by_host.items():
        place = 0
        for r in pages:
            links = [(h, " ".join(unescape(t).split())) for h, t in re.findall(r'<li><a href="([^"]*)">([^<]*)</a></li>', r.html or "")]
            links = [(unescape(h), t) for h, t in links if len(t) >= 4]
            if not links:
                break
            want |= {(host, r.page_id, place + i, t) for i, (_, t) in enumerate(links)}
            place += len(links)
    got = {(r.source, r.page_id, r.place, r.title) for r in QUERIES["listed_rows"](spark, sf_dir).collect()}
    assert got == want and len(got) > 20
