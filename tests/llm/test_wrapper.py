import functools
import random

import pytest

from tarnwell.llm import wrapper as W

CFG = W.WrapperConfig()
SCHEMA = "page_id long, url string, html string, host string, reference string, constant string"


def best(a, i, b, j):
    """Simple tree matching by its definition."""

    @functools.cache
    def st(i, j):
        if a.label[i] != b.label[j]:
            return 0
        x, y = a.kids[i], b.kids[j]
        m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for p in range(1, len(x) + 1):
            for q in range(1, len(y) + 1):
                m[p][q] = max(m[p - 1][q], m[p][q - 1], m[p - 1][q - 1] + st(x[p - 1], y[q - 1]))
        return 1 + m[-1][-1]

    return st(i, j)


def tree(r, depth=0):
    if depth > 3 or r.random() < 0.3:
        return r.choice(["text", "<br>", "more"])
    t = r.choice(["div", "p", "ul", "li", "span", "div class=x"])
    return f"<{t}>" + "".join(tree(r, depth + 1) for _ in range(r.randrange(5))) + f"</{t.split()[0]}>"


def test_matching_is_the_largest_mapping():
    r = random.Random(5)
    m = W.Matcher()
    for _ in range(150):
        a, b = W.Page(tree(r) + tree(r), CFG), W.Page(tree(r) + tree(r), CFG)
        pairs = m.mapping(a, b)
        assert len(pairs) == best(a, 0, b, 0) == m.align(a, 0, b, 0)[0]
        assert all(a.label[i] == b.label[j] for i, j in pairs.items()) and len(set(pairs.values())) == len(pairs)


def test_long_lists_divide():
    a, b = W.Page("<p>x</p><i>y</i>" * 1600, CFG), W.Page("<i>y</i><p>x</p><b>z</b>" * 1500, CFG)
    assert len(W.Matcher().mapping(a, b)) > 4500


def site(n=12):
    return [(i, f"http://Example.com/{i}", f"<html><head><title>T{i}</title><style>p{{}}</style></head><body><div class=top>Welcome to the site</div><nav><a>Home</a></nav><article><h1>Title {i}</h1>" + "".join(f"<p>Paragraph {k} of page {i} <b>bold {i}</b>" for k in range(1 + i % 4)) + "</article><div class=bottom>All rights reserved</div></body></html>") for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", "own", "own") for r in rows], SCHEMA)


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_template_goes_and_content_stays(spark, broadcast):
    got = {r.page_id: r for r in W.extract(frame(spark, site()), W.WrapperConfig(broadcast_bytes=broadcast)).collect()}
    assert len(got) == 12
    for i, r in got.items():
        assert r.host == "example.com" and r.title == f"T{i}"
        assert r.content.split("\n") == [f"Title {i}", *[f"Paragraph {k} of page {i} bold {i}" for k in range(1 + i % 4)]]


def test_each_kind_of_page_has_its_template(spark):
    articles = [(i, f"http://s.org/{i}", f"<html><body><div class=head>Site name</div><article><h1>Title {i}</h1><p>Text {i}</p></article><div class=share>Share this article</div></body></html>") for i in range(12)]
    lists = [(100 + i, f"http://s.org/l{i}", "<html><body><div class=head>Site name</div><ul class=list>" + "".join(f"<li>Item {i} {k}" for k in range(3)) + "</ul><div class=sort>Sort by date</div></body></html>") for i in range(8)]
    got = {r.page_id: r.content for r in W.extract(frame(spark, articles + lists)).collect()}
    assert all(got[i] == f"Title {i}\nText {i}" for i in range(12)) and all(got[100 + i] == "\n".join(f"Item {i} {k}" for k in range(3)) for i in range(8))


def test_a_second_reference_knows_what_the_first_lacks(spark):
    page = lambda i: f"<html><body><div class=a><p>Text {i}</p>" + ("" if i == 0 else "<p>Subscribe now</p>") + "</div></body></html>"
    got = {r.page_id: r.content for r in W.extract(frame(spark, [(i, f"http://s.org/{i}", page(i)) for i in range(12)])).collect()}
    assert all(got[i] == f"Text {i}" for i in range(12))


def test_forms_and_asides_are_judged_like_all_else(spark):
    page = lambda i: f"<html><body><form><nav><a>Home</a></nav><div><p>Text {i}</p></div><aside>Note {i}</aside><button>Send</button></form></body></html>"
    got = {r.page_id: r.content for r in W.extract(frame(spark, [(i, f"http://s.org/{i}", page(i)) for i in range(6)])).collect()}
    assert all(got[i] == f"Text {i}\nNote {i}" for i in range(6))


def test_copies_of_one_page_keep_their_content(spark):
    rows = [(1, "http://s.org/1", "<p>same words</p>")] * 3 + [(2, "http://s.org/2", "<p>same words</p>")]
    assert {r.content for r in W.extract(frame(spark, rows)).collect()} == {"same words"}


def test_awkward_rows(spark):
    deep = "<div>" * 3000 + "inside" + "</div>" * 3000
    rows = site(4) + [(None, None, None), (90, "no url", "<p>a<p>b</div></p>"), (91, "http://alone.org", "<p>only page</p>"), (92, "http://example.com/x", None), (93, "http://deep.org/", deep), (94, "http://deep.org/1", "<p>" * 2000), (95, "http://e.org", ""), (None, "http://example.com/y", site(1)[0][2]), *site(1), (96, "http://big.org/", "<p>word</p>" * 30_000)]
    got = W.extract(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got if r.page_id is not None}
    assert by[90].content == "a\nb" and by[91].content == "only page" and by[92].content == "" and by[93].content == "inside" and by[95].content == "" and by[96].content.count("word") == 30_000
    assert W.extract(frame(spark, site(1)).limit(0)).collect() == []
