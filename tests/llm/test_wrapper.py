"""Alignment and template of web pages."""

import random

from setloom.llm import html_extraction as H


def aligned(a, b):
    pairs = []
    score = H.match(H.folded(H.parse(a)), H.folded(H.parse(b)), pairs)
    return score, [(x.text, y.text) for x, y in pairs]


def brute(a, b):
    """The best score by the textbook recursion."""
    if a.key != b.key:
        return 0
    if a.text is not None or b.text is not None:
        return 1 + (a.text == b.text)
    rows = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, p in enumerate(a.children):
        for j, q in enumerate(b.children):
            rows[i + 1][j + 1] = max(rows[i][j + 1], rows[i + 1][j], rows[i][j] + brute(p, q))
    return 1 + rows[-1][-1]


def test_an_extra_container_in_front_shifts_nothing():
    same = "<div><h2>About</h2><p>All of us</p></div><div><h3>Legal</h3><p>Rights</p></div>"
    _, pairs = aligned(f"<body><div><p>x</p><p>y</p></div>{same}</body>", f"<body><div><p>new</p><p>more</p></div><div><p>x</p><p>z</p></div>{same}</body>")
    assert {("About", "About"), ("All of us", "All of us"), ("Legal", "Legal"), ("Rights", "Rights"), ("x", "x")} <= set(pairs)


def test_long_lists_are_aligned(monkeypatch):
    x = [f"<p>{i}</p>" for i in range(2100)]
    y = ["<p>new</p>", "<p>newer</p>", *x[:1000], "<p>inside</p>", *x[1000:], "<p>end</p>"]
    assert len([1 for p, q in aligned("<h1>a</h1>" + "".join(x) + "<h1>c</h1>", "<h1>b</h1>" + "".join(y) + "<h1>d</h1>")[1] if p == q]) == 2100


def test_matching_is_best(monkeypatch):
    r = random.Random(5)

    def page(depth):
        return "".join(f"<p>{r.choice('abc')}</p>" if depth == 0 or r.random() < 0.4 else f"<{t}>{page(depth - 1)}</{t}>" for t in (r.choice(["div", "ul"]) for _ in range(r.randint(1, 4))))

    for cells in (4_000_000, 0):
        monkeypatch.setattr(H, "CELLS_AT_ONCE", cells)
        for _ in range(150):
            a, b = (H.folded(H.parse(page(3))) for _ in range(2))
            pairs = []
            assert H.match(a, b, pairs) == brute(a, b)
            for side, tree in ((0, a), (1, b)):
                place = {id(x): i for i, x in enumerate(H.leaves(tree))}
                at = [place[id(p[side])] for p in pairs]
                assert len(set(at)) == len(at)

def texts(spark, rows, **kw):
    return {r["page_id"]: r["text"] for r in H.html_extraction(spark.createDataFrame(rows, "page_id long, url string, html string"), **kw).collect()}


def test_small_hosts_and_much_boilerplate(spark):
    around = "".join(f"<div>Block {k}</div>" for k in range(9))
    rows = [(10 * h + i, f"http://h{h}.x/{i}", f"<body>{around}<h1>Head {h} {i}</h1><p>Body {h} {i}</p></body>") for h, n in ((1, 2), (2, 3), (3, 9)) for i in range(n)]
    assert texts(spark, rows) == {10 * h + i: f"Head {h} {i}\nBody {h} {i}" for h, n in ((1, 2), (2, 3), (3, 9)) for i in range(n)}


def test_template_that_the_least_page_lacks(spark):
    rows = [(i, f"http://h.x/{i}", f"<body><h1>Head {i}</h1><p>Body {i}</p>{'' if i == 0 else '<div><ul><li>About our site</li></ul></div><h3>Legal</h3>'}</body>") for i in range(5)]
    assert texts(spark, rows) == {i: f"Head {i}\nBody {i}" for i in range(5)}


def test_copies_vote_once(spark):
    rows = [(i, f"http://h.x/{i}", "<body><h1>Same</h1><p>Body</p></body>") for i in range(8)] + [(9, "http://h.x/9", "<body><h1>Other</h1><p>Text</p></body>")]
    assert texts(spark, rows) == {i: "Same\nBody" for i in range(8)} | {9: "Other\nText"}


def test_a_passage_of_two_pages_among_six_stays_content(spark):
    rows = [(i, f"http://h.x/{i}", f"<body><h1>Head {i}</h1><p>Body {i}</p>{'<p>Shared words</p>' if i < 2 else ''}</body>") for i in range(6)]
    assert texts(spark, rows)[1] == "Head 1\nBody 1\nShared words"


SF = "/root/testdata/sf0.01"


def test_the_wrapper_finds_the_article_without_tags_and_names(spark):
    """Menus, adverts and footers that change from page to page: only where the text is tells the article."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    plain = {r["page_id"]: r["text"] for r in H.html_extraction(pages).collect()}
    bare = pages.selectExpr("page_id", "url", "regexp_replace(regexp_replace(html, '(</?)(nav|article|footer)', '$1div'), ' class=.ad.', '') as html")
    rows = H.html_extraction(bare, named=False).collect()
    assert all(r["n_template"] > 0 for r in rows)
    assert sum(plain[r["page_id"]] == r["text"] for r in rows) >= 0.9 * len(rows)


def test_attribute_values_are_no_names(spark):
    rows = [(i, f"http://h{i}.x/", f"<body><article><h1>Head</h1>{p}</article></body>") for i, p in enumerate(['<div style="overflow: hidden"><p>Text</p></div>', '<div data-hidden="false"><p>Text</p></div>', '<div title="a hidden gem"><p>Text</p></div>', '<p class="related">Text</p>', '<p class="side share tags">Text</p>'])]
    rows += [(9, "http://h9.x/", '<body><article><h1>Head</h1><p>Text</p><p hidden>no</p><div style="display: none">no</div><div class="related">no</div></article></body>')]
    assert set(texts(spark, rows).values()) == {"Head\nText"}


def test_deep_and_long_pages_and_repeated_rows(spark):
    deep = "<div>" * 3000 + "<p>Deep</p>" + "</div>" * 3000 + "<p>After Deep</p>"
    long = "".join(f"<p>Paragraph {i}</p>" for i in range(5000))
    rows = [(1, "http://d.x/1", deep), (2, "http://d.x/2", deep.replace("Deep", "Other")), (3, "http://l.x/", f"<article>{long}</article>"), (3, "http://l.x/", f"<article>{long}</article>"), (4, None, None), (5, "", "")]
    got = H.html_extraction(spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, node int, inside string")).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted([(1, "Deep\nAfter Deep"), (2, "Other\nAfter Other"), (3, "\n".join(f"Paragraph {i}" for i in range(5000))), (3, "\n".join(f"Paragraph {i}" for i in range(5000))), (4, ""), (5, "")])
