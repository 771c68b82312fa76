"""Main text of pages."""

import random

import pytest

from tallywarden.llm import extract


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("bits", [1 << 28, 4])
def test_common_lines(monkeypatch, bits):
    monkeypatch.setattr(extract, "TABLE_BITS", bits)
    random.seed(bits)
    for _ in range(800):
        kinds = random.choice([2, 3, 6, 20])
        a, b = ([random.randrange(kinds) for _ in range(random.randrange(15))] for _ in range(2))
        at = extract.common(a, b)
        rest = iter(b)
        assert at == sorted(set(at)) and all(any(a[i] == y for y in rest) for i in at)
        assert len(at) == longest(a, b)


KEPT = "<article><h1>T &amp; t</h1><p>a  b\n c<br>d<p>e<b>f</b>&nbsp;g</article>"


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text", "plain <text"),
        (KEPT, "T & t\na b c d\nef g"),
        ("<nav>x</nav><div class='Top-Ad'>y</div>" + KEPT + "<footer>z</footer>", "T & t\na b c d\nef g"),
        ("<article><p>a<aside>b</aside><form>c<input value='>'>d</form><p>e<div id=comments><article><p>f</article></div></article>", "a\ne"),
        ("<article><header><h1>a</h1></header><p>b<script>if (x < 1) '</p>'</script> c<style>p{}</style></p><footer>d</footer></article>", "a\nb c"),
        ("<header>x</header><main><p>a<p>b</main><p>c", "a\nb"),
        ("<ul><li>a<li>b</ul><table><tr><td>c</td><td>d</td></tr></table>", "a\nb\nc d"),
        ("<p>a<!-- <p>b --><p hidden>c</p><p style='display: none'>d</p><div role=banner>e</div> 1 < 2 &copy; <unfinished", "a\n1 < 2 ©"),
        ("<p>a<button><div>x</div></button>b<svg><text>y</text>c<p>d", "ab"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article class='post'><div class='article-header'>a</div><div class=cookie-notice>b</div></article>", "a"),
        ('<div class="layout has-sidebar"><article><p>a</article><div class=sidebar>b</div></div>', "a"),
        ('<form id="aspnetForm"><input><article><p>a</article></form>', "a"),
        ('<form id="aspnetForm"><h1>t</h1><p>a</form><form><p>search</form>', "t\na"),
        ('<article class="post no-sidebar"><p>a<form><h1>b</h1></form></article>', "a"),
        ('<main><div class="article-content related-none"><p>a</div></main>', "a"),
        ('<article><p>a<div class="social-history">b</div><h2 id="ad-1914">c</h2><div class=social-share>d</div><div id=ad-300x250>e</div><div id=ad12>f</div></article>', "a\nb\nc"),
        ('<div class="content sidebar-left"><article><p>a</article></div><div class="sidebar-left">b</div>', "a"),
        ('<body class="sidebar-open"><div class="page-wrapper with-comments"><main><p>a</main></div><div class=commentList>b</div><div class="site-footer">c</div>', "a"),
        ('<article><p>a</article><div class="comments no-ads"><article><p>b</article></div><aside><article>c</article></aside><div class=RelatedPosts><article>d</article></div>', "a"),
    ],
)
def test_blocks(page, text):
    texts, kinds = extract.lines(page or "")
    kind = extract.chosen(kinds)
    assert "\n".join(t for t, k in zip(texts, kinds) if k == kind and kind) == text


SITE = "<body><div>Home</div><div>About us</div><p>{}</p><p>{}</p><p>{}</p><div>All rights</div></body>"


def test_neighbours_lines_go(spark):
    rows = [(i, f"https://A.example/x/{i:03}", SITE.format(f"own {i}", f"more {i}", f"last {i}")) for i in range(30)]
    rows += [(100, "https://b.example/x/000", SITE.format("b", "c", "d")), (101, None, SITE.format("e", "f", "g")), (102, "https://c.example/1", KEPT), (103, "https://c.example/2", KEPT)]
    rows += [(104, "https://d.example/1", "<p>copied one<p>copied two<p>x"), (105, "https://d.example/2", "<p>copied one<p>copied two<p>x")]
    rows += [(0, *rows[0][1:]), (None, None, None), (106, "https://a.example/x/005?print", rows[5][2])]
    pages = spark.createDataFrame([(*r, None, 1, 2) for r in rows], "page_id long, url string, html string, text string, lines long, mark long")
    got = extract.main_text(pages)
    assert sorted(got.columns) == ["lines", "mark", "page_id", "text", "url"]
    texts = {}
    for r in got.collect():
        assert texts.setdefault(r.page_id, r.text) == r.text  # repeated rows agree
    assert got.count() == len(rows)
    for i in range(30):
        want = [f"own {i}", f"more {i}", f"last {i}"]
        assert texts[i] == "\n".join(want)
    assert "Home" in texts[100] and "Home" in texts[101]  # no neighbour on their hosts
    assert texts[102] == texts[103] == "T & t\na b c d\nef g"  # an article is no furniture
    assert texts[104] == texts[105] == "copied one\ncopied two\nx"  # copies of each other
    assert texts[None] == ""


def test_templates_go_and_copies_keep_their_text(spark):
    furniture = "<div>Home</div><div>News</div><div>Sport</div><div>Contact</div>{}<div>Terms</div><div>Privacy</div><div>All rights</div>"
    site = [(i, f"https://t.example/{i:02}", furniture.format(f"<p>own {i}<p>more {i}")) for i in range(12)]  # 7 of 9 lines are shared
    site += [(100 + i, f"https://t.example/05?print={i}", site[5][2]) for i in range(8)]  # copies side by side
    near = [f"<p>text {k}" for k in range(20)]
    site += [(200 + i, f"https://t.example/07/{i}", furniture.format("".join(near) + f"<p>version {i}")) for i in range(5)]  # near copies
    pages = spark.createDataFrame(site, "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in extract.main_text(pages).collect()}
    for i in range(12):
        assert texts[i] == f"own {i}\nmore {i}"
    assert {texts[100 + i] for i in range(8)} == {"own 5\nmore 5"}
    for i in range(5):
        assert texts[200 + i].split("\n") == [*(f"text {k}" for k in range(20)), f"version {i}"]


TEASER = "<article><h2>Offer</h2><p>Read more</p></article>"


def test_marked_pages_are_aligned_too(spark):
    own = "".join(f"<p>own {{0}} {k}" for k in range(4))
    rows = [(i, f"https://m.example/{i:03}", (TEASER + "<div>Home</div>" + own).format(i)) for i in range(30)]  # the mark is on the site's teaser
    rows += [(100 + i, f"https://n.example/{i:03}", (TEASER + "<article>" + own + "</article><p>beside").format(i)) for i in range(30)]
    rows += [(200 + i, f"https://o.example/{i:03}", (TEASER + "<main>" + own + "</main>").format(i)) for i in range(30)]
    # An article that is quoted, or copied under other menus, stays whole, and so does one that few pages have.
    rows += [(300 + i, f"https://p.example/{i:03}", f"<nav>menu {i}</nav><article><p>a<p>b {i // 2 % 2}</article><p>day {i}") for i in range(30)]
    rows += [(400 + i, f"https://q.example/{i:03}", f"<article><p>quoted<p>own {i}</article>") for i in range(30)]
    rows += [(500 + i, f"https://r.example/{i:03}", (TEASER + own).format(i)) for i in range(2)]
    rows += [(600 + i, f"https://s.example/5?page={i:02}", ("<article><p>a<p>b</article>" + own).format(i)) for i in range(30)]  # parts of one page
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in extract.main_text(pages).collect()}
    for i in range(30):
        for site in (0, 100, 200):
            assert texts[site + i] == "\n".join(f"own {i} {k}" for k in range(4))
        assert texts[300 + i] == f"a\nb {i // 2 % 2}"
        assert texts[400 + i] == f"quoted\nown {i}"
        assert texts[600 + i] == "a\nb"
    assert texts[500] == texts[501] == "Offer\nRead more"


def test_equals_alignment_in_one_list(spark, monkeypatch):
    monkeypatch.setattr(extract, "STEP_ROWS", 3)
    random.seed(4)
    marks = ["<p>{}</p>", "<p>{}</p>", "<nav>{}</nav>", "<p>{}</p>", "<article>{}</article>", "<main>{}</main>", "<article><p>{}</p><p>{}</p></article>"]
    rows = []
    for i in range(400):
        lines = [random.choice(marks) for _ in range(random.randrange(7))]
        host = random.choice([0, 0, 1, 2, i])
        text = {0: TEASER, 1: "<p>Home", 2: "<main><p>Home</main>"}.get(host, "") + "".join(m.replace("{}", f"line {random.choice([0, *random.choices(range(1000), k=4)])}") for m in lines)
        rows.append((i, f"https://h{host}.example/{random.randrange(40)}/{i:03}", text))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract.main_text(pages).collect()}

    hosts, changed = {}, 0
    for i, url, page in rows:
        host, _, path = url.removeprefix("https://").partition("/")
        hosts.setdefault(host, []).append(("/" + path, i, *extract.blocks(page)))
    for site in hosts.values():
        site.sort()
        unlike = {}
        for path, _, *made in site:
            unlike.setdefault(tuple(extract._numbered(*made)), path)
        order = [(path, list(own)) for own, path in unlike.items()]
        for path, i, texts, kinds, articles in site:
            own = extract._numbered(texts, kinds, articles)
            k = next(k for k, x in enumerate(order) if x[1] == own)

            def at(*steps):
                return [order[j] for s in steps for j in (k - s, k + s) if 0 <= j < len(order)]

            left, doubt = extract._beside(own, order[k][0], at(1)) if at(1) and any(kinds) else (None, False)
            if doubt:
                left, _ = extract._among(own, order[k][0], at(*extract.FURTHER))
            changed += left is not None
            if left is None:
                left = [j for j, x in enumerate(kinds) if x == extract.chosen(kinds)]
            assert got[i] == "\n".join(texts[j] for j in left if kinds[j])
    assert changed > 40


def test_nearest_path_counts():
    own = [x << 1 | 1 for x in (1, 2, 3, 4)]
    far, near = [x << 1 for x in (1, 2)], [x << 1 for x in (3,)]
    assert extract._shared(own, "/a/b/2", [("/a/a", far), ("/a/b/9", near)]) == [2]
    assert extract._shared(own, "/a/b/2", [(None, None), (None, None)]) == []


def test_empty_table_and_query(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert extract.main_text(pages.where("false")).count() == 0
    from tallywarden.llm import queries

    got = {r.page_id: r for r in queries.op3_html(spark, "/root/testdata/sf0.001").collect()}
    for p in pages.collect():
        assert got[p.page_id].n_chars == len(got[p.page_id].text)
        article = p.html.partition("<article>")[2].partition("</article>")[0]
        assert all(line in article.replace("&amp;", "&").replace("&quot;", '"') for line in got[p.page_id].text.split("\n"))
