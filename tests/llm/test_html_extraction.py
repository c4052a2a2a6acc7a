import itertools
import random

from seqloom.llm.html_extraction import common_lines, host_and_path, lines_of, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad top">Buy</div>
<article><header><h1>Title &amp;  more</h1></header><p>One <b>bold<i> word</b><br>and&nbsp;two &lt;b&gt; &eacute;<p>Three > two
 and 1 < 2</p><div class="shadow">Kept</div><div class="share-buttons"><p>Share</p><div>deep</div></div><form><p>Name</p></form>
<aside>Side</aside><ul><li>item</li><li></li></ul><section id='comments'><article><p>Reader</p></article></section></article>
<footer>&copy; site</footer></body></html>"""


def test_marked_article():
    assert lines_of(PAGE) == (["Title & more", "One bold word and two <b> é", "Three > two and 1 < 2", "Kept", "item"], True)


def test_odd_pages():
    assert lines_of("") == ([], False)
    assert lines_of("just text") == (["just text"], False)
    assert lines_of("<p>a<p>b<script>no end <p>c") == (["a", "b"], False)
    assert lines_of("<article><p>cut off &amp; open") == (["cut off & open"], True)
    assert lines_of("a <!-- open") == (["a"], False)
    assert lines_of("<main><p>x</p></main><p>y</p>") == (["x"], True)
    assert lines_of('<p title="a > b">x</p></div></nav>z') == (["x", "z"], False)
    assert lines_of("<div>" * 50_000 + "deep") == (["deep"], False)


def test_names_never_take_the_article():
    assert lines_of('<div class="layout has-sidebar"><article><p>x</p></article></div>') == (["x"], True)
    assert lines_of('<div class="sidebar"><article><p>x</p></article><p>y</p></div>') == (["x"], True)
    assert lines_of('<article class="post comments-open"><p>x</p></article>') == (["x"], True)
    assert lines_of('<article class="promo"><p>x</p></article>') == (["x"], True)
    assert lines_of('<article><p>x</p><section class="related-work"><p>y</p></section><div class="related posts">z</div></article>') == (["x", "y"], True)
    assert lines_of('<article><p>x</p></article><article class="comment"><p>Reader</p></article>') == (["x"], True)
    assert lines_of('<form id="aspnet"><div><p>x</p></div></form>') == (["x"], False)
    assert lines_of('<form><article><p>x</p></article><p>y</p></form>') == (["x"], True)
    assert lines_of('<div class="widget"><p>all there is</p></div>') == (["all there is"], False)
    assert lines_of("<nav>menu</nav><footer>foot</footer>") == ([], False)


def test_attributes():
    assert lines_of("<p>one <a title=don't>two</a> three</p><p>it's four</p>") == (["one two three", "it's four"], False)
    assert lines_of("<p data-a = 'x > y' b=\"it's\">one</p>") == (["one"], False)
    assert lines_of('<p>x<br/>y<svg width=1><path d="M 1"/><text>no</text></svg>z <svg/>w</p>') == (["x yz w"], False)
    assert lines_of('<p>x</p><p class="never closed') == (["x"], False)
    assert lines_of("<p>x</p><p " + 'a="b" c=' * 20_000) == (["x"], False)
    assert lines_of("<p>x</p>" + "<" * 20_000)[0][0] == "x"


def test_names_of_any_element():
    page = lambda x: f"<article><p>a</p>{x}<p>b</p></article>"
    for gone in (
        '<p class="advert">x</p>', '<p class="cookie-notice">x</p>', '<h3 class="related">x</h3>', '<span class="advert">x</span>', '<ins class="adsbygoogle">x</ins>',
        '<div class="user-comments">x</div>', '<div class="reader-comments"><p>x</p></div>', "<div class=google-ad>x</div>", "<div class=adbox>x</div>",
        '<div id="ad-300x250">x</div>', "<div hidden>x</div>", '<div style="color:red; display: none">x</div>', '<a class="share"><div>x</div></a>',
        '<ul><li class="related">x<ul><li>y</li></ul></li></ul>', "<p class=ad>x<span class=ad>y</span></p>",
    ):
        assert lines_of(page(gone)) == (["a", "b"], True), gone
    assert lines_of(page('<p>one <span class="ad">x <span>y</span> z</span> two</p>')) == (["a", "one two", "b"], True)
    for kept in ('<p class="adventure">x</p>', '<p data-class="ad" title="hidden">x</p>', '<p class="paragraph lead">x</p>', '<div class="post-content">x</div>', "<div id=padding>x</div>"):
        assert lines_of(page(kept)) == (["a", "x", "b"], True), kept


def test_elements_left_open():
    for page, want in (
        ("<nav><ul><li>m</li></ul><article><p>text</p></article>", (["text"], True)),
        ("<nav><ul><li>m</li></ul><p>text</p>", (["text"], False)),
        ("<body><nav>menu<div><h1>Title</h1><p>text</p></div></body>", (["Title", "text"], False)),
        ("<article><p>a</p><aside>side<p>b</p></article>", (["a", "b"], True)),
        ("<article><p>a</p><div class=advert>side<p>b</p></article>", (["a", "b"], True)),
        ("<article><p>a</p><span class=ad>side<p>b</p></article>", (["a", "b"], True)),
        ("<article><p>a</p><p><span class=ad>side</p><p>b</span></p></article>", (["a", "b"], True)),
        ("<article><p>a</p><p class=ad>side<p>b</article>", (["a", "b"], True)),
        ("<article><p>a</p><ul><li class=ad>side<li>b</ul></article>", (["a", "b"], True)),
        ("<head><title>x</title><body><p>text</p>", (["text"], False)),
        ("<footer><p>foot</p>", (["foot"], False)),
        ("<svg><path><p>text</p>", (["text"], False)),
        ("<select><p>text</p>", (["text"], False)),
    ):
        assert lines_of(page) == want, page
    assert lines_of("<nav>" * 3000 + "<p>x" * 3000) == (["x"] * 3000, False)
    assert lines_of("<div class=ad>" * 3000 + "x" + "</nav>" * 3000) == (["x"], False)


def test_a_tag_never_takes_the_only_article():
    assert lines_of("<footer><p>foot</p><article>x</article></footer>") == (["x"], True)
    assert lines_of("<main><p>long</p><aside><article>teaser</article></aside></main>") == (["long"], True)
    assert lines_of("<div class=related><article>teaser</article></div><article>x</article>") == (["x"], True)
    assert lines_of("<article>x<aside><article>teaser</article></aside></article>") == (["x"], True)


def test_common_lines_is_longest():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randint(0, 7))] for _ in range(2))
        best = 0
        for n in range(len(a), 0, -1):
            if any(_in(c, b) for c in itertools.combinations(a, n)):
                best = n
                break
        got = sorted(common_lines(a, b))
        assert len(got) == best and _in([a[i] for i in got], b)


def _in(c, b):
    it = iter(b)
    return all(x in it for x in c)


def test_urls():
    assert host_and_path("https://WWW.a.example.com:80/en/7/?q=1#x") == ("a.example.com", "/en/7")
    assert host_and_path("http://m.a.org/x/index.html") == ("m.a.org", "/x")
    assert host_and_path("not a url") == ("", "not a url")


def test_differences_between_nearest_pages(spark):
    own = lambda i: f"<p>Menu A</p><p>Menu B</p><p>Article {i} says {i * i}</p><p>Footer</p>"
    rows = [(i, f"https://s.example.com/en/{i:03d}", own(i)) for i in range(30)]
    rows += [(100, "https://other.example.com/1", "<p>Menu A</p>"), (101, None, None), (102, "", ""), (103, "https://s.example.com/zz", PAGE)]
    rows += [(None, "https://alone.example.com/", "<p>x</p>"), (105, None, "<p>no url</p>"), (106, None, "<p>no url</p>")]
    df = spark.createDataFrame([(*x, "h", 1) for x in rows], "page_id long, url string, html string, host string, lines int").repartition(5)
    got = {r.page_id: (r.text, r.n_chars, r.url) for r in main_text(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i][0] == f"Article {i} says {i * i}" for i in range(30))  # at the ends of ranges too
    assert got[100][0] == "Menu A" and got[101] == ("", 0, None) and got[102] == ("", 0, "") and got[105][0] == got[106][0] == "no url"
    assert got[103][0].startswith("Title & more\nOne bold") and got[103][1] == len(got[103][0]) and got[None][0] == "x"
    assert main_text(df.where("false")).collect() == []


def test_pages_without_marks_from_several_hosts(spark):
    """Each host has its own menu; pages differ in the article alone, so differencing gives just that."""
    r = random.Random(5)
    rows, want = [], {}
    for k in range(600):
        host = r.choice(["a.org", "b.org", "c.net", "d.com"])
        body = [f"{host} page {k} sentence {j} {r.random()}" for j in range(r.randint(1, 6))]
        rows.append((k, f"https://{host}/{r.randrange(10**6):06d}/{k}", f"<div>{host} home</div><div>Search {host}</div>" + "".join(f"<p>{x}</p>" for x in body) + f"<div>About {host}</div>"))
        want[k] = "\n".join(body)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    assert {x.page_id: x.text for x in main_text(df).collect()} == want


def test_pages_with_marks_are_compared_too(spark):
    """A page without marks loses what a marked neighbour has outside its article, and keeps what is in it."""
    rows = [(1, "https://a.org/1", "<div>Home</div><article><p>one</p><p>both</p></article><div>Legal</div>"),
            (2, "https://a.org/2", "<div>Home</div><p>two</p><p>both</p><div>Legal</div>"),
            (3, "https://a.org/3", "<div>Home</div><article><p>three</p></article><div>Legal</div>")]
    for n in (1, 3):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)
        assert {r.page_id: r.text for r in main_text(df).collect()} == {1: "one\nboth", 2: "two\nboth", 3: "three"}
