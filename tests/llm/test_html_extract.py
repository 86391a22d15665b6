import pytest

from glyphflow.llm.html_extract import common_lines, extract_text, main_text, page_lines

SHELL = "<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href='/'>Home</a></nav><div class='cookie-notice'>We use cookies</div>{}<footer>&copy; x</footer><script>var a='</p>';</script></body></html>"


def text(source):
    lines = page_lines(source)
    return main_text(lines, [hash(x[0]) for x in lines], None)


def test_article_only():
    page = SHELL.format("<header><h1>Site</h1></header><article><header><h1>A &amp; B</h1></header><p>one\n two<p><b>three<br>four</b><div class='comments'><p>me too</p></div><form>search</form></article><aside>more</aside>")
    assert text(page) == "A & B\none two\nthree\nfour"


def test_without_article_links_go():
    assert text(SHELL.format("<div><ul><li><a>one</a><li><a>two</a></ul></div><div>Body text here.</div>")) == "Body text here."


def test_broken_markup():
    assert text(None) == "" and text("") == "" and text("<") == "<" and text("<p") == "" and text("a < b &am") == "a < b &am"
    assert text("<article><p>x<script>if (a</p>") == "x" and text("<!-- <p>no</p> --><p>yes<!-- open") == "yes"
    assert text('<article><p title="a>b">ok</p>') == "ok" and text("<p>&#x41;&#66;&nbsp;&lt;c&gt;</p>") == "AB <c>"
    assert text("<p>" + "word " * 50_000) == ("word " * 50_000).strip()


def test_common_lines_are_a_longest_common_subsequence():
    assert common_lines([1, 2, 3, 4], [2, 9, 4, 3]) in ([1, 3], [1, 2])
    assert common_lines([1, 1, 1], [1, 1]) == [0, 1] and common_lines([], [1]) == []


def pages(spark):
    line = lambda i: f"<div>Shared menu line</div><div>Own text number {i} with enough words.</div><div>Imprint of the site</div>"
    rows = [(i, f"http://a.org/d/{i}", line(i), "h", "l") for i in range(30)]
    rows += [(100, None, None, "", ""), (101, "x", "", "", ""), (102, "http://b.org/q", "<p>alone</p>", "", ""), (None, "http://c.org/", "<p>no id</p>", "", "")]
    rows += [(103, "http://e.org/1", "<div>Same article text here.</div>", "", ""), (104, "http://e.org/2", "<div>Same article text here.</div>", "", "")]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, lines string").repartition(3), rows


def test_shared_lines_go(spark):
    df, rows = pages(spark)
    for size in (256, 4):
        got = extract_text(df, group_rows=size).collect()
        assert len(got) == len(rows)
        by = {r.page_id: r for r in got}
        assert sum(r.text == f"Own text number {r.page_id} with enough words." for r in got if r.page_id is not None and r.page_id < 30) >= 28
        assert by[100].text == "" and by[101].text == "" and by[102].text == "alone" and by[None].text == "no id"
        assert by[103].text == by[104].text == "Same article text here."
        assert all(r.n_chars == len(r.text) for r in got)
    assert extract_text(df.where("false")).count() == 0


def test_all_pages_of_the_first_path_are_differenced(spark):
    line = "<div>Shared menu line</div><div>Own text number {} with enough words.</div><div>Imprint of the site</div>"
    rows = [(i, f"http://a.org/d/view?id={i}" if i < 150 else "http://a.org/d/z", line.format(i)) for i in range(151)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(i, f"Own text number {i} with enough words.") for i in range(151)]


LINE = "<div>Shared menu line</div><div>Own text number {} with enough words.</div><div>Imprint of the site</div>"


def texts(spark, rows, **options):
    return {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), **options).collect()}


def test_a_page_meets_the_nearest_path_of_its_host(spark):
    rows = [(i, f"http://a.org/d{i}/x", LINE.format(i)) for i in range(20)]  # each alone in its directory
    rows += [(100 + i, f"http://hot.org/d/{i:03}", LINE.format(100 + i)) for i in range(100)]
    for size in (256, 8, 1):
        assert texts(spark, rows, group_rows=size) == {i: f"Own text number {i} with enough words." for i, _, _ in rows}
    pair = "<div>Section {} menu of its own</div><div>Own text number {} with enough words.</div>"
    rows = [(i, f"http://b.org/d/{i:03}", pair.format(i // 2, i)) for i in range(100)]  # only the nearest has the menu
    got = [texts(spark, rows, group_rows=size) for size in (256, 8, 1)]
    assert got[0] == got[1] == got[2]
    assert all(got[0][i] == f"Own text number {i} with enough words." for i in range(1, 100, 2))


def test_copies_are_passed_over(spark):
    copy = "<div>Shared menu line</div><div>One article that many addresses of this host give, word by word.</div><div>Imprint of the site</div>"
    rows = [(i, f"http://a.org/d/{i:03}", copy) for i in range(100)] + [(100, "http://a.org/e", LINE.format(100))]
    for size in (256, 8):
        got = texts(spark, rows, group_rows=size)
        assert all(got[i] == "One article that many addresses of this host give, word by word." for i in range(100))
        assert got[100] == "Own text number 100 with enough words."


def test_pages_shorter_than_their_menus(spark):
    short = "<div>Shared menu line</div><div>Own text {}.</div><div>Imprint of the site</div>"
    rows = [(i, f"http://a.org/d/{i:03}", short.format(i)) for i in range(30)]
    rows += [(100 + i, f"http://b.org/d/{i}", "<div>The same text at every address.</div>") for i in range(9)]
    for size in (256, 4):
        got = texts(spark, rows, group_rows=size)
        assert got == {i: f"Own text {i}." if i < 30 else "The same text at every address." for i, _, _ in rows}


def test_what_every_article_of_the_host_has_goes(spark):
    article = "<article><h1>Title {0}</h1><p>Own text number {0} with enough words for an article of its own.</p><p>{1}</p><ul><li>Sign up for our letter and never miss a thing that we write here</ul></article>"
    quoted = lambda i: f"A passage that two articles have {i // 2}."
    rows = [(i, f"http://a.org/d/{i:03}", article.format(i, quoted(i))) for i in range(40)]
    rows += [(100 + i, f"http://b.org/d/{i}", article.format(100 + i, quoted(i))) for i in range(2)]
    own = "Title {0}\nOwn text number {0} with enough words for an article of its own.\n{1}"
    for size in (256, 4):
        got = texts(spark, rows, group_rows=size)
        assert all(got[i] == own.format(i, quoted(i)) for i in range(40))
        assert all(got[i].startswith(own.format(i, quoted(i - 100))) and "Sign up" in got[i] for i in (100, 101))


def test_longest_common_subsequence(monkeypatch):
    import random

    from glyphflow.llm import html_extract as m

    def length(a, b):
        best = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(best[j] + 1 if x == y else max(best[j + 1], row[j]))
            best = row
        return best[-1]

    rng = random.Random(8)
    for bits in (1 << 27, 20):
        monkeypatch.setattr(m, "BITS", bits)
        for _ in range(400):
            k = rng.choice([2, 4, 30])
            a, b = ([rng.randrange(k) for _ in range(rng.randrange(0, 25))] for _ in range(2))
            got = m.common_lines(a, b)
            assert got == sorted(set(got)) and len(got) == length(a, b)
            rest = iter(b)
            assert all(any(x == y for y in rest) for x in (a[i] for i in got))
    assert m.common_lines([1, 2], [2, 1, 2]) == [0, 1]


def test_names_never_take_the_only_text():
    from glyphflow.llm.html_extract import main_text, page_lines

    text = lambda source: main_text(page_lines(source), [0] * len(page_lines(source)), None)
    assert text('<body><div id="page" class="has-sidebar"><p>Main text</p></div></body>') == "Main text"
    assert text('<div class="market-share"><p>Main text</p></div>') == "Main text"
    assert text('<p class="notice">note<p>Main text') == "Main text"
    assert text('<div class="sidebar"><p>Only text</p></div>') == "Only text"
    assert text('<div class="site-footer">imprint</div><p>Main text</p>') == "Main text"
    assert text('<ul class="menu-main"><li>Home</li></ul><div class="ad-box">buy</div><p>Main text</p>') == "Main text"


def test_a_host_of_many_parts_and_blocks_hands_over_what_one_part_knows(spark):
    article = "<article><h1>Title {0}</h1><p>Own text number {0} with enough words for an article.</p><p>{1}</p></article><div>Menu of section {2}</div><div>Imprint</div>"
    body = "<div>Own text number {0} with enough words for a page.</div><div>Menu of section {2}</div><div>{1}</div>"
    rows = []
    for i in range(240):
        host = "hot.org" if i < 160 else f"h{i // 20}.org"
        rows.append((i, f"http://{host}/{i // 9}/{i:03}", (body if i % 3 else article).format(i, "Sign up for our letter and never miss a thing." if i % 5 else "Copied", i // 12)))
    want = texts(spark, rows, group_rows=1000)  # one part
    for size in (40, 9, 2, 1):
        assert texts(spark, rows, group_rows=size) == want


@pytest.mark.parametrize(
    "source, kept",
    [
        ('<p>one</p><p id="share-prices">two</p>', "one two"),
        ('<p>one</p><section class="ad-hoc"><p>two</p></section>', "one two"),
        ('<p>one</p><div class="menu-planning">two</div>', "one two"),
        ('<p>one</p><p title="the hidden truth">two</p>', "one two"),
        ('<p>one</p><p data-x="hidden" data-class="ad">two</p>', "one two"),
        ('<p>one</p><p hidden="false">two</p>', "one two"),
        ("<p>one</p><p>a <math><mi>b</mi><mo>=</mo><mn>2</mn></math></p>", "one a b=2"),
        ("<p>one</p><p hidden>two</p>", "one"),
        ("<p>one</p><p HIDDEN=''>two</p>", "one"),
        ('<p>one</p><p style="color:red; display : none">two</p>', "one"),
        ("<p>one</p><div aria-hidden='true'>two</div>", "one"),
        ('<p>one</p><div class="newsletter-box">two</div><ul class="share">three</ul><div role=alert>four</div>', "one"),
        ('<p>one</p><div id="comments-list-2">two</div>', "one"),
    ],
)
def test_names_and_attributes_inside_an_article(source, kept):
    """Only what says nothing but a page's part, and attributes that hide by themselves, take text from an article."""
    assert " ".join(t for t, *_ in page_lines(f"<main><article>{source}</article></main>")) == kept
