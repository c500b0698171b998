import html
import re

from perkflow.llm.html_text import main_text, text_column


def expected(page: str) -> str:
    """Another way for these tables' pages: cut out the article element and its block tags."""
    inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", page, re.S).group(1)
    blocks = re.split(r"</?(?:p|h1)>", inner)
    texts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?(?:b|br)>", " ", b))).strip() for b in blocks]
    return "\n".join(t for t in texts if t)


def test_query_equals_brute_force(results, duck):
    pages = dict(duck.execute("SELECT page_id, html FROM pages").fetchall())
    got = results("op6_html_text")
    assert len(got) == len(pages)
    for r in got.itertuples():
        assert r.text == expected(pages[r.page_id])
        assert r.n_chars == len(r.text)


def test_boilerplate_goes_and_short_lines_stay():
    page = """<html><head><title>T</title></head><body class="has-menu"><header><p>Site</p></header>
    <nav><ul><li><a href=/>Home</a><li>Two</ul></nav><div id="cookie-notice">We use cookies &amp; such</div>
    <div role="complementary">side</div><main><div class="article-header"><h1>Title &copy;</h1></div>
    <p>Some <b>bold</b>\n text that is long enough to be the article, with <a href=x>a link</a> in it.<p>Ok.
    <table><tr><td>a<td>b</table><script>var x = "</p>";</script><!-- gone --><form>Name <input></form>
    <p>Another long paragraph of the article follows here, as long as the first one was.</p>
    <div class="userComments"><p>first! a very long reader comment, longer than the article is, really, it is so
    long</p></div></main><aside>x</aside><footer>&copy; me</footer>"""
    assert main_text(page).split("\n") == [
        "Title ©", "Some bold text that is long enough to be the article, with a link in it.", "Ok.", "a", "b",
        "Another long paragraph of the article follows here, as long as the first one was."]


def test_pages_without_an_article_element():
    text = "A paragraph of the story that goes on for a while. "
    page = (f"<body><div class=menu><a href=1>one</a></div><div class=top><a href=1>x</a> <a href=2>y</a></div>"
            f"<div class=story><p>{text * 3}</p><p>Short.</p><p>{text * 3}</p></div><div id=footer>f</div>")
    assert main_text(page).split("\n") == [(text * 3).strip(), "Short.", (text * 3).strip()]
    assert main_text("just &lt;text&gt;\n here") == "just <text> here"


def test_frames_around_the_article_do_not_silence_it():
    story = "<p>A first paragraph of the story.</p><p>A second one, which goes on for a while.</p>"
    want = ["A first paragraph of the story.", "A second one, which goes on for a while."]
    menu, foot = "<nav><a href=1>Home</a></nav>", "<footer>imprint</footer>"
    for frame, end in (("<div class='layout has-sidebar'>", "</div>"), ("<div id=page-with-header>", "</div>"),
                       ("<form>", "</form>"), ("<div role=form><div class=widget>", "</div></div>")):
        for inner in (f"<article>{story}</article>", f"<main>{story}</main>", f"<div>{story}</div>"):
            assert main_text(f"<body>{frame}{menu}{inner}{foot}{end}</body>").split("\n") == want, (frame, inner)
    assert main_text(f"<body><article>{story}</article><div class=sidebar><article>x</article></div>").split("\n") == want
    talk = "<article><p>A reader says a lot, more than the story itself does, again and again.</p></article>" * 3
    assert main_text(f"<body><article>{story}<div id=comments>{talk}</div></article></body>").split("\n") == want
    assert main_text(f"<body><article>{story}</article><div id=comments>{talk}</div></body>").split("\n") == want


def test_long_and_short_paragraphs_without_an_article_element():
    blocks = ["Title", "x" * 2000, "y" * 80, *("z" * 60 for _ in range(8))]
    paragraphs = "".join(f"<p>{b}</p>" for b in blocks[1:])
    page = f"<body><div class=menu><a href=1>one</a></div><div><h1>Title</h1>{paragraphs}</div></body>"
    assert main_text(page).split("\n") == blocks
    cells = "".join(f"<tr><td>{b}</td></tr>" for b in blocks[1:])
    assert main_text(f"<body><div><h1>Title</h1><table>{cells}</table></div></body>").split("\n") == blocks
    items = "".join(f"<li>{b}" for b in blocks[1:])
    assert main_text(f"<body><section><h1>Title</h1><ul>{items}</ul></section></body>").split("\n") == blocks


def test_an_article_element_must_hold_most_of_the_content():
    story = [f"Paragraph {i} of the story, which is not in the article element of this page at all." for i in range(6)]
    told = "".join(f"<p>{t}</p>" for t in story)
    page = f"<body><div class=story>{told}</div><div class=card><article><p>A teaser.</p></article></div></body>"
    assert set(story) <= set(main_text(page).split("\n"))
    listed = [f"Entry {i} of a page of entries, each of them as long as the others are." for i in range(4)]
    page = "<body><div>" + "".join(f"<article><p>{t}</p></article>" for t in listed) + "</div></body>"
    assert main_text(page).split("\n") == listed
    assert main_text(f"<body><article>{told}</article><div><p>Short line.</p></div></body>").split("\n") == story


def test_odd_pages_end():
    deep = "<div>" * 20_000 + "x" + "</span></div>" * 20_000
    assert main_text(deep) == "x"
    assert main_text("<nav><ul><li>menu<article><p>Story.</p></article>") == "Story."
    assert main_text("<article><p>" + "word " * 200_000) == ("word " * 200_000).strip()


def test_class_words_inside_an_article_need_the_clusters():
    long = "A paragraph of the story that goes on for a while, with all that belongs to it and some more of it. "
    page = f"""<body><article><h1>Title</h1><p>{long}</p><p class="social-policy">{long}1</p><p>{long}2</p>
    <div class="share"><a href=1>Share</a> <a href=2>Post</a></div><p class="share-price">{long}3</p>
    <div class="newsletter"><p>Sign up</p></div><div class="comments"><p>{long}4</p></div>
    <nav><p>{long}5</p></nav><p hidden>{long}6</p></article></body>"""
    assert main_text(page).split("\n") == ["Title", long.strip(), long + "1", long + "2", long + "3"]


def test_several_articles_that_hold_content_are_kept():
    def entry(i, n):
        return f"Entry {i} says something, and says it at length. " * n
    page = f"<body><div><article><p>{entry(1, 7)}</p></article><p>aside</p><article><p>{entry(2, 7)}</p></article></div>"
    assert main_text(page).split("\n") == [entry(1, 7).strip(), entry(2, 7).strip()]
    cards = "".join(f"<article><a href=1>More {i}</a><p>Teaser {i}.</p></article>" for i in range(5))
    page = f"<body><article><p>{entry(1, 20)}</p><article><p>{entry(2, 9)}</p></article></article><div>{cards}</div></body>"
    assert main_text(page).split("\n") == [entry(1, 20).strip(), entry(2, 9).strip()]


def test_unclosed_tags_take_linear_time():
    import time
    start = time.monotonic()
    for piece in ("<a ", "<a x='", '<a x="', "<a/", "<a b=c ", "<div class='x' ", "</p", "<!--", "<?x "):
        assert main_text("<p>The text.</p>" + piece * (1_000_000 // len(piece))) == "The text."
    assert time.monotonic() - start < 20
    assert main_text("<p>5 < 6, and 7 <8 <a href='x") == "5 < 6, and 7 <8"


def test_edge_rows(spark):
    rows = [(1, None, 0), (1, None, 0), (2, "", 0), (3, "<p>é &#x1F642;</p>", 0), (4, "\x00<b>z", 0)]
    pages = spark.createDataFrame(rows, "text long, html string, n_chars int")
    got = pages.select("text", text_column("html").alias("t")).collect()
    assert sorted((r["text"], r["t"]) for r in got)[:4] == [(1, ""), (1, ""), (2, ""), (3, "é 🙂")]
    assert pages.limit(0).select(text_column("html")).collect() == []
