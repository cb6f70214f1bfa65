"""Main text of pages: whole pages with what is to go, rules one by one, odd pages."""

import time

import pytest

from ledgerloom.llm import htmltext as h

PROSE = [
    "The river had been low for most of the summer, and the people of the town had begun to talk about the old bridge that stood under the water in the years of their grandparents, "
    "when the mill was still at work and the road to the coast went by the church.",
    "It was not until the end of September that the rain came, and with it the first of the boats from the harbour.",
    "Nobody spoke.",
    "In the morning the bridge was gone again, and on the bank there was a line of stones that the children took home in their pockets, as they had been told to do by the woman from the "
    "museum, who had said that each of them was older than the town.",
]
ARTICLE = "\n".join(["The bridge &amp; the river", *PROSE]).replace("&amp;", "&")
BODY = "<h1>The bridge &amp; the river</h1>" + "".join(f"<p>{p}</p>" for p in PROSE)
COMMENT = "I was there in the year of the flood, and it is not at all as the writer says: the bridge was on the other side of the church and the people of the town know that."
PARTS = {
    "menu": "<nav><ul><li><a href='/'>Home</a><li><a href=/news>News of the day</a></ul></nav>",
    "menu by class": "<div class='main-menu'><span>Home</span> <span>News</span> <span>The people and the places of the town and of the coast around it</span></div>",
    "header": "<header><h2>The Daily Bridge</h2><p>The paper of the town for the people of the coast and the hills behind it since 1900</p></header>",
    "sidebar": f"<aside><h3>More</h3><p>{COMMENT}</p></aside>",
    "sidebar by class": f"<div id='leftSidebar'><p>{COMMENT}</p></div>",
    "notice": "<div class='cookie-notice'><p>We use cookies to make this the best site that it can be for you and for all of the others who come to it from the web.</p></div>",
    "advert": f"<section class='ad-box'>{COMMENT}</section>",
    "form": "<form><p>Sign up for the letter that we send to all of the people who have been with us for a year or for more.</p><input name=a><select><option>One<option>Two</select></form>",
    "script": "<script>if (a < b) document.write('<p>The script of the page</p>');</script><style>p > a { color: red }</style><noscript>The page needs scripts</noscript>",
    "comments": f"<section id='comments'><h3>2 comments</h3><article><p>{COMMENT}</p></article><article><p>{COMMENT}</p></article></section>",
    "comments by heading": f"<div><h3>Comments (2)</h3><p>{COMMENT}</p><p>{COMMENT}</p></div>",
    "footer": "<footer><p>&copy; 2024 The Daily Bridge. All of the rights are with the paper and with the people who write for it.</p></footer>",
    "hidden": f"<div hidden><p>{COMMENT}</p></div><div style='display: none'><p>{COMMENT}</p></div>",
    "links": "<ul>" + "".join(f"<li><a href='/{k}'>The story of the bridge and of the town, part {k}</a>" for k in range(9)) + "</ul>",
}


@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<main>", "</main>"), ("<div class='content no-sidebar'>", "</div>"), ("<div role='main'><div>", "</div></div>"), ("", "")])
@pytest.mark.parametrize("part", PARTS)
def test_what_is_not_the_article_goes(around, part):
    a, b = around
    if a:
        assert h.main_text(f"<html><body>{PARTS[part]}{a}{BODY}{b}</body></html>") == ARTICLE
    assert h.main_text(f"<html><body>{a}{BODY}{b}{PARTS[part]}</body>") == ARTICLE


def test_all_parts_at_once_and_unclosed_tags():
    page = "<!DOCTYPE html><html lang=en><head><title>The bridge</title><meta charset=utf-8></head><body class='home has-comments'>"
    page += "".join(v for k, v in PARTS.items() if k not in ("comments", "comments by heading", "footer")) + "<!-- <p>not this</p> --><article>" + BODY.replace("</p>", "") + "</article>"
    page += PARTS["comments"] + PARTS["footer"]
    assert h.main_text(page) == ARTICLE
    assert h.main_text(page[: page.index("</article>")]) == ARTICLE


def test_rules_without_headline_or_article():
    page = "<div><p>" + "</p><p>".join(PROSE) + "</p></div>"
    assert h.main_text(PARTS["links"] + PARTS["footer"] + page) == "\n".join(PROSE)
    blocks = h.page_blocks("<h2>Short title</h2>" + page + "<p>Buy now</p><ul><li><a href=x>The one and the other of them</a></ul>")
    kinds = h.first_pass(blocks)
    assert kinds == [h.SHORT, h.GOOD, h.NEAR, h.SHORT, h.GOOD, h.SHORT, h.BAD]
    assert h.second_pass(blocks, kinds) == [True, True, True, True, True, False, False]


@pytest.mark.parametrize("page", [
    "{nav}<h1>T</h1><p>Short.</p><p>Also short.</p>{foot}", "<body>{nav}<h1>T</h1><p>Short.</p><p>Also short.</p>{foot}", "<html><body>{nav}<div id=main><h1>T</h1><div><p>Short.</p><p>Also short.</p></div></div>{foot}",
    "<body>{nav}<div><div><h1>T</h1></div><div><div><p>Short.</p></div><div><p>Also short.</p></div></div></div><div>other</div>{foot}", "{nav}" + "<div>" * 2000 + "<h1>T</h1><p>Short.</p><p>Also short.</p>" + "</div>" * 2000 + "{foot}",
])
def test_short_articles_stand_around_their_headline(page):
    assert h.main_text(page.format(nav=PARTS["menu"], foot=PARTS["footer"])) == "T\nShort.\nAlso short."


def test_a_language_without_stop_words_goes_by_length():
    line = "Ala makotaikotmaalę któragodrapie oraz gryzie wieczoremprzyokniebezkońca " * 4
    assert h.main_text(f"<ul><li><a href=a>menuxyz</a></ul><div><p>{line}</p><p>{line}</p></div>") == "\n".join([line.strip()] * 2)


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), (" \n ", ""), ("<p>", ""), ("plain", ""), ("<article>a&nbsp;&lt;b&gt;\t\n c&#233;&eacute;&amp;amp;</article>", "a <b> céé&amp;"), ("<article>one<br>two<br><br>three</article>", "one two\nthree"),
    ("<article>x <b>y<i>z</article>", "x yz"), ('<article><p title="a > b">t</p></article>', "t"), ("<article>a < b and c<d</article>", "a < b and c"), ("<article><p>x<!-- y", "x"), ("<article><p>x<script>y", "x"),
    ("<article><p>x</p><script>var a='<p>no</p>'</script ><p>y</article>", "x\ny"), ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"), ("<article><p>x</p><title>y", "x\ny"),
    ("<div class='sidebar'><p>" + PROSE[0] + "</p></div>", PROSE[0]), ("<nav><p>" + PROSE[0] + "</p></nav>", ""),
])
def test_odd_pages(page, text):
    assert h.main_text(page) == text


def test_time_grows_with_the_length_only():
    for unit in ("<a href=\"", "<!--", "<", "<title>", "<li>", "<div class='a b'>", "</p>", "&amp;", "<p>x <b>", "<script", "<a b='>"):
        began = time.perf_counter()
        h.main_text("<article>x" + unit * (1_000_000 // len(unit)))
        assert time.perf_counter() - began < 20, unit


def test_tables_of_pages(spark):
    rows = [(1, "u", "<article>" + BODY + "</article>", 5), (1, "u", "<article>" + BODY + "</article>", 5), (None, None, None, None), (3, "", "", 7), (4, "x", "<article>" + "<p>word</p>" * 50_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, main_text int")
    out = h.extract_text(df)
    assert out.columns == ["page_id", "url", "html", "main_text"] and out.schema["main_text"].dataType.simpleString() == "string"
    got = sorted((r.page_id or 0, len(r.main_text)) for r in out.collect())
    assert got == [(0, 0), (1, len(ARTICLE)), (1, len(ARTICLE)), (3, 0), (4, 249_999)]
    assert h.extract_text(df.limit(0), carry=["page_id"], result="text").collect() == []
