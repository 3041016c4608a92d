import time

import duckdb
import pytest

from ragloom.llm import queries
from ragloom.llm.html_text import extract, lines_of, main_text

PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>A title</title><style>p{margin:0}</style>
<script>var t="</p><p>no";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<!-- <p>hidden</p> --><div class="cookie-notice">We use cookies.</div><div class="ad">Buy &amp; save.</div>
<article><h1>Head &amp; tail</h1><p><b>First&nbsp;  line<br>goes
 on.<br><p>Short.</p><form><label>Mail</label><input name="x"><button>Go</button></form><ul><li>One</li><li>a &lt;b&gt; c</li></ul>
<aside>Side story.</aside><p>Last <a href="/x">link</a>.</p><div id="comments"><p>Reader one says hi.</p></div></article>
<div class="sidebar"><p>Popular.</p></div><footer>&copy; site</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE) == "Head & tail\n\nFirst line goes on.\n\nShort.\n\nOne\n\na <b> c\n\nLast link."


def test_truncated_markup():
    assert main_text("<body><article><p>One two.</p><p>Three &amp; four.</p></article><footer>x</foo") == "One two.\n\nThree & four."
    assert main_text('<article><p>Text here<a href="un') == "Text here"
    assert main_text("<article><p>a < b and 3 > 2</p>") == "a < b and 3 > 2"


def test_unmarked_page_needs_a_surge():
    story = "Long enough a line to be the story of this page, told at some length. "
    page = f"<body><div><a href='/'>Home</a> <a href='/b'>About</a></div><div class=nav>x</div><div><p>{story * 2}</p><p>Short end.</p></div><div class='footer'>f</div><p>tail</p>"
    assert main_text(page) == f"{(story * 2).strip()}\n\nShort end."
    assert main_text("<p>tiny</p>") == "tiny"


def test_short_end_after_a_form_stays():
    story = "First paragraph of the story, long enough by itself to be a surge in the windows of this page."
    page = f"<body><div class='header'>Site</div><div id='content'><h2>Title</h2><p>{story}</p><form>x</form><p>The end.</p></div><div id='footer'>f</div><p>tail</p></body>"
    assert main_text(page) == f"Title\n\n{story}\n\nThe end."


def test_stripped_parent_of_the_article_is_given_up():
    assert main_text("<div class='widget'><div><article><p>Inside.</p></article></div></div>") == "Inside."


def test_lines_leave_a_gap_for_what_was_stripped():
    assert lines_of("<p>a</p><nav>n</nav><p>b</p>").text == ["a", "", "", "", "b"]


STORY = "A line of the story of this page, as long as such lines are, and then some more of it to make it long."


def test_a_teaser_marked_as_article_decides_nothing():
    page = f"<body><nav>Menu</nav><div id='content'><h2>Title</h2><p>{STORY}</p><p>{STORY}</p></div><article class='card'><p>Read this next.</p></article><footer>f</footer>"
    assert main_text(page) == f"Title\n\n{STORY}\n\n{STORY}"


def test_names_alone_strip_nothing_that_holds_the_story():
    assert main_text(f"<body><div class='layout-sidebar-right'><p>{STORY}</p><div class='ads-box'>Buy.</div><p>{STORY}</p></div>") == f"{STORY}\n\n{STORY}"
    page = f"<article><h2 id='related-work'>Related work</h2><p class='share-price'>{STORY}</p><p class='notice'>No text.</p><math>x = 1</math></article>"
    assert main_text(page) == f"Related work\n\n{STORY}\n\nx = 1"


def test_reader_comments_go_even_if_they_are_longer():
    assert main_text(f"<body><div id='text'><p>{STORY}</p></div><div class='comments'>" + f"<p>{STORY} Says a reader.</p>" * 5 + "</div>") == STORY


@pytest.mark.parametrize("around", [
    f"<div class='ad'>{STORY} {STORY}</div>", f"<div class='ads top'><p>{STORY}</p><p>{STORY}</p></div>", f"<div class='sidebar'><p>{STORY}</p><p>{STORY}</p></div>",
    f"<section id='comments'><article><p>{STORY}</p></article><article><p>{STORY}</p></article></section>", f"<div class='share-box'><p>{STORY}</p></div>", f"<div><p>{STORY}</p><p>{STORY}</p></div>",
    "<article class='card'><a href='/x'>Read this next, it is much longer than the story.</a></article>",
])
def test_a_short_article_is_the_text_whatever_is_longer(around):
    short = "<article><h1>Brief.</h1><p>So it is.</article>"
    assert main_text(f"<body>{around}{short}<footer>f</footer></body>") == main_text(f"<body>{short}{around}</body>") == "Brief.\n\nSo it is."


def test_all_of_an_article_is_kept_but_what_is_taken_out():
    page = f"<article><p>{STORY}</p><aside>No.</aside><section><p>Short.</p></section><div class='comments'><p>No.</p></div><blockquote><a href='/'>Linked.</a></blockquote><article class='comment'>No.</article></article>"
    assert main_text(page) == f"{STORY}\n\nShort.\n\nLinked."


def test_several_articles_are_cards():
    cards = "".join(f"<article><p>Card {k}, with a line of text.</p></article>" for k in range(4))
    assert main_text(f"<body><div id='text'><p>{STORY}</p><p>{STORY}</p></div><div><a href='/'>a</a></div><hr><div>{cards}</div></body>").startswith(f"{STORY}\n\n{STORY}")
    assert main_text(f"<body>{cards}<article><p>{STORY}</p><p>{STORY}</p></article></body>") == f"{STORY}\n\n{STORY}"


def menu(n, word="Topic"):
    return "<div class='x1'>" + "".join(f"<div><a href='/{k}'>{word} {k}</a></div>" for k in range(n)) + "</div>"


@pytest.mark.parametrize("before,after", [(menu(8), menu(5, "More") + "<div>Legal notes</div>"), ("<div>Site name</div>" + menu(6), menu(4) + "<div>Imprint</div><div>Contact</div>"), (menu(30), "<p></p>" + menu(30) + "<div>2021 the site</div>")])
def test_surge_and_dive_find_a_story_without_any_known_tag_or_class(before, after):
    story = f"<div class='x2'><div>{STORY}</div><div>Short line.</div><div>{STORY}</div><div>{STORY}</div></div>"
    wanted = f"{STORY}\n\nShort line.\n\n{STORY}\n\n{STORY}"
    page = f"<body>{before}{story}{after}</body>"
    assert main_text(page) == wanted
    assert main_text(page, window=10**6, surge=0) != wanted  # a window over the whole page decides nothing


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_equals_sql_on_every_page(sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '/root/testdata/{sf}/pages.parquet'")
    wanted = dict(con.sql(f"select page_id, text from ({queries.ORACLE_SQL['op6_html_text']})").fetchall())
    assert [i for i, page in con.sql("select page_id, html from pages").fetchall() if main_text(page) != wanted[i]] == []


def test_surge_and_dive_decide_in_main_too():
    page = f"<main><div><a href='/'>Home</a></div><p>By.</p><section><h1>Title</h1><p>{STORY}</p></section>" + "<nav>n</nav><div><p>Tags: x</p></div></main>"
    assert main_text(page) == f"Home\n\nBy.\n\nTitle\n\n{STORY}"


def test_unclosed_elements_take_linear_time():
    began = time.time()
    for piece in ("<li>a</b>", "<div class='ad'><p>x", "<b>x</i>", "<td>x", "<article>x"):
        main_text(piece * 50_000)
    assert time.time() - began < 30
    assert main_text("<ul><li>One<li>Two</ul><table><tr><td>a<td>b<tr><td>c</table>") == "One\n\nTwo\n\na\n\nb\n\nc"


def test_edge_rows(spark):
    rows = [(1, None, None, "t"), (2, "u", "", "t"), (2, "u", "", "t"), (3, "u", "no markup at all", "t"), (None, "u", "<article>" + "<p>word é</p>" * 20_000, "t")]
    out = sorted(extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert [(r.text, r.n_chars) for r in out[:4]] == [("", 0), ("", 0), ("", 0), ("no markup at all", 16)]
    assert out[4].n_chars == 20_000 * 8 - 2 and len(out[4].text) == out[4].n_chars
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
