import time

import pytest

from tagloom.llm import pages

ONE = "The river rose in the night and by the morning it had taken the bridge, the mill and most of the road to the town below."
TWO = "It was not until the third day that the first of the boats could cross, and even then only with the help of ropes from the shore."
THREE = "Nobody in the valley had seen so much water before, and those who had been there in the great flood said that it was worse than this."
COOKIES = "We use cookies to give you the best experience on our site. By going on you accept our use of cookies and the policy."
READER = "I was there on the day and I can tell you that it was nothing like what is written in this article, the bridge was still up."


@pytest.fixture(scope="module")
def stops(spark):
    return pages.stop_words(spark)


ARTICLE = f"<h1>The flood</h1><p>{ONE}</p><p>Ropes.</p><p>{TWO}</p>"
WANT = f"The flood\n{ONE}\nRopes.\n{TWO}"
MENU = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News of the day</a></li></ul>"

CASES = {
    "marked article": f"<html><head><title>The flood</title></head><body><nav>{MENU}</nav><div class='ad'>{THREE}</div><article>{ARTICLE}</article><footer>&copy; 2020 {THREE}</footer>",
    "short article": None,
    "plain boxes": f"<body><div>{MENU}</div><div>{ARTICLE}</div><div><a href=x>About</a> | <a href=y>Contact</a></div><div>&copy; 2020 The Paper</div></body>",
    "named boxes": f"<div id='header'><h2>The Daily Paper</h2>{THREE}</div><div class='sidebar'><p>{THREE}</p></div><div class=post-content>{ARTICLE}</div><div id=site_footer>{THREE}</div>",
    "camel names": f"<div class='cookieNotice'><p>{COOKIES}</p></div><div>{ARTICLE}</div><div class='newsletterSignup'><p>{THREE}</p></div>",
    "comments named": f"<main>{ARTICLE}<section id='comments'><h2>2 comments</h2><p>{READER}</p><p>{READER}</p></section></main>",
    "comments as articles": f"<article>{ARTICLE}</article><div><article class='comment even' id='c-1'><p>{READER}</p></article></div>",
    "comments by heading": f"<div>{ARTICLE}</div><div><h3>12 Comments</h3><p>{READER}</p><p>{READER}</p></div>",
    "forms": f"<article>{ARTICLE}<form action=/s><p>{THREE}</p><input name=q><select><option>One</option></select></form></article>",
    "page in a form": f"<body><form method=post><div>{MENU}</div><div>{ARTICLE}<p>{THREE}</p><p>{THREE}</p><p>{ONE}</p></div></form></body>",
    "roles": f"<div role=banner>{THREE}</div><div role='main'>{ARTICLE}</div><div role='complementary'>{THREE}</div><div role=alert>{THREE}</div>",
    "header in article": f"<header>{THREE}</header><article><header><h1>The flood</h1></header><p>{ONE}</p><p>Ropes.</p><p>{TWO}</p><footer>{THREE}</footer></article>",
    "scripts": f"<article><script>var t='</p>{THREE}';if(a<b){{}}</script><style>p{{content:'<p>'}}</style>{ARTICLE}<noscript>{THREE}</noscript><!-- {THREE} <p> --></article>",
    "hidden": f"<article>{ARTICLE}<div style='display: none'>{THREE}</div><p hidden>{THREE}</p><div aria-hidden=true>{THREE}</div></article>",
    "cut off": f"<nav>{MENU}</nav><article>{ARTICLE}<div class='x",
    "unclosed": f"<div>{MENU}</div><div><h1>The flood<p><b>{ONE}<br><p>Ropes.<p>{TWO}</div><div>© The Paper",
    "related links": f"<article>{ARTICLE}<p><a href=1>Another flood that came in the year after this one and took the other bridge</a></p><p>More: <a href=1>one</a>, <a href=2>the other one</a></p></article>",
    "breaks": f"<div>{MENU}</div><div><h1>The flood</h1>{ONE}<br><br>Ropes.<br/><br />{TWO}</div>",
    "teaser list": f"<article>{ARTICLE}</article><aside><article><h2>Old news</h2><p>{THREE}</p></article></aside>",
    "spaces and references": f"<article><h1> The&nbsp;\n\tflood </h1><p>{ONE.replace(' ', '  ')}</p><p>&#82;op&#101;s&period;</p><p>{TWO}</p></article>",
    "no mark-up at its end": f"<article>{ARTICLE}</article></div></div></body></html> ",
    "odd tags": f"<!DOCTYPE html><?xml version='1'?><article a='>' b=\">\" c=don't>{ARTICLE}</article>",
    "upper case": f"<NAV>{MENU}</NAV><ARTICLE CLASS=Story>{ARTICLE}</ARTICLE><SCRIPT>{THREE}</Script >",
}


@pytest.mark.parametrize("name", [n for n in CASES if CASES[n]])
def test_page(stops, name):
    want = WANT + f"\n{THREE}\n{THREE}\n{ONE}" if name == "page in a form" else WANT
    assert pages.extract(CASES[name], stops) == want


def test_small_pages(stops):
    get = lambda page: pages.extract(page, stops)
    assert get("<article><h1>One.</h1><p><b>One.<br></article><div class=ad>Buy the best of all things here today, for you and for all of us.</div>") == "One.\nOne."
    assert get("<p>Hello &amp; welcome &am") == "Hello & welcome &am"
    assert get("just text 1 < 2 > 0, a <b>w</b>ord") == "just text 1 < 2 > 0, a word"
    assert get(None) == get("") == get(" \n") == get("<html><body></body></html>") == get("<script>x") == get("<!-- x") == ""
    assert get("<nav><a href=x>Home</a></nav>") == ""
    assert get("<table><tr><td>a</td><td>b</td></tr></table>") == "a b"
    assert get("<p>今日は天気がとても良いので、私たちは公園へ行って、お弁当を食べてから、川のそばを歩いて、夕方に家へ帰りました。そして次の日もまた同じ公園へ行きました。</p>").startswith("今日")
    assert get("<![CDATA[a &amp; b]]>") == "a &amp; b"


def test_short_blocks_inherit(stops):
    listed = f"<div><p>{ONE}</p><ul><li>Boats</li><li>Ropes</li></ul><p>{TWO}</p></div><div><p>Share</p><p><a href=x>Mail it to somebody that you know</a></p></div>"
    assert pages.extract(listed, stops) == f"{ONE}\nBoats\nRopes\n{TWO}"
    # a heading goes with what follows it
    heads = f"<div><p>{ONE}</p><h2>After</h2><p>{TWO}</p></div><div><h2>Elsewhere</h2><p><a href=x>{THREE}</a></p></div>"
    assert pages.extract(heads, stops) == f"{ONE}\nAfter\n{TWO}"


def test_words_decide(stops):
    """A block without stop words in a page of a known language is none of its text."""
    goods = "Shirt blue XL 29.99 buy, trousers green M 49.99 buy, socks red S 4.99 buy, jacket black XXL 99.99 buy, hat grey L 19.99 buy"
    assert pages.extract(f"<div><p>{ONE}</p><p>{TWO}</p></div><div><p>{goods}</p></div>", stops) == f"{ONE}\n{TWO}"
    german = "Der Fluss stieg in der Nacht und am Morgen hatte er die Brücke, die Mühle und den größten Teil der Straße in das Tal mitgenommen."
    assert pages.extract(f"<div>{MENU}</div><p>{german}</p>", stops) == german


def test_time_grows_with_the_page(stops):
    odd = ["<div>" * 30_000 + "</span></p>" * 30_000, "<a title=\"" * 30_000, "<" * 100_000, "<!--" * 50_000, "<p " * 50_000, "<a b='" * 30_000 + ">",
           "<div>x</nav>" * 20_000, "</div>" * 50_000, "&" * 100_000, "<p>a b " * 50_000, "<script>" * 50_000, "<svg>" * 20_000]
    for page in odd:
        start = time.time()
        pages.extract(page, stops)
        assert time.time() - start < 5, page[:20]


def test_table(spark, stops):
    rows = [(i, f"u{i}", page, "x", 5) for i, page in enumerate([*CASES.values(), "", "<p>" + "The long story of it. " * 100_000])]
    rows += [rows[0], (None, None, None, "x", 1), (rows[2][0], "again", "<p>Other", "x", 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(3)
    out = pages.main_text(table)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.schema["n_chars"].dataType.simpleString() == "bigint"
    want = [(r[0], r[1], pages.extract(r[2], stops), len(pages.extract(r[2], stops))) for r in rows]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert pages.main_text(table.limit(0)).count() == 0
