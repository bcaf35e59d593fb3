"""Pages labelled by hand: what the extractor must give for each."""

import pytest

from vaultflow.llm import html_extract

A = "The harbour was quiet when the first boats came in, and nobody had yet opened the shops."
B = "By noon the square was full of people, carts and dogs, all of them louder than the day before."
C = "Nobody could say later who had rung the bell, but all agreed that it had been rung twice."
AD = "Our new phones are faster, lighter and cheaper than ever, so come and see them in our shop today."
SAID = "I was there that day and I can tell you that the dogs were not half as loud as you say."
NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/news'>News</a></li></ul></nav>"
FOOT = "<footer><p>Copyright by the harbour news, all rights reserved, no part may be printed again.</p></footer>"

PAGES = {
    "plain article": (f"{NAV}<article><h1>The Bell</h1><p>{A}</p><p>{B}</p></article>{FOOT}", ["The Bell", A, B]),
    "main instead of article": (f"<header><h2>Harbour News</h2></header><main><h1>The Bell</h1><p>{A}</p><p>{C}</p></main>{FOOT}", ["The Bell", A, C]),
    "role main": (f"<div role=navigation><a href=/>Home</a></div><div role='main'><h1>Bell</h1><p>{A}</p></div><div role=contentinfo>{AD}</div>", ["Bell", A]),
    "short blocks in an article": (f"<article><h1>Bell</h1><p>No.</p><p>{A}</p><p>Yes</p></article>", ["Bell", "No.", A, "Yes"]),
    "advert in the article": (f"<article><p>{A}</p><div class='ad-slot'><p>{AD}</p><p>{AD}</p></div><p>{B}</p></article>", [A, B]),
    "advert before the article": (f"<div id=sponsored><h3>Phones</h3><p>{AD}</p></div><article><p>{A}</p></article>", [A]),
    "promotion without a name": (f"<article><p>{A}</p><p>{B}</p></article><div><p>{AD}</p></div>", [A, B]),
    "reader comments": (f"<article><p>{A}</p></article><section id='comments'><h2>Comments</h2><ol><li><p>{SAID}</p></li><li><p>{SAID}</p></li></ol></section>", [A]),
    "comments as articles": (f"<article><p>{A}</p><ol class='comment-list'><li><article class=body><p>{SAID}</p><p>{SAID}</p></article></li></ol></article>", [A]),
    "container with a doubtful name": (f"<div class='widget-area search-results post'><article><h1>Bell</h1><p>{A}</p></article></div>", ["Bell", A]),
    "body with a name": (f"<body class='has-sidebar with-comments'><article><p>{A}</p></article><aside><p>{AD}</p></aside></body>", [A]),
    "cookie notice": (f"<div class='cookie-notice'><p>We use cookies to make this site better for all of our readers, wherever they are.</p></div><article><p>{A}</p></article>", [A]),
    "form in the article": (f"<article><p>{A}</p><form><p>Tell us your address and we send you our letter each week.</p><label>Mail</label><input></form><p>{B}</p></article>", [A, B]),
    "list in the article": (f"<article><p>{A}</p><ul><li>one boat</li><li>two carts<li>three dogs</ul><p>{B}</p></article>", [A, "one boat", "two carts", "three dogs", B]),
    "links in the article": (f"<article><p>{A}</p><p><a href=/bell>The whole story of the bell</a></p><p>{B}</p></article>", [A, "The whole story of the bell", B]),
    "table and figure": (f"<article><p>{A}</p><figure><img src=x><figcaption>The square</figcaption></figure><table><tr><td>boats</td><td>12</td></tr></table><p>{B}</p></article>", [A, "The square", "boats", "12", B]),
    "header in the article": (f"<header><p>Harbour News, the paper of the coast and of the islands since the old days.</p></header><article><header><h1>Bell</h1></header><p>{A}</p></article>", ["Bell", A]),
    "no article at all": (f"<div class=nav><a href=/>Home</a> <a href=/n>News</a></div><div><h1>The bell of the harbour town</h1><p>{A}</p><p>{B}</p></div><div class=footer>Imprint</div>", ["The bell of the harbour town", A, B]),
    "links around plain text": (f"<ul><li><a href=1>Boats for sale</a></li><li><a href=2>Carts for sale</a></li></ul><p>{A}</p><p>{B}</p><ul><li><a href=3>Older news</a></li><li><a href=4>Newer news</a></li></ul>", [A, B]),
    "hidden text": (f"<article><p>{A}</p><p style='display: none'>{AD}</p><div hidden><p>{AD}</p></div><p>{B}</p></article>", [A, B]),
    "sidebar in main": (f"<main><div class='content'><p>{A}</p><p>{B}</p></div><div class='sidebar'><h4>Most read</h4><p>{AD}</p></div></main>", [A, B]),
    "related posts": (f"<article><p>{A}</p></article><div class='related'><article><h3>Boats</h3><p>{AD}</p></article></div>", [A]),
    "scripts": (f"<article><p>{A}</p><script src='x'/>var a = '<p>{AD}</p>';</SCRIPT ><style>p{{}}</style><p>{B}</p></article>", [A, B]),
    "letters that grow in lower case": (f"<p>{'İ' * 12} {A}</p><script>var t = 1;</script><p>{B}</p>", [f"{'İ' * 12} {A}", B]),
    "references and white space": ("<article><p>Fish &amp; chips\n\t cost &euro;5&#33; &#x263A; and   the sea was <b>blue</b><br>that day.</p></article>", ["Fish & chips cost €5! ☺ and the sea was blue that day."]),
    "two articles": (f"<main><article><h2>One</h2><p>{A}</p></article><article><h2>Two</h2><p>{B}</p></article></main>", ["One", A, "Two", B]),
    "deep containers": (f"<article>{'<div>' * 40}<p>{A}</p>{'</div>' * 40}<div><div><p>Short.</p></div></div></article>", [A, "Short."]),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, want = PAGES[name]
    assert html_extract.main_text(html) == "\n\n".join(want)


def test_the_cut_decides():
    """Many labels differ from the sign of the block's own cost."""
    changed = total = 0
    for html, _ in PAGES.values():
        page = html_extract.Page(html)
        costs, _ = html_extract.graph(page)
        side = html_extract.labels(page)
        changed += sum((z > 0) != k for z, k in zip(costs, side, strict=False))
        total += len(side)
    assert changed > total / 5


@pytest.mark.parametrize("html", ["</b>" * 20000, "<i><p>" + "<b>" * 10000 + "</i>" * 10000, "<div>" * 20000 + "x", "<p>word word" * 20000, "<div><p>Many words that end here. " * 4000, "<article>" + "<div class=ad>x</div><p>Many words that end here." * 4000])
def test_tag_soup_takes_linear_time(html):
    import time

    t = time.time()
    html_extract.main_text(html)
    assert time.time() - t < 10
