import random

from tidegraph.llm.html_text import extract, main_text

PARAGRAPH = "Running text of some length with words and words, which goes on for a while until it ends here. " * 2


def page(body, lang="en"):
    return f"<!DOCTYPE html><html lang={lang}><head><title>T</title><style>p{{a:b}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


MENU = "<nav><ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(8)) + "</ul></nav>"
FOOT = "<footer>&copy; Someone &middot; Imprint</footer>"


def test_article_element():
    body = MENU + '<div class="ad">Buy now ' + "x " * 80 + "</div><article><h1>Head &amp; line</h1><p>" + PARAGRAPH + "<p><b>bold</b> and\n\n <i>more</i><br>after</p><p>The.</p></article>" + FOOT
    assert main_text(page(body)) == "\n".join(["Head & line", PARAGRAPH.strip(), "bold and more after", "The."])


def test_clutter_inside_and_around():
    body = (
        "<header>Site name</header>" + MENU + "<main><article><header><h1>Title</h1></header>"
        f"<p>{PARAGRAPH}</p><aside>Side note</aside><form><label>Mail</label><input></form>"
        f'<div class="newsletter-signup">Subscribe</div><p>{PARAGRAPH}</p>'
        '<section class="comments"><h2>Comments</h2><article><p>' + "I think so too. " * 40 + "</p></article></section>"
        '</article></main><div id="cookie-notice">We use cookies</div>' + FOOT
    )
    assert main_text(page(body)) == "\n".join(["Title", PARAGRAPH.strip(), PARAGRAPH.strip()])


def test_without_article_element():
    body = MENU + "<div id='top'>Hi</div>" + "".join(f"<div><p>{PARAGRAPH}{i}</p></div>" for i in range(6)) + MENU + FOOT
    found = main_text(page(body)).split("\n")
    assert [f"{PARAGRAPH}{i}" for i in range(6)] == [x for x in found if x.startswith("Running")] and len(found) == 6


def made_page(draw, article=True):
    """A page with clutter of all kinds, and what a reader would call its text."""
    words = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randrange(1, 9))) for _ in range(n))
    blocks, text = [], []

    def put(tag, body, inner=None):
        blocks.append(f"<{tag}>{inner or body}</{tag}>" if draw.random() < 0.7 or tag != "p" else f"<{tag}>{inner or body}")
        text.append(body)

    put("h1", words(6))
    for _ in range(draw.randrange(3, 9)):
        kind = draw.random()
        if kind < 0.6:
            body = words(draw.choice([30, 60, 120]))
            first, _, rest = body.partition(" ")
            put("p", f"{first} {rest} & more", f"<b>{first}</b>\n\n {rest} &amp; <a href='#'>more</a>")
        elif kind < 0.7:
            put("h2", words(3))
        elif kind < 0.8:
            put("p", words(1))
        elif kind < 0.9:
            items = [words(8) for _ in range(3)]
            blocks.append("<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>")
            text.extend(items)
        else:
            cells = [words(2) for _ in range(4)]
            blocks.append("<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in (cells[:2], cells[2:])) + "</table>")
            text.extend(cells)
        if draw.random() < 0.3:
            blocks.append(draw.choice([f'<div class="advert">{words(20)}</div>', f"<aside>{words(30)}</aside>", f"<form><label>{words(3)}</label><input></form>", f"<script>{words(9)}</script>"]))
    put("p", words(40))
    inside = "".join(blocks)
    remarks = '<section id="comments">' + "".join(f"<article><p>{words(50)}</p></article>" for _ in range(draw.randrange(3))) + "</section>"
    body = "<header>Site</header>" + MENU + f'<div id="cookie-banner"><p>{words(25)}</p></div>' + (f"<article>{inside}</article>" if article else inside) + remarks
    return page(body + f'<div class="sidebar"><p>{words(30)}</p></div>' + FOOT), "\n".join(text)


def test_made_pages_against_their_text():
    """With the element that marks an article, and without it, where the ratios alone find it."""
    draw = random.Random(6)
    assert all(main_text(h) == t for h, t in (made_page(draw) for _ in range(150)))
    bare = [made_page(draw, article=False) for _ in range(150)]
    assert sum(main_text(h) == t for h, t in bare) >= 0.95 * len(bare)


def test_sibling_articles_tables_and_named_blocks():
    two = f"<article><h2>One</h2><p>{PARAGRAPH}</p></article><article><h2>Two</h2><p>{PARAGRAPH}</p></article>"
    assert main_text(page(MENU + two + FOOT)) == "\n".join(["One", PARAGRAPH.strip(), "Two", PARAGRAPH.strip()])
    table = f"<div id=text><p>{PARAGRAPH}</p><table><tr><td>a</td><td>1</td></tr></table><div>Caption.</div><p>{PARAGRAPH}</p></div>"
    assert main_text(page(MENU + table + FOOT)) == "\n".join([PARAGRAPH.strip(), "a", "1", "Caption.", PARAGRAPH.strip()])
    named = f'<div class="side-story print"><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div>'
    assert main_text(page(MENU + named + FOOT)) == "\n".join([PARAGRAPH.strip()] * 2)
    remark = f'<article><p>{PARAGRAPH}</p></article><article class="comment"><p>{PARAGRAPH}</p></article>'
    assert main_text(page(remark)) == PARAGRAPH.strip()
    deep = "<div>" * 30000 + f"<p>{PARAGRAPH}</p>" + "</section></b>" * 30000
    assert main_text(deep) == PARAGRAPH.strip()


def test_odd_pages():
    assert [main_text(x) for x in (None, "", "<html></html>", "<script>x</script>", "<nav>only</nav>")] == [""] * 5
    assert main_text("just words") == "just words"
    assert main_text("<p>a&nbsp;b &lt;c&gt; &#233;") == "a b <c> é"
    assert main_text("<nav><ul><li>x<article><p>" + PARAGRAPH) == PARAGRAPH.strip()
    long = "<article>" + f"<p>{PARAGRAPH}</p>" * 2000 + "</article>"
    assert main_text(long).count("\n") == 1999


def test_noise_never_crashes():
    draw = random.Random(1)
    parts = ["<", ">", "</", "<p", "<p>", "<!--", "-->", "<![CDATA[", "]]>", "<!", "<?", "&", "&#x", "&#99999999;", "a b", '"', "'", "=", "<script>", "</script>", "<article>", "</article>", "<nav>", "\x00", "é"]
    for _ in range(1500):
        main_text("".join(draw.choice(parts) for _ in range(draw.randrange(25))))


def test_table(spark):
    rows = [(1, "u", "<p>x y</p>", 5), (1, "u", "<p>x y</p>", 5), (None, None, None, 6)]
    found = extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text int"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == [(1, "u", "x y", 3), (1, "u", "x y", 3), (None, None, "", 0)]
    assert extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
