"""Main text of made pages with every kind of furniture."""
import numpy as np
import pytest

from lanewise.llm import html_regions as hr

LONG = "This paragraph has a fair number of words so that its ratio of text to tags is high enough to vote. "
FURNITURE = ['<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>', '<header><h2>Site name</h2><a href="/">start</a></header>',
             '<div class="ad">Buy now, a very long advertisement with many many words that go on and on and on.</div>', '<aside><p>' + LONG + '</p></aside>',
             '<div class="sidebar"><p>' + LONG + '</p></div>', '<div id="cookie-notice">We use cookies. ' + LONG + '</div>',
             '<form action="/s"><label>Search</label><input name="q"><button>Go</button></form>', '<script>var a = "<p>no</p>";</script>', '<style>p > a {color: red}</style>',
             '<section class="comments"><div class="comment"><p>First! ' + LONG + '</p></div></section>', '<!-- <p>remark</p> -->', '<noscript><p>Turn on scripts. ' + LONG + '</p></noscript>',
             '<div class="related-posts"><a href="/x">Another story</a></div>', '<footer><p>&copy; 2024 ' + LONG + '</p></footer>', '<div style="display:none">hidden ' + LONG + '</div>']


def page(body):
    return f"<!DOCTYPE html><html><head><title>Title</title></head><body>{body}</body></html>"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div id="wrap"><div class="post-content">{}</div></div>'])
def test_furniture_is_left_out_and_short_blocks_stay(wrap):
    text = f"<h1>Head &amp; line</h1><p>{LONG}</p><p>Short.</p><ul><li>one</li><li>two <b>bold</b></li></ul><p>{LONG}<br>after\n\t break &nbsp; &#8364;</p><blockquote>{LONG}</blockquote>"
    want = "\n".join(["Head & line", LONG.strip(), "Short.", "one", "two bold", LONG.strip() + " after break €", LONG.strip()])
    around = FURNITURE[:7] if "article" not in wrap and "main" not in wrap else FURNITURE
    assert hr.main_text(page("".join(around) + wrap.format(text) + "".join(reversed(around)))) == want


def test_furniture_inside_the_article():
    inside = '<div class="share-buttons"><a href="#">Share</a></div><div class="ad">advert</div><aside>note</aside><script>1</script><figure class="newsletter">sign up</figure>'
    assert hr.main_text(page(f"<article><p>{LONG}</p>{inside}<p>End.</p></article>")) == f"{LONG.strip()}\nEnd."


def test_broken_markup():
    assert hr.main_text(f"<article><h1>T<p><b>{LONG}<br><p>two<p>three</article><footer>x") == f"T\n{LONG.strip()}\ntwo\nthree"
    assert hr.main_text(f"<nav><a href=x>menu<article><p>{LONG}") == LONG.strip()
    assert hr.main_text("<p>a < b && c > d</p>") == "a < b && c > d"
    assert hr.main_text("plain text only") == "plain text only"


@pytest.mark.parametrize("body, want", [
    ('<h2 id="related-work">Related work</h2><p>{0}</p><h2 id="cookies">Cookies</h2><p>{0}</p>', "Related work|L|Cookies|L"),
    ('<section id="related-work"><h2>Related</h2><p>{0}</p><p>{0}</p></section>', "Related|L|L"),
    ('<p class="share-price">The shares {0}</p>', "The shares L"),
    ('<ul class="menu"><li>Soup of the day with bread</li><li>Roast beef with potatoes</li></ul>', "Soup of the day with bread|Roast beef with potatoes"),
    ('<ul class="menu"><li><a href="/">Home of the site</a></li><li><a href="/x">More of the site</a></li></ul>', ""),
    ('<p>{0}</p><aside class="pull-quote"><p>{0}</p></aside><p>{0}</p>', "L|L|L"),
    ('<section id="related-posts"><a href="/x">More</a><a href="/y">Other</a></section>', ""),
    ('<section id="comments"><p>{0}</p></section><div class="comment-list"><p>{0}</p></div><div id="cookie-notice"><p>{0}</p></div>', "")])
def test_doubtful_names_are_decided_by_their_lines(body, want):
    got = hr.main_text(page(f"{FURNITURE[0]}<article><h1>Head</h1><p>{LONG}</p><p>{LONG}</p>{body.format(LONG)}<p>{LONG}</p><p>{LONG}</p></article>"))
    assert got.replace(LONG.strip(), "L").split("\n") == ["Head", "L", "L", *want.split("|") * bool(want), "L", "L"]


def test_a_teaser_article_is_not_the_page():
    assert hr.main_text(page(f"<main><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><article><p>teaser {LONG}</p></article></main>")).startswith(f"Head\n{LONG.strip()}\n{LONG.strip()}")
    assert hr.main_text(page(f"<main><h2>News</h2><article><p>{LONG}</p><p>{LONG}</p></article></main>")) == f"{LONG.strip()}\n{LONG.strip()}"


def labelled_pages(count, seed=3):
    """(page, its content blocks): paragraphs, headings, lists and quotes between furniture, some with names that may be either."""
    rng, words = np.random.default_rng(seed), "river stone market letter garden winter bridge harbour music paper window engine valley silver teacher story".split()
    prose = lambda low, high: " ".join(rng.choice(words, rng.integers(low, high))).capitalize() + "."
    links = lambda: "".join(f'<a href="/{i}">{prose(1, 4)}</a> ' for i in range(rng.integers(2, 5)))
    for _ in range(count):
        parts, want = [], []
        for _ in range(rng.integers(6, 14)):
            kind = int(rng.integers(0, 9))
            text = prose(20, 60)
            if kind < 4:
                parts.append(f"<p>{text}</p>")
            elif kind == 4:
                text = prose(2, 6)
                parts.append(f'<h2 id="{rng.choice(["related", "comments", "part"])}-{rng.integers(9)}">{text}</h2>')
            elif kind == 5:
                parts.append(f'<section id="{rng.choice(["share", "related", "notice"])}-of-{rng.choice(words)}"><p>{text}</p></section>')
            elif kind == 6:
                parts.append(f'<p class="{rng.choice(["social", "promo", "share"])}-{rng.choice(words)}">{text}</p>')
            elif kind == 7:
                text = None
                parts.append(f'<section id="{rng.choice(["share", "related", "social"])}-{rng.choice(words)}">{links()}</section>')
            else:
                text = None
                parts.append(f'<p class="{rng.choice(["social", "promo", "share"])}-{rng.choice(words)}">{links()}</p>')
            want += [text] if text else []
        around = list(rng.permutation(FURNITURE))
        yield page("".join(around[:7]) + "<article>" + "".join(parts) + "</article>" + "".join(around[7:])), want


def block_scores(pages):
    hit = found = wanted = 0
    for html, want in pages:
        got = [x for x in hr.main_text(html).split("\n") if x]
        hit += len(set(got) & set(want))
        found, wanted = found + len(got), wanted + len(want)
    return hit / found, hit / wanted


def test_precision_and_recall_on_labelled_pages_and_what_the_ratio_adds(monkeypatch):
    pages = list(labelled_pages(80))
    precision, recall = block_scores(pages)
    assert precision > 0.97 and recall > 0.97, (precision, recall)
    monkeypatch.setattr(hr, "threshold", lambda v: -1.0)  # one cluster
    monkeypatch.setattr(hr.Lines, "handle_data", lambda self, data: self.pieces.append(data))  # links count as text
    flat = block_scores(pages)
    assert sum(flat) < precision + recall - 0.1, flat


def test_smoothing_and_threshold():
    v = np.array([1.0, 1, 1, 50, 60, 55, 1, 1])
    assert hr.smoothed(np.ones(5)).tolist() == pytest.approx([1] * 5)
    cut = hr.threshold(v)
    assert 1 < cut < 50 and hr.threshold(np.array([3.0, 3.0])) == 3


def test_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", page(f"<article><p>{LONG}</p></article>")), (3, "u", page(f"<article><p>{LONG}</p></article>")),
            (4, "u", "<p>" + "long " * 200_000), (None, "u", "<article>x</article>"), (5, "u", "<nav>only</nav>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text) for r in hr.extract(pages).collect())
    assert got == sorted([(1, ""), (2, ""), (3, LONG.strip()), (3, LONG.strip()), (4, ("long " * 200_000).strip()), (0, "x"), (5, "")])
    assert hr.extract(pages.limit(0)).count() == 0
