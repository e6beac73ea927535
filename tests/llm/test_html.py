"""Main text of pages made from a known truth, with the clusters of ratios and without."""

from __future__ import annotations

import html as entities
import random
import time

import pytest
from textlathe.llm import html_text as X

SENTENCE = "The harbour was quiet in the morning, and the boats came home one by one with what they had caught."
BODY = [f"{SENTENCE} {SENTENCE} Paragraph {i}." for i in range(4)] + ["Short end."]
TEXT = "\n".join(["A headline", *BODY])
FLOW = "<h1>A headline</h1>" + "".join(f"<p>{t}</p>" for t in BODY)
MENU = "<ul>" + "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(8)) + "</ul>"
AROUND = f"<nav>{MENU}</nav>%s<footer>Copyright and other words of the footer</footer>"


@pytest.mark.parametrize("name", ["layout has-sidebar", "content with-comments", "post social-media", "wrapper no-banner", "article-related", "layoutSidebar", "header", "ad", "cookie-wall"])
@pytest.mark.parametrize("tag", ["div", "section"])
@pytest.mark.parametrize("inner", [f"<article>{FLOW}</article>", f"<main>{FLOW}</main>", FLOW])
def test_no_class_of_a_wrapper_empties_a_page(name, tag, inner):
    assert X.main_text(AROUND % f'<{tag} class="{name}">{inner}</{tag}>') == TEXT
    assert X.main_text(AROUND % f'<{tag} id="{name}">{inner}</{tag}>') == TEXT


@pytest.mark.parametrize("extra", ['<div class="ad">Buy a boat now, cheap, from the best shop in the whole town!</div>', '<div class="cookie-notice">We use cookies.</div>', '<div id="newsletter-signup">Get our letter</div>', "<form>Name <input> <label>Mail</label><button>Send</button></form>", "<aside>More of this kind</aside>", '<p hidden>unseen</p>', '<span class="advert">Buy</span>', "<!-- gone --><script>x()</script><style>p{}</style>", '<div style="display: none">unseen</div>'])
def test_what_is_no_article_goes_from_within(extra):
    assert X.main_text(AROUND % f"<article>{FLOW.replace('<p>Short', extra + '<p>Short')}</article>") == TEXT


def test_comments_go_even_if_they_are_longer():
    comments = "".join(f"<article class=comment><p>{SENTENCE} {SENTENCE} {SENTENCE}</p></article>" for _ in range(9))
    for body in (f"<article>{FLOW}</article>", f"<div>{FLOW}</div>"):
        assert X.main_text(AROUND % f"{body}<section class=comments>{comments}</section>") == TEXT


def test_headlines_outside():
    flow = FLOW.removeprefix("<h1>A headline</h1>")
    assert X.main_text(f"<title>A headline | Site</title><header><h1>A headline</h1><nav>{MENU}</nav></header><article>{flow}</article>") == TEXT
    assert X.main_text(f"<title>Other</title><header><h1>Site</h1></header><article>{FLOW}</article>") == TEXT
    assert X.main_text(AROUND % f"<div><h1>A headline</h1><div>{MENU}</div><div>{flow}</div></div>") == TEXT
    assert X.main_text(AROUND % f'<section id="related-work">{FLOW}</section>') == TEXT


def test_text_in_several_regions_stays():
    long, short = "".join(f"<p>{t}</p>" for t in BODY[:3]), f"<p>{BODY[3]}</p>"
    page = AROUND % f"<div><h1>A headline</h1>{long}</div><div>{short}<p>Short end.</p></div>"
    assert X.main_text(page) == TEXT
    teaser = "<article><h2><a href=/x>Read on</a></h2></article>"
    assert X.main_text(AROUND % f"<div>{FLOW}</div>{teaser}") == TEXT


def test_plain_divs_are_paragraphs():
    divs = "".join(f"<div>{t}</div>" for t in BODY)
    assert X.main_text(AROUND % f"<div><h1>A headline</h1>{divs}</div>") == TEXT
    assert X.main_text(f"<h1>A headline</h1><div><a href=/>Terms</a> <a href=/x>Help</a></div>{divs}<div class=footer>Us</div>") == TEXT


def test_ratios_decide_where_names_do_not():
    """Plain elements only: with the clusters the article alone is left, without them all is."""
    page = f"<div>{MENU * 9}</div><div>{FLOW}</div><div><a href=/>Terms</a> <a href=/>Help</a></div>"
    assert X.main_text(page) == TEXT
    assert X.main_text(page, clustered=False) != TEXT


def made_page(rng: random.Random) -> tuple[str, str]:
    """A page and the text of its article, by the rules of the operator: one of three layouts, and things left out at
    random places."""
    words = "boat sea wind & rope <knot> harbour été Fähre".split()
    blocks = ["Heading " + str(rng.randrange(99))] + [" ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 80, 120]))) for _ in range(rng.randrange(3, 9))]
    blocks[1] = " ".join(rng.choice(words) for _ in range(60))
    space = lambda t: t.replace(" ", rng.choice([" ", "\n", " \t "]), 3)
    parts = [f"<h1>{entities.escape(blocks[0])}</h1>"]
    for text in blocks[1:]:
        cut = space(entities.escape(text).replace("é", "&eacute;").replace("ä", "&#228;"))
        parts.append(rng.choice(["<p>%s</p>", "<p>%s", "<p><b>%s</b></p>", "<blockquote>%s</blockquote>"]) % cut)
        parts.append(rng.choice(["", "", "<div class='ad'>Buy a rope today</div>", "<script>var a = '<p>'</script>", "<!-- x -->"]))
    flow = "".join(parts)
    body = rng.choice(["<article>%s</article>", "<main>%s</main>", "<div class='page with-sidebar'>%s</div>", "<div>%s</div>"]) % flow
    return f"<html><head><title>{blocks[0]}</title></head><body><nav>{MENU}</nav>{body}<footer>The footer of the page</footer></body></html>", "\n".join(blocks)


@pytest.mark.parametrize("seed", range(40))
def test_made_pages(seed):
    page, expected = made_page(random.Random(seed))
    assert X.main_text(page) == expected


@pytest.mark.parametrize("start", ["<div>a b c", "<h1>a", "<span><b>", "<p>x", "<li>y", "<div class=ad>z", "<a><div>", "</b>"])
def test_time_is_linear_in_nesting(start):
    begun = time.monotonic()
    X.main_text(start * 50_000)
    assert time.monotonic() - begun < 20


PROSE = "Here the writer goes on for a while about nothing in particular, so that the paragraph has a length that is usual. "


@pytest.mark.parametrize("n", [2, 3, 5, 10])
@pytest.mark.parametrize("sizes", [(3,), (1, 6, 2), (8, 1)])
def test_all_articles_of_a_page(n, sizes):
    made = [(f"Heading number {i}", [f"{i}-{j} {PROSE * 2}".strip() for j in range(sizes[i % len(sizes)])]) for i in range(n)]
    articles = "".join(f"<article><h2>{h}</h2>{''.join(f'<p>{p}</p>' for p in ps)}</article>" for h, ps in made)
    menu = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class=crumbs><a href=/>Up</a> <a href=/c>On</a></div>"
    page = f"<html><body>{menu}<div>{articles}</div><footer>Copyright</footer></body></html>"
    assert X.main_text(page).split("\n") == [line for h, ps in made for line in (h, *ps)]


@pytest.mark.parametrize("small", [1, 2])
def test_small_regions_beside_a_large_one(small):
    large = "".join(f"<p>{i} {PROSE * 4}</p>" for i in range(7))
    short = [f"{k} {PROSE * small}".strip() for k in range(4)]
    page = f"<body><div class=menu><a href=/>Home</a> <a href=/x>More</a></div><div><div>{large}</div>{''.join(f'<div><p>{s}</p></div>' for s in short)}</div></body>"
    found = X.main_text(page).split("\n")
    assert found[-4:] == short and len(found) == 11


@pytest.mark.parametrize("piece", ["<a ", "<a href='", "<!--", "<!-- x> ", '<a x=">" ', "<b>x ", "<div>", "</"])
def test_unfinished_tags_take_time_in_proportion(piece):
    def took(size: int) -> float:
        start = time.perf_counter()
        X.main_text("<p>" + PROSE + piece * (size // len(piece)))
        return time.perf_counter() - start

    took(1000)
    assert took(1_000_000) < max(4.0, 16 * took(250_000))
