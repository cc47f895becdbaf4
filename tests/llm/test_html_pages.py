"""Random pages with a known article, and pages whose article lies in several places."""

import random

import pytest

pytest.importorskip("kindred.llm")
from kindred.llm import html_tree  # noqa: E402

WORDS = "river stone after light, window carries seven gardens over quiet, morning until people remember small things and then walk home".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).strip(",").capitalize() + "."


def paragraphs(rng, n):
    return [" ".join(sentence(rng, rng.randrange(8, 16)) for _ in range(rng.randrange(2, 5))) for _ in range(n)]


def test_columns_in_wrappers_of_their_own():
    rng = random.Random(1)
    for first, second in ((5, 2), (2, 5), (4, 4), (6, 1)):
        a, b = paragraphs(rng, first), paragraphs(rng, second)
        col = lambda ps: f'<div class="col"><div>{"".join(f"<p>{p}</p>" for p in ps)}</div></div>'
        page = f'<html><body><div class="menu"><a href="/">Home</a></div><div>{col(a)}{col(b)}</div><div class="cookie-notice">We use cookies, please agree to them all</div><div>Copyright</div></body></html>'
        assert html_tree.extract(page) == " ".join(a + b)


@pytest.mark.parametrize("depth", [10, 49, 50, 51, 60, 400])
def test_a_deep_nest_of_names_keeps_the_only_text(depth):
    text = paragraphs(random.Random(depth), 1)[0]
    assert html_tree.extract('<div class="ad">' * depth + f"<p>{text}</p>" + "</div>" * depth) == text


def test_controls_in_a_sentence_stay():
    rng = random.Random(2)
    a, b = paragraphs(rng, 2)
    page = f"<article><p>{a} Press <button>Save</button> or the <label>Name</label> field.</p><p>{b}</p><p><button>Share</button></p><form><p>Your <label>mail</label> here <button>Go</button> now</p></form></article>"
    assert html_tree.extract(page) == f"{a} Press Save or the Name field. {b}"


def build(rng):
    """(page, article text): article blocks in nested elements, other parts around and between them."""
    out = []

    def block():
        kind = rng.choice(["p", "p", "p", "h2", "ul", "bq", "inline"])
        ps = paragraphs(rng, 1)
        if kind == "h2":
            t = sentence(rng, 4)
            out.extend([t, *ps])
            return f"<h2>{t}</h2><p>{ps[0]}</p>"
        if kind == "ul":
            items = [sentence(rng, 9) for _ in range(3)]
            out.extend([*ps, *items])
            return f"<p>{ps[0]}</p><ul>" + "".join(f"<li>{i}" for i in items) + "</ul>"
        out.extend(ps)
        if kind == "bq":
            return f"<blockquote><p>{ps[0]}</p></blockquote>"
        if kind == "inline":
            w = ps[0].split(" ", 2)
            return f"<p>{w[0]} <em>{w[1]}</em> {w[2]}</p>"
        return f"<p>{ps[0]}</p>"

    def junk():
        return rng.choice([
            '<div class="ad-banner">Buy now, it is cheap, very cheap</div>', "<aside>See also our other pages</aside>", '<div class="share-buttons"><a href="#">Like</a> <a href="#">Send</a></div>',
            "<script>var x = '<p>no</p>';</script>", "<form>Mail: <input><button>Join</button></form>", '<div class="newsletter">Get our letter every week</div>',
            '<ul class="related">' + '<li><a href="/x">Another story of ours</a>' * 4 + "</ul>", "",
        ])

    def part(depth):
        body = "".join(block() + junk() * (rng.random() < 0.3) for _ in range(rng.randrange(1, 4)))
        for _ in range(rng.randrange(depth + 1)):
            body = f'<div class="{rng.choice(["c", "inner", "body-text"])}">{body}</div>'
        return body

    body = "".join(part(2) for _ in range(rng.randrange(2, 4)))
    wrapper = rng.choice(["article", "main", "div", "section"])
    body = f"<{wrapper}>{body}</{wrapper}>"
    head = '<header><h1>Site</h1></header><nav><a href="/a">A</a> <a href="/b">B</a></nav>'
    tail = '<div id="comments"><p>I like it, very much indeed, thanks a lot for it</p></div><footer>Copyright, all rights</footer>'
    return f"<html><head><title>t</title></head><body>{head}{junk()}{body}{tail}</body></html>", " ".join(out)


def test_random_pages():
    rng = random.Random(7)
    wrong = 0
    for _ in range(2000):
        page, want = build(rng)
        wrong += html_tree.extract(page) != want
    assert wrong == 0
