"""Whatever stands beside the best container is kept, menus of links are not."""

import pytest

pytest.importorskip("kindred.llm")
from kindred.llm import html_tree  # noqa: E402


def test_short_and_unusual_siblings_are_kept():
    many = "".join(f"<p>Sentence {k} is long and goes on for a good while so that it scores well enough to be the best.</p>" for k in range(40))
    parts = ["<p>short lead</p>", "<h3>Part</h3>", f"<div>{many}</div>", "<ul><li>one</li><li>two</li></ul>", "<table><tr><td>cell</td></tr></table>", "<dl><dt>term</dt><dd>sense</dd></dl>", "bare <b>text</b> with a <a href=x>link</a> in it", "<p>short end</p>"]
    page = "<html><body><div>" + "".join(parts) + "<ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul><a href=c>More</a></div></body></html>"
    long = " ".join(f"Sentence {k} is long and goes on for a good while so that it scores well enough to be the best." for k in range(40))
    assert html_tree.extract(page) == f"short lead Part {long} one two cell term sense bare text with a link in it short end"
