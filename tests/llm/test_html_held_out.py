"""Pages written by hand, of layouts and names that the training grammar does not share, with the text that is theirs."""

import re

import pytest

from sparsefold.llm import html_extract

ONE = "The river rises in the hills above the town, where three small springs meet in a meadow, and it reaches the sea some ninety miles further on."
TWO = "In spring the water is high enough to float timber, which is why the first mills were built here, and their walls still stand beside the weir."
THREE = "Fishing is allowed from the western bank only. Visitors need a permit, which the post office sells for a small fee on weekdays."

#: Layouts: {m} stands for the attributes of the main text's block, {c} for those of the other blocks.
LAYOUTS = {
    "menu list above": ("<body><div{c}><ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>Maps</a></ul></div><div{m}><h1>The river</h1><p>ONE</p><p>TWO</p></div><div{c}>Copyright 2019 River Society</div></body>", "The river ONE TWO"),
    "more links below": ("<body><div{m}><h1>The river</h1><p>ONE</p><p>THREE</p></div><div{c}><h3>More</h3><ul><li><a href=1>Ten walks near the coast</a></li><li><a href=2>Where to stay</a></li><li><a href=3>The old mill</a></li></ul></div></body>", "The river ONE THREE"),
    "three columns": ("<body><table><tr><td{c}><a href=1>Start</a><br><a href=2>Weather</a><br><a href=3>Tides</a></td><td{m}><h2>The river</h2><p>ONE</p><p>TWO</p><p>THREE</p></td><td{c}><a href=4>Archive</a><br><a href=5>Letters</a><br><a href=6>Shop</a></td></tr></table></body>", "The river ONE TWO THREE"),
    "bar of words": ("<body><div{m}><p>ONE</p><p>TWO</p><p>THREE</p></div><div{c}>Contact us | Terms</div></body>", "ONE TWO THREE"),
    "leading paragraph of links": ("<body><p{c}><a href=1>Home</a> | <a href=2>About</a> | <a href=3>Contact</a></p><div{m}><h1>The river</h1><p>TWO</p><p>ONE</p></div></body>", "The river TWO ONE"),
    "column beside": ("<body><div><div{m}><h1>The river</h1><p>ONE</p><p>TWO</p></div><div{c}><h4>Sections</h4><ul><li><a href=1>Sport</a><li><a href=2>Culture</a><li><a href=3>Money</a><li><a href=4>Travel</a></ul></div></div></body>", "The river ONE TWO"),
    "trail of links": ("<body><div{c}><a href=1>Home</a> &gt; <a href=2>Nature</a> &gt; Rivers</div><section{m}><h1>The river</h1><p>ONE</p><ul><li>Length: ninety miles</li><li>Source: three springs</li></ul><p>THREE</p></section></body>", "The river ONE Length: ninety miles Source: three springs THREE"),
    "older and newer": ("<body><div{m}><h2>The river</h2><p>ONE</p><p>TWO</p></div><div{c}><a href=1>Older post</a> <a href=2>Newer post</a></div><div{c}>&copy; 2021 A. Writer</div></body>", "The river ONE TWO"),
    "table with a head row": ("<body><table><tr><td{c}><a href=1>Index</a> <a href=2>Search</a> <a href=3>Help</a></td></tr><tr><td{m}><p>ONE</p><p>TWO</p><p>THREE</p></td></tr></table></body>", "ONE TWO THREE"),
    "search box": ("<body><div{c}><label>Search</label><input name=q><button>Go</button></div><div{m}><h1>The river</h1><p>ONE</p><blockquote>TWO</blockquote></div></body>", "The river ONE TWO"),
    "wrapped deeply": ("<body><div><div><div{c}><div><a href=1>Front page</a></div><div><a href=2>World</a></div><div><a href=3>Science</a></div></div><div><div{m}><h1>The river</h1><p>ONE</p><h2>Mills</h2><p>TWO</p><h2>Fishing</h2><p>THREE</p></div></div></div></div></body>", "The river ONE Mills TWO Fishing THREE"),
    "links inside the text": ("<body><div{m}><h1>The river</h1><p>ONE See <a href=x>the map</a> for details.</p><p>TWO</p></div><div{c}><a href=1>Imprint</a> <a href=2>Privacy</a></div></body>", "The river ONE See the map for details. TWO"),
    "footer columns": ("<body><div{m}><h1>The river</h1><p>ONE</p><p>TWO</p><p>THREE</p></div><div{c}><div><h4>Company</h4><ul><li><a href=1>About</a><li><a href=2>Jobs</a></ul></div><div><h4>Help</h4><ul><li><a href=3>FAQ</a><li><a href=4>Contact</a></ul></div><p>&copy; 2020 Example Ltd</p></div></body>", "The river ONE TWO THREE"),
    "preformatted": ("<body><ul{c}><li><a href=1>Docs</a><li><a href=2>Blog</a><li><a href=3>Source</a></ul><div{m}><h1>Install</h1><p>ONE</p><pre>make\nmake install</pre><p>TWO</p></div></body>", "Install ONE make make install TWO"),
}
NAMES = {"none": ("", ""), "made up": (' class="css-77 k3"', ' class="css-1x9"'), "telling": (' class="post-body"', ' class="site-nav"')}


def _right(layout, names):
    page, text = LAYOUTS[layout]
    fill = lambda s: s.replace("ONE", ONE).replace("TWO", TWO).replace("THREE", THREE)
    m, c = NAMES[names]
    got = html_extract.extract(["<!DOCTYPE html><html><head><title>t</title></head>" + fill(page).replace("{m}", m).replace("{c}", c) + "</html>"], html_extract.trained())[0]
    return got == fill(text), got


def test_hand_written_pages():
    results = {(a, b): _right(a, b) for a in LAYOUTS for b in NAMES}
    wrong = {k: re.sub(ONE + "|" + TWO, "..", got) for k, (right, got) in results.items() if not right}
    assert len(results) >= 40 and len(wrong) <= len(results) // 10, wrong


@pytest.mark.parametrize("page", ["", "<div>", "<p></p>", "<table><tr><td>"])
def test_pages_without_text(page):
    assert html_extract.extract([page], html_extract.trained()) == [""]
