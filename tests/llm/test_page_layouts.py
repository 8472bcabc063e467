"""Layouts that hide an article: none may lose it, and what lies round it stays out."""

import pytest

from graphloom.llm import html_graph

A = "The river rose over night and the town woke to water in the streets. Nobody had seen it so high before."
B = "Later in the day helpers came with boats, and by the evening most families were safe."
BOTH = f"<p>{A}</p><p>{B}</p>"
NAV = "<nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav>"

LAYOUTS = {
    "plain text": (f"{A} {B}", f"{A} {B}"),
    "plain body": (f"<html><body>{A}<br><br>{B}</body></html>", f"{A} {B}"),
    "whole form": (f"<body><form action=/x>{NAV}<article><h1>Flood</h1>{BOTH}</article><footer>© 2020 Town</footer></form></body>", f"Flood\n{A}\n{B}"),
    "form without article": (f"<body><form action=/x><div class=content>{BOTH}</div></form></body>", f"{A}\n{B}"),
    "small forms": (f"<body><form><p>Search our site for more.</p><input></form><article>{BOTH}</article><form class=newsletter><p>Get our letter. No spam.</p></form></body>", f"{A}\n{B}"),
    "junk word beside content": (f'<body><article class="post type-post meta">{BOTH}</article></body>', f"{A}\n{B}"),
    "has sidebar": (f'<body><div class="content has-sidebar">{BOTH}</div><div class=sidebar><ul><li><a href=/>x y</a><li><a href=/2>z</a></ul></div></body>', f"{A}\n{B}"),
    "post-meta": (f'<body><div class=post><div class="post-meta">By Ann on May 1</div>{BOTH}</div></body>', f"{A}\n{B}"),
    "deep": ("<body>" + "<div>" * 3000 + BOTH + "</div>" * 3000, f"{A}\n{B}"),
    "list items": ("<body><main><h1>Things to bring</h1><ul><li>Boots and a warm coat<li>A torch<li>Water for two days</ul></main>", "Things to bring\nBoots and a warm coat\nA torch\nWater for two days"),
    "link paragraph": (f"<body>{NAV}<article><p>{A}</p><p><a href=/r>Read the whole report of the council</a></p><p>{B}</p></article>", f"{A}\nRead the whole report of the council\n{B}"),
    "xmp": (f"<body><article><p>{A}</p><xmp>a &lt; <b>b</b>\n c</xmp><p>{B}</p></article>", f"{A}\na &lt; <b>b</b> c\n{B}"),
    "open xmp": (f"<body><article><p>{A}</p><p>{B}</p><xmp>1 < 2 and all that follows it is text.", f"{A}\n{B}\n1 < 2 and all that follows it is text."),
    "comments": (f"<body><article>{BOTH}</article><div class=comments><div class=comment-body><p>{B}</p></div></div>", f"{A}\n{B}"),
    "nothing but menus": (f"<body>{NAV}<footer><a href=/>Top</a></footer>", ""),
}


@pytest.fixture(scope="module")
def model():
    return html_graph.train(html_graph.labelled_pages())


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(model, name):
    page, want = LAYOUTS[name]
    assert model.text(page) == want


def test_wrappers_are_no_nodes():
    inner = html_graph.parse("<main><p>x</p></main>")
    outer = html_graph.parse("<div>" * 50 + "<div class=row><main><p>x</p></main></div>" + "</div>" * 50)
    assert [(n.tag, n.parent, n.total) for n in inner] == [(n.tag, n.parent, n.total) for n in outer]
    assert [n.tag for n in html_graph.parse("<div>a<p>b</p></div><div id=menu><p>c</p></div><div>d</div>")] == [
        "#root", "div", "#text", "p", "#text", "div", "p", "#text", "div", "#text"]
