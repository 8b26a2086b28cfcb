"""Pages that are long, deep, unclosed or quote-broken: linear cost, whole results."""

from __future__ import annotations

import time
import tracemalloc

import pytest

from groundwell.llm.html_blocks import blocks
from groundwell.llm.html_extract import extract_main_text, handfuls, main_texts
from groundwell.llm.html_lstm import PageMaker, load

SIZE = 300_000


@pytest.mark.parametrize("unit", ["<div>x", "<b>x", "<a ", "<a", "<a '>' ", "<a '>\" ", "<", '<a class="', "<!--", "<ul><li>x", "<head><i>x<body>", "<svg x='/>' ", "</script   ", "<a \"'>", "</p>", "&amp"])
@pytest.mark.parametrize("tail", ["", "'\">"])
def test_hostile_markup_is_linear(unit, tail):
    began = time.perf_counter()
    blocks(unit * (SIZE // len(unit)) + tail)
    assert time.perf_counter() - began < 4


def test_whole_extraction_of_a_deep_page_fits():
    weights, page = load(), "<div>x" * (SIZE // 6)
    tracemalloc.start()
    main_texts(weights, [page])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>one <a title='x>y'>two</a> three", ["one two three"]),
        ("<p title=\"a<b\">one</p><p title='>two</p><p>three", ["one", "two", "three"]),
        ("a <b", ["a <b"]),
        ("a < b <!-- gone --> c <i", ["a < b c <i"]),
        ("<head><title>t</title><p>no<body><p>yes", ["yes"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("1 < 2 <3 & 4 > 3", ["1 < 2 <3 & 4 > 3"]),
    ],
)
def test_blocks(html, want):
    assert [b.text for b in blocks(html)] == want


def test_block_paths_tell_nesting():
    one, two, three = blocks("<div class='main'><p>a</p>b</div>c")
    assert (one.marks, two.marks, three.marks) == (3, 2, 0) and one.path | two.path == one.path and three.path == 0
    plain, linked = blocks("<p>x</p><p><a>five!</a></p>")
    assert (plain.linked, linked.linked) == (0, 5)


def test_handfuls_keep_every_page_in_order():
    pages = ["x" * n for n in (3, 0, 9, 50, 1, 1, 1)] + [None, "y"]
    made = list(handfuls(pages, 3, 10))
    assert [x for part in made for x in part] == pages and all(len(part) <= 3 for part in made)
    assert all(len(part) == 1 or sum(len(x or "") for x in part) <= 10 for part in made)


def test_extraction_against_the_generators_truth(spark):
    """Generated pages whose article is known; repeated rows, a very long page and clashing columns among them."""
    maker = PageMaker(4321)
    made = [maker.page() for _ in range(120)]
    truth = ["\n".join(b.text.replace(PageMaker.KEEP, "") for b in blocks(x) if PageMaker.KEEP in b.text) for x in made]
    made = [x.replace(PageMaker.KEEP, "") for x in made]
    long = "<article>" + "".join(f"<p>paragraph {i} of a very long article that goes on and on</p>" for i in range(5000)) + "</article>"
    rows = [(i, f"u{i}", x, "clash", 7) for i, x in enumerate([*made, made[0], long, None])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = {r["page_id"]: r for r in extract_main_text(df).collect()}
    assert len(got) == len(rows) and got[120]["text"] == got[0]["text"] and got[122]["text"] == ""
    assert sum(got[i]["text"] == t for i, t in enumerate(truth)) >= 0.9 * len(truth)
    assert got[121]["text"].count("\n") == 4999 and all(r["n_chars"] == len(r["text"]) for r in got.values())
