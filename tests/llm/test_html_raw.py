"""Elements that the tokenizer drops whole, and what looks like them."""

from __future__ import annotations

import pytest

from groundwell.llm.html_blocks import blocks


@pytest.mark.parametrize(
    "html, want",
    [
        ('<article><p>one <svg class="i"/> two</p><p>three</p></article>', ["one two", "three"]),
        ('<p>one <svg a="/>" b=x/y><text>no</text><path d="M"/></svg> two</p>', ["one two"]),
        ('<p>one</p><svg-icon name="x"></svg-icon><p>two</p><object-view>in</object-view><p>three</p>', ["one", "two", "in", "three"]),
        ("<p>mass <math><mi>m</mi><mo>=</mo><mn>5</mn></math> kg</p>", ["mass m=5 kg"]),
        ("<p>a <math/> b</p><p>c</p>", ["a b", "c"]),
        ("<p>a<script>if (a<b) '</p>'</script>b<noscript>no</noscript><iframe src='x'>no</iframe> c<textarea >no</textarea></p>", ["ab c"]),
    ],
)
def test_raw_elements(html, want):
    assert [b.text for b in blocks(html)] == want
