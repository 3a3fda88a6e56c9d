"""Character references without their semicolon, as browsers read them."""

from larder.operators.pages import read_page
from larder.operators.selectors import Selectors, pick


def test_references_that_a_tag_ends():
    html = "<title>a &amp;&amp</title><body><h1>b&amp</h1><p>c &am</p><p>d&nbsp;&quot</p>"
    assert read_page(html)["title"] == "a &&"
    assert pick(html, Selectors(["title", "h1", "p"])) == [["a &&"], ["b&"], ["c &am", 'd\xa0"']]
