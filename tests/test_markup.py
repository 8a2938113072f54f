"""Marks in HTML: names over presenting tags, protected text, entities of HTML, whole pages."""

import html as H
import re
from html.parser import HTMLParser

import pytest

from litmine.functions.markup import Highlighter
from litmine.operators import ner


def marked(html, *entities):
    return Highlighter([(e[0], e[1], e[2] if len(e) > 2 else {}) for e in entities]).mark(html)


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p><em>Ocimum</em> basilicum leaf</p>", '<p><span class="ent-species" data-common-name="basil &quot;x&quot;" data-taxon-id="1">Ocimum basilicum</span> leaf</p>'),
        ("the <b>BASIL</b>-<i>Oil</i>", 'the <span class="ent-chemical">BASIL-Oil</span>'),
        ('<a title="basil-oil" href=x>basils basil</a>', '<a title="basil-oil" href=x>basils <span class="ent-plant-part">basil</span></a>'),
        ("<code>basil <b>x</b></code><script>if (a<b) basil</script><style>basil{}</style>basil", '<code>basil <b>x</b></code><script>if (a<b) basil</script><style>basil{}</style><span class="ent-plant-part">basil</span>'),
        ('<span class="x ent-a">basil</span> <span class="y">basil</span>', '<span class="x ent-a">basil</span> <span class="y"><span class="ent-plant-part">basil</span></span>'),
        ("<!-- basil --><!DOCTYPE html>&beta;-pinene &lt; H<sub>2</sub>O", '<!-- basil --><!DOCTYPE html><span class="ent-chemical">β-pinene</span> &lt; H<sub>2</sub>O'),
        ("a < basil & <br/>b <basil>", 'a &lt; <span class="ent-plant-part">basil</span> &amp; <br/>b <basil>'),
        ("", ""),
    ],
)
def test_marks(html, want):
    data = {"taxon_id": 1, "common_name": 'basil "x"', "other": "no"}
    assert marked(html, ("ocimum basilicum", "SPECIES", data), ("Basil", "PLANT PART"), ("basil-oil", "CHEMICAL"), ("β-pinene", "CHEMICAL"), ("", "X")) == want


class Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out = []

    def handle_data(self, data):
        self.out.append(data)


def text_of(html):
    t = Text()
    t.feed(html)
    t.close()
    return "".join(t.out)


def test_whole_pages(spark):
    """Text and tags of real pages stay; each mark is a name, and a plain search finds as many in plain paragraphs."""
    from litmine.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.doc_id: r.html for r in QUERIES["n20_highlight_entities"](spark, sf).collect()}
    assert got.keys() == pages.keys()
    n = 0
    for k, html in pages.items():
        if not html:
            assert got[k] == html
            continue
        assert text_of(got[k]) == text_of(html)
        marks = re.findall(r'<span class="ent-[a-z-]+"[^>]*>([^<]*)</span>', got[k])
        n += len(marks)
        assert all(re.fullmatch(r"[\w ]+", H.unescape(m)) for m in marks)
    assert n > 20


def test_sections_without_entities(spark):
    sections = spark.createDataFrame([(1, 0, "<b>leaf</b>"), (2, 0, "<b>leaf</b>"), (1, 1, None)], "doc_id long, ord int, html string")
    e = spark.createDataFrame([(1, "leaf", "PLANT PART"), (1, "", "X"), (1, None, "X")], "doc_id long, text string, label string")
    assert {tuple(r) for r in ner.highlight_entities(sections, e).collect()} == {(1, 0, '<span class="ent-plant-part">leaf</span>'), (2, 0, "<b>leaf</b>"), (1, 1, None)}
