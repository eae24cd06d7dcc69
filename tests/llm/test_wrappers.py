"""Hosts whose pages hide the main text from a wrapper that looks at a part of it."""

import pytest

from playbill.llm import wrappers


@pytest.mark.parametrize("block", ["<ul><li>%s</li></ul>", "<pre>%s</pre>", "<blockquote>%s</blockquote>", "<table><tr><td>%s</td></tr></table>", "<section><p>%s</p></section>"])
def test_paragraphs_beside_a_block_that_holds_most_of_the_text(block):
    def page(k):
        return f"<body><div id='menu'>Go</div><div class='post'><h2>Title {k}</h2><p>Lead {k}</p>{block % (f'long {k} ' * 40)}<p>End {k}</p></div></body>"

    path = wrappers.main_path(wrappers.infer([page("a"), page("bb"), page("ccc")]))
    assert wrappers.extract(page("z"), path).split("\n") == ["Title z", "Lead z", ("long z " * 40).strip(), "End z"]


def test_a_lead_beside_the_body():
    page = lambda k: f"<body><div>Lead {k}</div><section><p>{f'body {k} ' * 30}</p></section></body>"
    path = wrappers.main_path(wrappers.infer([page("a"), page("bb")]))
    assert wrappers.extract(page("z"), path).startswith("Lead z\nbody z")


def test_an_article_after_a_long_directory():
    links = "".join(f"<div><a>Place {j}</a></div>" for j in range(1500))
    page = lambda k: f"<body><div>{links}</div><article><p>Text {k}</p></article></body>"
    path = wrappers.main_path(wrappers.infer([page("a"), page("bb")]))
    assert wrappers.extract(page("z"), path) == "Text z"
    assert wrappers.extract(page("z"), []) == "Text z"  # no path is known


def test_blocks_whose_names_only_resemble_those_beside_the_text():
    inner = "<section id='related-work'><p>a</p></section><section id='search'><p>b</p></section><h2 id='search'>c</h2><h3 class='share'>d</h3><div class='share-price'>e</div>"
    page = f"<body><article>{inner}<div class='post share'>Share</div><div id='comments'>Nice</div></article></body>"
    assert wrappers.extract(page, ["body", "article"]) == "a\nb\nc\nd\ne"
