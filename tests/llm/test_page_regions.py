"""What the distribution keeps of a page, and the time that broken markup takes."""

import time

import pytest

from cytolake.llm.mainpage import main_text, regions

LONG = "words of a paragraph that is long enough to surge "


def test_regions():
    assert regions([0, 0, 70, 5, 0, 0, 0, 90, 0], 3, 60) == [(2, 4), (7, 8)] and regions([], 3, 60) == [] and regions([10, 10], 3, 60) == []


def test_text_beside_an_inner_container():
    assert main_text("<main><h1>Head</h1><p>intro</p><article><p>inner</p></article><p>tail</p></main>") == "Head\nintro\ninner\ntail"
    assert main_text("<article><p>one</p></article><div>between</div><article><p>two</p></article>") == "one\ntwo"


def test_noise_within_a_text_without_container():
    page = f"<h2>Title</h2><p>{LONG * 3}</p>" + "<div class=ad>buy</div>" * 4 + f"<p>{LONG * 2}</p>"
    assert main_text(page) == f"Title\n{LONG * 3}".strip() + f"\n{LONG * 2}".rstrip()
    links = "<ul>" + "<li><a href=x>a linked line of the menu which is long</a></li>" * 9 + "</ul>"
    assert main_text(f"{links}<p>{LONG * 3}</p><div>.</div>{links}") == (LONG * 3).strip() + "\n."


def test_class_words_are_whole_words():
    assert main_text('<article><div class="side-by-side"><p>one</p></div><p class="alert-level">two</p><p class="no-ads">three</p></article>') == "one\ntwo\nthree"
    assert main_text('<div class="has-sidebar no-header"><article><p>text</p></article><div class="sidebar">gone</div></div>') == "text"
    assert main_text('<article><p>text</p><div class="ad-slot">gone</div><div id=comments><article><p>gone</p></article></div><div class="share-buttons">gone</div></article>') == "text"


def test_an_article_within_a_marked_wrapper():
    assert main_text('<div class="widget"><article><p>text</p></article>gone</div>') == "text"


@pytest.mark.parametrize("unit", ["<a \"", "<div>", "<p>x", "<div><p>", "<script>", "<!--", "<a '\">", "<", '<article><div class="ad"><p>', "<b x='", "x</p>"])
def test_broken_markup_takes_time_in_proportion(unit):
    took = []
    for n in (5_000, 40_000):
        start = time.process_time()
        main_text(unit * n + "</p>" * n + ">")
        took.append(time.process_time() - start)
    assert took[1] < 24 * max(took[0], 0.02)
