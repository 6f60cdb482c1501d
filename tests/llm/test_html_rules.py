"""Block rules of the main text beside and inside article elements."""

from __future__ import annotations

from tessera.llm.html_main import main_text

PROSE = "The cat sat on the mat and it was the best of all the days that we have had in this house."


def test_articles_are_evidence_and_not_the_rule():
    # text beside teasers
    page = f"<div><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p></div><article><p><a href=a>More of the same from us</a></p></article>"
    assert main_text(page) == f"{PROSE} Short one. {PROSE}"
    # links inside an article, also outside of lists
    links = "<p><a href=a>First other story</a> <a href=b>Second other story</a></p>"
    assert main_text(f"<article><h1>Title</h1><p>{PROSE}</p>{links}</article>") == f"Title {PROSE}"
    # comments as nested articles, and the class of an outer one
    nested = f"<article class='post sidebar'><p>{PROSE}</p><article class='comment'><p>{PROSE} No.</p></article></article>"
    assert main_text(nested) == PROSE
    # what is undecided beside an article isn't its text
    assert main_text(f"<p>Menu</p><article><p>{PROSE}</p><p>Zahl 7</p></article><p>Imprint</p>") == f"{PROSE} Zahl 7"


def test_ambiguous_blocks_are_left_to_their_neighbours():
    seven = "Helsinki 1952: Zatopek 29:17.0, 14:06.6, 2:23:03.2; Mimoun 29:32.8, 14:07.4; Schade 14:08.6."
    between = f"<p>{PROSE}</p><p>See <a>Smith</a> for details.</p><p>{seven}</p><p>{PROSE}</p>"
    assert main_text(between) == f"{PROSE} See Smith for details. {seven} {PROSE}"
    # between blocks of links they are no text
    links = "<p><a href=a>First other story</a> <a href=b>Second other story</a></p>"
    assert main_text(f"<p>{PROSE}</p>{links}<p>See <a>Smith</a> for details.</p>{links}") == PROSE
    # nothing decides the page
    assert main_text(f"<p>See <a>Smith</a> for details.</p><p>{seven}</p>") == f"See Smith for details. {seven}"


def test_lists_of_links_between_paragraphs_stay():
    assert main_text("<article><p>See the sources.</p><ul><li><a>Source one</a></li><li><a>Source two</a></li></ul><p>End.</p></article>") == "See the sources. Source one Source two End."
    assert main_text(f"<article><p>{PROSE}</p><p>Let <math><mi>x</mi> be 1</math>.</p><p>{PROSE}</p></article>") == f"{PROSE} Let x be 1. {PROSE}"


def test_quotes_count_only_where_a_value_begins():
    page = f"<p title=it's>{PROSE}</p><p class='a>b' title = \"x>y\">{PROSE} 2</p><p data-x=a\"b>{PROSE} 3</p><p \">{PROSE} 4</p>"
    assert main_text(page) == f"{PROSE} {PROSE} 2 {PROSE} 3 {PROSE} 4"


def test_pages_without_article_elements(spark):
    """The densities decide as well without the containers: hardly a text changes."""
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    same = sum(main_text(r.html) == main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", r.html)) for r in rows)
    assert same >= 0.99 * len(rows) > 200


def test_clashing_names_empty_tables_and_long_pages(spark):
    from tessera.llm.html_main import extract_main_text

    rows = spark.createDataFrame([(1, f"<p>{PROSE}</p>" * 3000, "t"), (1, None, None), (None, f"<p>{PROSE}</p>", "t")], "page_id int, html string, Text string")
    got = extract_main_text(rows)
    assert got.columns == ["page_id", "html", "text"] and sorted(len(r.text) for r in got.collect()) == [0, len(PROSE), 3000 * (len(PROSE) + 1) - 1]
    assert extract_main_text(rows.limit(0)).count() == 0
