"""Article and main elements are weighed against what is outside them."""

import duckdb

from dagstore.llm.html_extract import content_nodes, main_text, parse

SENTENCE = "The council met on Monday, and after a long debate it voted for the plan. "
BODY = "".join(f"<p>{SENTENCE * 4}{k}.</p>" for k in range(12))


def page(inside):
    return f"<html><body><nav><a href='/'>Home</a></nav>{inside}<footer>Imprint.</footer></body></html>"


def test_main_text_outside_a_small_article():
    for card in ("<article><p>Read also: a short teaser.</p></article>", "<article><h3>More news</h3><a href='/x'>A short teaser.</a></article>"):
        for inside in (f"<div><h1>Title</h1>{BODY}</div><div>{card}</div>", f"<div>{card}</div><div><h1>Title</h1>{BODY}</div>"):
            text = main_text(page(inside))
            assert text.count("The council met") == 48 and "Title" in text and "teaser" not in text


def test_small_article_beside_a_large_one():
    small = f"<article><h2>Second</h2><p>{SENTENCE}</p></article>"
    text = main_text(page(f"<article><h1>First</h1>{BODY}</article>{small}"))
    assert text.count("The council met") == 49 and "First" in text and "Second" in text


def test_paths_in_an_article_are_thresholded():
    links = "<div>" + "<a href='/t'>tag</a> " * 3 + "</div>"
    text = main_text(page(f"<article><h1>Title</h1>{BODY}<ul><li>First point, short.</li><li>Second point, short.</li><li>Milk</li></ul><table><tr><td>12</td><td>x</td></tr></table>{links}</article>"))
    assert "Title" in text and "short. Second point, short. Milk 12 x" in text and "tag" not in text


def test_one_article_is_kept_whole(sf_dir):
    for (html,) in duckdb.sql(f"SELECT html FROM '{sf_dir}/pages.parquet' WHERE html IS NOT NULL").fetchall():
        nodes = parse(html).nodes
        inside = [n[3] for n in nodes if n[1] and not n[3].isspace()]
        if inside:
            assert [n[3] for n in content_nodes(nodes) if not n[3].isspace()] == inside
