"""Content regions by text-to-tag ratio: labelled pages without article or telling names, and what the method changes."""

import re
from html import unescape

import duckdb
import numpy as np
import pytest

from spanloom.llm import extraction

STORY = ["The river rose for three days before anyone in the village thought of moving the boats to the upper landing.", "By then the lower houses stood in water up to their sills, and the road to the mill was gone altogether.", "Nobody had seen such a flood since the bridge was built."]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in STORY)
TEXT = "\n".join(STORY)
LINKS = "".join(f"<a href='/{k}'>Topic{k}</a>" for k in range(30))
PAGES = {
    "links in a div": (f"<body><div class='topics'>{LINKS.replace('</a>', '</a><br>')}</div><div>{PARAGRAPHS}</div></body>", TEXT),
    "links in a list": (f"<body><div><ul>{''.join(f'<li><a href=x>Topic{k}</a></li>' for k in range(30))}</ul></div><div>{PARAGRAPHS}</div></body>", TEXT),
    "a paragraph of links": (f"<body><div><p>{LINKS}</p>{PARAGRAPHS}<p>{LINKS}</p></div></body>", TEXT),
    "a table of links": (f"<body><table><tr>{''.join(f'<td><a href=x>T{k}</a></td>' for k in range(12))}</tr></table><div>{PARAGRAPHS}</div></body>", TEXT),
    "short lines around": (f"<body><div>Home</div><div>Login</div><div>{PARAGRAPHS}</div><div>2024</div></body>", TEXT),
    "a div for each paragraph": (f"<body><div>Home</div><div>{''.join(f'<div><p>{x}</p></div>' for x in [*STORY[:2], 'So.', STORY[2]])}</div></body>", "\n".join([*STORY[:2], "So.", STORY[2]])),
    "a doubtful wrapper": (f"<body><div class='page with-sidebar'><div>{PARAGRAPHS}</div></div></body>", TEXT),
    "a form around all": (f"<body><form><div>{PARAGRAPHS}</div></form></body>", TEXT),
    "a form in the article": (f"<article>{PARAGRAPHS}<form><p>Your mail address, please</p></form></article>", TEXT),
    "comments in the article": (f"<article>{PARAGRAPHS}<section class='comments'><article><p>First!</p></article></section></article>", TEXT),
    "an advert without a name": (f"<body><div>Buy now</div><article>{PARAGRAPHS}</article></body>", TEXT),
    "links in the text": (f"<article><p><a href=x>See</a> {STORY[0]}</p></article>", f"See {STORY[0]}"),
    "one line outweighs all": (f"<body><p>{'long ' * 900}</p>{PARAGRAPHS * 8}</body>", "\n".join([("long " * 900).strip(), *[TEXT] * 8])),
    "nothing but a menu": ("<nav><a href=x>a</a></nav>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_labelled_pages(name):
    html, text = PAGES[name]
    assert extraction.main_text(html) == text


def test_edges_of_a_body():
    # What is far from the text goes; smoothing carries a cluster over the two lines next to it, whatever they are.
    links = "".join(f"<p><a href=x>{x}</a></p>" for x in "abcde")
    assert extraction.main_text(f"<body><p>Home</p>{links}{PARAGRAPHS}</body>") == f"d\ne\n{TEXT}"


PAGES_PATH = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture(scope="module")
def table():
    """Each page without its article tags, and the text that the generator wrote into them: blocks without links, split by a rule of its own."""
    found = []
    for (html,) in duckdb.sql(f"SELECT html FROM '{PAGES_PATH}' WHERE html LIKE '%<article>%</article>%'").fetchall():
        inside = html.partition("<article>")[2].partition("</article>")[0]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", re.sub(r"</?b>|<!--.*?-->", "", inside)))
        text = "\n".join(x for x in (" ".join(unescape(b).split()) for b in blocks) if x)
        found.append((html, re.sub("</?article>", "", html), text))
    return found


def test_texts_of_the_table(table):
    assert all(extraction.main_text(html) == text for html, _, text in table)
    # Without the article tags nothing but ratios tells what a body's own lines are worth.
    assert sum(extraction.main_text(bare) == text for _, bare, text in table) > 0.97 * len(table)


@pytest.mark.parametrize(
    "name, other, least",
    [
        # Every ratio the same; the ratio without its factors; no smoothing; every container claimed: one at a time.
        ("weighted", lambda lines, parser: np.ones(len(lines)), 0.9),
        ("weighted", lambda lines, parser: np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines]), 0.2),
        ("smoothed", lambda ratios, sigma: ratios, 0.1),
        ("regions", lambda lines, parser, sigma, share: ({parser.articles[x.container] or x.container for x in lines}, {x.doubt for x in lines}, {}), 0.9),
    ],
)
def test_each_step_of_the_method_decides(table, monkeypatch, name, other, least):
    monkeypatch.setattr(extraction, name, other)
    assert sum(extraction.main_text(bare) != text for _, bare, text in table) > least * len(table)


def test_tables(spark):
    columns = "page_id long, url string, html string, text string, n_chars long, lines string"
    rows = [(1, "u", PAGES["links in a div"][0], "x", 7, "y"), (1, "u", PAGES["links in a div"][0], "x", 7, "y"), (2, None, None, None, None, None), (None, "v", "", "x", 1, "y"), (3, "w", "<p>" + "word " * 400_000 + "</p>", "", 0, "")]
    found = sorted(extraction.extract(spark.createDataFrame(rows, columns)).collect(), key=lambda r: (r.page_id or 0, r.n_chars))
    assert [(r.page_id, r.url, r.n_chars) for r in found] == [(None, "v", 0), (1, "u", len(TEXT)), (1, "u", len(TEXT)), (2, None, 0), (3, "w", 1_999_999)]
    assert found[1].text == found[2].text == TEXT
    empty = extraction.extract(spark.createDataFrame([], columns))
    assert empty.collect() == [] and empty.columns == ["page_id", "url", "text", "n_chars"]


def test_open_inline_tags_cost_no_square():
    html = "<article>" + "<b>x</i> " * 60_000 + "</article>"
    assert extraction.main_text(html) == " ".join("x" * 60_000)
