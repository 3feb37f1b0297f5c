"""Tag-path ratios on pages with known main text: the threshold, signs and their override, list links, deep nesting."""

import time
from collections import Counter

import pytest

from casewatch.llm import extraction

HEADLINE = "A headline of this page"
FIRST = "This is a paragraph of some length, with commas, and a full stop. It goes on."
SECOND = "Another one, somewhat shorter than that. Yes."
BODY = f"<h1>{HEADLINE}</h1><p>{FIRST}</p><p>{SECOND}</p>"
TEXT = [HEADLINE, FIRST, SECOND]
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/c>Contact us</a></li></ul>"
COMMENTS = f"<div class=comments><h2>Comments</h2><div class=comment><p>{'A very long comment, really. ' * 60}</p></div></div>"
FOOT = "<footer>Copyright, all rights. Imprint, terms.</footer>"

# name, page, lines of its main text
PAGES = [
    *((w, f"<body><nav>{MENU}</nav>{w}{BODY}{c}{FOOT}</body>", TEXT) for w, c in (
        ("<div class='content has-sidebar'>", "</div>"), ("<div id='main-no-comments'>", "</div>"), ("<article class='post has-comments'>", "</article>"),
        ("<div class='article-body share-enabled'>", "</div>"), ("<form action=x>", "</form>"), ("<div class=sidebar>", "</div>"),
    )),
    ("unmarked menu before the article", f"<body><div>{MENU}</div><div id=x>{BODY}</div></body>", TEXT),
    ("unmarked menu inside the article", f"<article>{MENU}{BODY}{MENU}</article>", TEXT),
    ("unmarked lines inside the article", f"<article>{BODY}<div>Share this</div></article>", TEXT),
    ("comments inside main", f"<main>{BODY}{COMMENTS}</main>", TEXT),
    ("comments longer than the article", f"<body><article><p>{SECOND}</p></article>{COMMENTS}</body>", [SECOND]),
    ("related links", f"<article>{BODY}<h2>Related</h2><ul><li><a href=u>One</a></li><li><a href=v>Two</a></li></ul></article>", TEXT),
    ("links in lists", f"<article>{BODY}<ul><li>See <a href=x>the rules</a> first</li><li>Eggs</li></ul></article>", [*TEXT, "See the rules first", "Eggs"]),
    ("table", f"<article>{BODY}<table><tr><th>n<td>1<tr><th>m<td>2</table></article>", [*TEXT, "n", "1", "m", "2"]),
    ("section heads", f"<article>{BODY}<h2>More</h2><h3>Details</h3><p>{SECOND}</p></article>", [*TEXT, "More", "Details", SECOND]),
    ("no container", f"<p>{FIRST}<p>{SECOND}", [FIRST, SECOND]),
    ("advert, hidden text, notice", f"<body><div class='cookie-banner'>We use cookies, as you know. Accept?</div><article>{BODY}<p hidden>no</p><aside>Buy now.</aside></article></body>", TEXT),
    ("attributes that only look alike", f"<body><nav>{MENU}</nav><div data-class='advert' title=\"class='advert'\">{BODY}</div></body>", TEXT),
    ("misnested", f"<article><h1>{HEADLINE}</h1><p><b><i>{FIRST}</b></i></div><p>{SECOND}</p></article>", TEXT),
    ("menu only", f"<nav>{MENU}</nav>{FOOT}", []),
]


@pytest.mark.parametrize("name, page, lines", PAGES, ids=[p[0] for p in PAGES])
def test_known_main_text(name, page, lines):
    assert extraction.main_text(page) == "\n".join(lines)


def test_precision_and_recall_in_words():
    found = hits = wanted = 0
    for _, page, lines in PAGES:
        got, want = Counter(extraction.main_text(page).split()), Counter(" ".join(lines).split())
        found, hits, wanted = found + got.total(), hits + (got & want).total(), wanted + want.total()
    assert hits / found >= 0.98 and hits / wanted >= 0.98


def test_the_threshold_decides(spark, sf_dir):
    pages = [r[0] or "" for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    assert all(extraction.main_text(p) != extraction.main_text(p, threshold=False) for p in pages if p)


def test_ratios_without_signs(spark, sf_dir, monkeypatch):
    """With elements and class words unread, the ratios alone still find most articles."""
    pages = [r[0] or "" for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    whole = [extraction.main_text(p) for p in pages]
    monkeypatch.setattr(extraction, "_mark", lambda tag, attributes: extraction.CLEAR)
    assert sum(extraction.main_text(p) == w for p, w in zip(pages, whole)) >= 0.7 * len(pages)


@pytest.mark.parametrize("opened, closed", [("<div>", "</div>"), ("<b><div>", "</i></p>"), ("<span>", ""), ("<ul><li>", ""), ("", "</section>")])
def test_deep_and_broken_nesting(opened, closed):
    started = time.perf_counter()
    assert extraction.main_text(opened * 50_000 + f"<p>{FIRST}</p>" + closed * 50_000) == FIRST
    assert time.perf_counter() - started < 8


def test_rows_and_clashing_columns(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    page = f"<article>{BODY}</article>"
    rows = [(1, "u", page, "x", "y"), (1, "u", page, "x", "y"), (None, None, page, None, None), (2, "u", None, "", ""), (3, "u", "", "", "")]
    frame = extraction.extract(spark.createDataFrame(rows, schema), keep=("page_id", "text", "n_chars"))
    assert frame.columns == ["page_id", "text", "n_chars"]
    text = "\n".join(TEXT)
    assert sorted(frame.collect(), key=str) == sorted([(1, text, len(text)), (1, text, len(text)), (None, text, len(text)), (2, "", 0), (3, "", 0)], key=str)
    assert extraction.extract(spark.createDataFrame([], schema)).count() == 0
