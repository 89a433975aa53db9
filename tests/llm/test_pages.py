"""The page operators against plain readings of small sites."""

import base64
import hashlib
import html
import os
import re
import sys

import pytest

from flowgauge.llm import html_paths, queries, warc

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from compare import difference, oracle  # noqa: E402

SHELL = ('<html><head><title>T</title><script>var x = "</p><article>no</article>";</script></head><body><header>Top</header>'
         '<nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div>{}<aside>More</aside>'
         '<footer>&copy; site</footer></body></html>')


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def texts(spark, rows):
    return {r.page_id: r.text for r in html_paths.main_text(pages(spark, rows)).collect()}


def test_article_without_the_rest():
    source = SHELL.format(
        '<article><h1>A &amp;lt; B</h1><p>one<br>two&nbsp;  three<p>four <b>bold</b>ly<ul><li>x<li>y</ul>'
        '<div class="ad-12">Buy</div><form>Name <input></form><!-- c --><style>p{}</style><div id="comments"><p>First!</p></div>'
        '<table><tr><td>1<td>2</table></article>')
    assert html_paths.Page(source).along("/body/article") == "A &lt; B\none two three\nfour boldly\nx\ny\n1\n2"


@pytest.mark.parametrize("source", ["<", "<a", "<p", "</", "<!--", "<!-- x", "<script>x", "<a b='c", "&", "<p/>", "<<>>", "</div></p>"])
def test_broken_pages_do_not_break(source):
    html_paths.Page(source).along(None)
    html_paths.Page("<article><p>kept</p></article>" + source).along("/article")


def test_pages_of_a_site_agree_on_the_path(spark):
    # Where the story is short, a page alone would take the long teaser list for it.
    story = '<div class="post-{0}"><p>{1}</p></div>'
    teasers = '<div class="more"><p>{}</p></div>'
    rows = [(i, f"http://site.example/{i}", SHELL.format(story.format(i, f"Story {i}. " + "Long text here. " * 30) + teasers.format("Short.")))
            for i in range(8)]
    rows.append((99, "http://SITE.example:80/99", SHELL.format(story.format(99, "Brief story.") + teasers.format("Teaser text. " * 40))))
    rows.append((100, "http://alone.example/1", SHELL.format("<main><p>All alone here.</p></main>")))
    found = texts(spark, rows)
    assert found[99] == "Brief story." and found[100] == "All alone here." and found[3].startswith("Story 3. Long")
    assert dict((r.host, r.path) for r in html_paths.host_paths(
        html_paths.pick(pages(spark, rows), "url", "html").selectExpr("lower(regexp_extract(url, '//([^/:]+)', 1)) as host", "html")).collect()) == {
            "site.example": "/body/div.post-#", "alone.example": "/body/main"}


STORY = "<h1>Head</h1>" + "".join(f"<p>Paragraph {i} of the story, with <i>some</i> more words in it.</p>" for i in range(8))
PLAIN_STORY = "\n".join(["Head", *(f"Paragraph {i} of the story, with some more words in it." for i in range(8))])
WRAPPERS = ['class="content"', 'class="content no-sidebar"', 'class="layout has-sidebar"', 'class="page-with-ads"', 'class="elementor-widget-container"',
            'class="post share-enabled"', 'id="legal-article"', 'id="notice-board"', 'class="reply-free content"', 'class="comments-off comment"']


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", '<div class="inner">{}</div>'])
@pytest.mark.parametrize("outer", ["<div {}>{}</div>", "<form><div {}>{}</div></form>"])
def test_words_of_a_wrapper_do_not_cost_the_article(wrapper, inner, outer):
    rest = '<div class="menu"><p>Menu text.</p></div><div class="ad"><p>Advert text.</p></div><form><p>Your name</p></form>'
    comments = '<div id="comments"><article class="comment"><p>First comment.</p></article><ol class="replies"><li>A reply.</li></ol></div>'
    page = html_paths.Page(SHELL.format(rest + outer.format(wrapper, inner.format(STORY)) + comments))
    assert page.along(None) == PLAIN_STORY
    assert page.along("/body") == PLAIN_STORY


def test_long_comments_and_marked_pages():
    comments = '<section class="comments">' + "".join(f'<article><p>Comment {i}, which goes on for long.</p></article>' for i in range(60)) + "</section>"
    assert html_paths.Page(SHELL.format(f"<div>{STORY}{comments}</div>")).along(None) == PLAIN_STORY
    assert html_paths.Page(SHELL.format('<div class="notice">All there is.</div>').replace("We use cookies", "")).along(None) == "All there is."


def test_wrapped_articles_of_a_site(spark):
    rows = [(i, f"http://w.example/{i}", SHELL.format(f"<div {WRAPPERS[i % 9]}>{STORY}</div>")) for i in range(18)]
    assert set(texts(spark, rows).values()) == {PLAIN_STORY}


def read_plainly(source):
    """A second reading of pages whose article is an ``article``: cut at block tags."""
    inside = re.split("</article>", source.split("<article>")[1])[0]
    inside = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>", "", re.sub(r"(?i)<br\s*/?>", " ", inside))
    blocks = re.split(r"(?i)</?(?:p|h[1-6]|ul|ol|li|div|section|table|tr|td|blockquote|pre)\b[^>]*>", inside)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_whole_table(spark, sf_dir):
    rows = queries.op1_consensus_paths(spark, sf_dir).collect()
    table = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(table)
    for r in rows:
        assert r.text == read_plainly(table[r.page_id]) and r.n_chars == len(r.text)


def test_archive_matches_sql(spark, sf_dir):
    assert difference(queries.op7_indexed_warc(spark, sf_dir), oracle(sf_dir), queries.SQL["op7_indexed_warc"]) is None


def test_records_round_trip_and_selection(spark, tmp_path):
    rows = [(i, f"http://h/{i}\r\nX: y", f"<p>{i % 7}</p>" * (i % 5) + "\r\n\r\nWARC/1.1\r\n é") for i in range(60)] + [(60, None, None), (61, "u", "")]
    folder, index = warc.write_archives(pages(spark, rows), "file://" + str(tmp_path / "w"))
    listed = index.collect()
    assert len(listed) == 62
    for r in listed:       # an index row names exactly one gzip member
        data = (tmp_path / "w" / r.file).read_bytes()[r.offset:r.offset + r.length]
        found = warc.parsed(warc.zlib.decompress(data, 31))
        assert found[0] == r.page_id and found[4] == r.payload_digest
    first = {}
    for i, _, source in rows:
        first.setdefault(source or "", i)
    for r in warc.read_records(index, folder).collect():
        source = rows[r.page_id][2] or ""
        assert r.payload_bytes == len(source.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(source.encode()).digest()).decode()
        if first[source] == r.page_id:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, source.encode())
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", first[source], None)
        assert r.url == (None if r.page_id == 60 else "u" if r.page_id == 61 else f"http://h/{r.page_id} X: y")
    some = warc.read_records(index.filter("page_id in (3, 9, 41)"), folder)
    assert sorted(r.page_id for r in some.collect()) == [3, 9, 41]


def test_small_payloads_are_all_responses(spark):
    rows = [(i, None, "same") for i in range(4)] + [(10 + i, None, "long enough") for i in range(3)]
    found = {r.page_id: (r.record_type, r.refers_to) for r in warc.archived(pages(spark, rows), least_bytes=5).collect()}
    assert all(found[i] == ("response", None) for i in (0, 1, 2, 3, 10)) and found[11] == found[12] == ("revisit", 10)


def test_ranges_are_joined_and_bounded(monkeypatch):
    monkeypatch.setattr(warc, "GAP", 10)
    monkeypatch.setattr(warc, "MOST", 100)
    rows = [("a", 0, 20), ("a", 20, 20), ("a", 45, 10), ("a", 80, 30), ("a", 110, 200), ("b", 310, 5)]
    assert [(len(g), low, high) for g, low, high in warc._ranges(rows)] == [(3, 0, 55), (1, 80, 110), (1, 110, 310), (1, 310, 315)]
