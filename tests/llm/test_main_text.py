"""Main text: hostile and awkward markup, and the host-wide search against a plain loop over all token runs."""

import time

import numpy as np
import pytest

from driftline.llm import html_text

SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize("html, want", [
    ("<article><svg/><p>text after svg</p></article>", "text after svg"),
    ("<article><select><option>a<p>kept</article>", "kept"),
    ('<article><h2 class="section-header">H</h2><p class="alert">A</p><p id="market-share">M</p><section class="related-work">R</section></article>', "H\nA\nM\nR"),
    ('<article><p>x</p><div class="share">s</div><div class="comment-list"><p>c</p></div><p class="ad">buy</p></article>', "x"),
    ("<article><header><h1>T</h1><span>by me</span></header><p>x</p></article><footer>f", "T\nx"),
    ('<article><p>one <span class="ad">buy <div>now</div></span>two</p></article>', "one two"),
    ("a < b <p>c &lt;d&gt; <b>bold</b>ness", "a < b\nc <d> boldness"),
    ("<ul><li>a<li>b</ul><table><tr><td>c</td><td>d</td></tr><tr><td>e</table>", "a\nb\nc d\ne"),
    ('<article><p>x <a href="a>b">link</a> y', "x link y"),
    ("<title>never closed <p>page", "never closed\npage"),
    ("<article><ul><li>Add the salt</li></ul><blockquote>q</blockquote><pre>a\n  b</pre></article>", "Add the salt\nq\na b"),
    ("<head><noscript><div>no</div></noscript></head><body><p hidden>h</p><p>x<!-- <p>y --></p>", "x"),
    ("<script>if (a < b) '</p>'</SCRIPT >x<style>", "x"),
])
def test_markup(html, want):
    assert html_text.text_of(html, None) == want


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<a '", "<!--", "<p", "<title>", "<textarea>", "<span class=ad>", "</", "<svg/>x", "<li></b>", '<a b="'])
def test_long_hostile_markup_takes_linear_time(piece):
    start = time.process_time()
    html_text.blocks_of(piece * 50_000 + ">" + "</div>" * 50_000)
    assert time.process_time() - start < 5


def plain_search(rows):
    """Text by page, from all runs of RUN tokens of all pages of a host."""
    host = lambda url: url.split("/")[2]
    streams = [[(w, b, kept, free) for b, (kept, text, free) in enumerate(html_text.blocks_of(html)) for w in text.split(" ")] for _, _, html in rows]
    owners = {}
    for (page, url, _), s in zip(rows, streams):
        for a in range(len(s) - html_text.RUN + 1):
            owners.setdefault((host(url), *(t[0] for t in s[a : a + html_text.RUN])), set()).add(page)
    out = []
    for (page, url, html), s in zip(rows, streams):
        gone = set()
        for a in range(len(s) - html_text.RUN + 1):
            if len(owners[(host(url), *(t[0] for t in s[a : a + html_text.RUN]))]) > 1:
                gone |= set(range(a, a + html_text.RUN))
        blocks = {}
        for k, (w, b, kept, free) in enumerate(s):
            if kept and not (free and k in gone):
                blocks.setdefault(b, []).append(w)
        out.append((page, "\n".join(" ".join(b) for b in blocks.values()) or html_text.text_of(html, None)))
    return out


def test_search_equals_a_plain_loop(spark):
    rng = np.random.RandomState(5)
    shared = [" ".join(f"s{k}w{i}" for i in range(n)) for k, n in enumerate((3, 7, 8, 9, 20))]
    own = lambda: " ".join(f"u{rng.randint(9999)}" for _ in range(rng.randint(1, 12)))
    rows = []
    for page in range(60):
        parts = []
        for _ in range(rng.randint(1, 7)):
            inside = " ".join(rng.permutation([own(), shared[rng.randint(5)], own()])[: rng.randint(1, 4)])
            tag = ["div", "p", "nav", "li", 'div class="related-work"'][rng.randint(5)]
            parts.append(f"<{tag}>{inside}</{tag.split()[0]}>")
        wrap = ["<body>%s", "<main>%s</main>", "<body>%s<article><p>text here</p></article>"][rng.randint(3)]
        rows.append((page // 2 if page < 20 else page, f"http://h{rng.randint(3)}/x", wrap % "".join(parts)))
    got = html_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted(plain_search(rows))
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert sum(t != html_text.text_of(h, None) for (_, t), (_, _, h) in zip(plain_search(rows), rows)) > 5


def test_unique_runs_stay_and_rows_of_one_page_id_keep_their_own_blocks(spark):
    menu = "home about contact imprint terms jobs press login"
    rows = [
        (1, "http://h/1", f"<div>{menu} unique one two three</div>"), (2, "http://h/2", f"<div>{menu} other four</div>"),
        (2, "http://h/2", "<div>alpha beta gamma only here in this second row of the page</div>"), (3, None, f"<div>{menu}</div>"), (4, "http://h/4", None), (None, "http://h/5", f"<div>{menu} x</div>"),
    ]
    got = html_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["text"] for r in got) == sorted([
        "unique one two three", "other four", "alpha beta gamma only here in this second row of the page", menu, "", f"{menu} x",
    ])
    wide = spark.createDataFrame([(1, "http://h/1", "<p>x", 2, "k")], SCHEMA + ", key long, lead string")
    assert html_text.main_text(wide).first()["text"] == "x"
    assert html_text.main_text(wide.where("false")).count() == 0
