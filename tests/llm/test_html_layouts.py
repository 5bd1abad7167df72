"""Pages written by hand, in layouts that the generated training pages do not have."""

import time

import pytest

from termloom.llm.html_text import blocks, extract, trained

ONE = "The harbour was built in the eighteenth century, when the town lived from herring and salt."
TWO = "Most of the old warehouses are gone, but the customs house, with its clock and its stairs, still stands by the water."
THREE = "In summer a small ferry takes visitors to the island; in winter the crossing depends on the wind."

PAGES = {
    "table layout": (
        f"""<html><body bgcolor=white><table width=100%><tr><td colspan=2><font size=5>Town pages</font></td></tr>
        <tr><td width=120><a href=a.html>Home</a><br><a href=b.html>Maps</a><br><a href=c.html>Links</a></td>
        <td><h2>The harbour</h2><p>{ONE}<p>{TWO}<p>{THREE}</td></tr>
        <tr><td colspan=2><a href=mailto:x>Mail the webmaster</a></td></tr></table></body></html>""",
        ["The harbour", ONE, TWO, THREE],
    ),
    "weblog": (
        f"""<body class="home blog"><div id="page"><div id="masthead"><a href="/">My weblog</a></div>
        <div id="primary"><div id="content"><div class="post hentry"><h1 class="entry-title">The harbour</h1>
        <div class="entry-content"><p>{ONE}</p><blockquote><p>{TWO}</p></blockquote><p>{THREE}</p></div></div>
        <div id="comments"><h3>2 comments</h3><ol class="commentlist"><li class="comment"><p>I was there last year, lovely place.</p></li>
        <li class="comment"><p>Me too.</p></li></ol><form id="commentform"><label>Name</label><input><button>Post</button></form></div></div></div>
        <div id="sidebar"><h4>Archive</h4><ul><li><a href="/1">May</a></li><li><a href="/2">June</a></li></ul></div>
        <div id="footer">Powered by a weblog engine</div></div></body>""",
        ["The harbour", ONE, TWO, THREE],
    ),
    "news": (
        f"""<!doctype html><body><header class="site-header"><nav class="main-nav"><a href=/>News</a><a href=/s>Sport</a></nav></header>
        <div class="cookie-consent">We use cookies. <button>Accept</button></div>
        <main><article class="story"><header><h1>The harbour</h1></header><p class="lead">{ONE}</p><aside class="related"><h3>More on this</h3>
        <ul><li><a href=/r>Old ships found</a></li></ul></aside><p>{TWO}</p><div class="ad-slot">Advertisement</div><p>{THREE}</p></article></main>
        <footer class="site-footer"><p>All rights reserved</p></footer></body>""",
        ["The harbour", ONE, TWO, THREE],
    ),
    "documentation": (
        f"""<body><div class="navbar"><ul><li><a href=i>Index</a><li><a href=n>Next</a></ul></div><div class="document"><div class="body">
        <h1>The harbour</h1><p>{ONE}</p><pre>ferry --to island</pre><h2>Today</h2><ul><li>{TWO}</li><li>{THREE}</li></ul></div></div>
        <div class="sphinxsidebar"><h3>Search</h3><form><input></form></div><div class="footer">Copyright 2011</div></body>""",
        ["The harbour", ONE, "ferry --to island", "Today", TWO, THREE],
    ),
    "bare": (f"<h1>The harbour</h1>\n<p>{ONE}</p>\n<p>{TWO}</p><p>{THREE}", ["The harbour", ONE, TWO, THREE]),
}


def counts():
    right = wrong = missed = 0
    for page, want in PAGES.values():
        got = extract([page], trained())[0].split("\n")
        right += len(set(got) & set(want))
        wrong += len(set(got) - set(want) - {""})
        missed += len(set(want) - set(got))
    return right, wrong, missed


def test_other_layouts():
    right, wrong, missed = counts()
    assert right >= 20 and wrong <= 4 and missed <= 2, (right, wrong, missed)


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>a" * 175_000, "<p><b>" + "<b>" * 100_000 + "<div></div>" * 50_000, "<title>" + "</title" * 150_000, "<a <b " * 150_000 + '"x>'])
def test_time_grows_with_the_page(page):
    took = []
    for part in (page[: len(page) // 4], page):
        began = time.perf_counter()
        blocks(part)
        took.append(time.perf_counter() - began)
    assert took[1] < 2 and took[1] < 12 * took[0] + 0.2


def test_long_pages_are_read_in_windows():
    text = [f"{ONE} {i}" for i in range(3_000)]
    page = f"<body><nav><a href=/>Home</a></nav><article>{''.join(f'<p>{t}</p>' for t in text)}</article><footer>Copyright</footer></body>"
    assert extract([page], trained())[0] == "\n".join(text)
