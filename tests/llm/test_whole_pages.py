"""Whole results of page extraction: what recurs on a host, and all parts of an article."""

import random
import time

from textloom.llm import html_text


def test_a_stub_page_first_does_not_save_the_template(spark):
    body = lambda i: "".join(f"<p>{' '.join(f'w{i}x{j}y{k}' for k in range(12))}</p>" for j in range(1 + i % 3))
    page = "<div><p>Become a member today</p></div><article>{}<p>Read our newsletter</p></article>".format
    stubs = {"stub.org": "<p>404", "other.org": "<table><tr><td>another layout</td></tr></table>", "lacks.org": "<article><p>no such block here</p></article>"}
    rows = [(0, f"https://{h}/0", t) for h, t in stubs.items()] + [(i, f"https://{h}/{i}", page(body(i))) for h in stubs for i in range(1, 10)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).where("page_id > 0").collect()
    assert len(got) == 27 and all("newsletter" not in r.text and f"w{r.page_id}x0y3" in r.text for r in got)


def test_no_part_of_an_article_is_dropped():
    def text(page):
        _, leaves = html_text.parse(page)
        return [leaves[i].text for i in html_text.main_leaves(leaves)]

    assert text("<div class=article-body>part 1, the longer</div><aside>ad</aside><div class=article-body>part 2</div>") == ["part 1, the longer", "part 2"]
    assert text(f"<main><p>lead</p><div class=story>{'long ' * 30}</div><p>closing</p></main>") == ["lead", ("long " * 30).strip(), "closing"]
    assert text(f"<article><p>lead</p><article>{'long ' * 30}</article><p>closing</p></article>")[::2] == ["lead", "closing"]


def slow_matching(a, b, x, y):
    """Weight of the heaviest matching by the plain recursion."""
    if a.tags[x] != b.tags[y]:
        return 0
    left, right = a.children[x], b.children[y]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, u in enumerate(left):
        for j, v in enumerate(right):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + slow_matching(a, b, u, v))
    return 1 + (a.tokens[x] == b.tokens[y] and a.tokens[x] in ("#1", "#2")) + best[-1][-1]


def test_tree_matching_is_the_largest():
    rng = random.Random(1)

    def shape(depth):
        return " ".join(t if t[0] == "#" else f"{t} {shape(depth - 1)} /" for t in rng.choices(["a", "b", "c", "#", "#1", "#2"][0 if depth else 3 :], k=rng.randint(0, 4)))

    for _ in range(800):
        a, b = html_text.Tree(shape(3)), html_text.Tree(shape(3))
        pairs = html_text.match_trees(a, b)
        weight = sum(1 + (a.tokens[n] == b.tokens[m] and a.tokens[n] in ("#1", "#2")) for n, m in pairs.items())
        assert weight == slow_matching(a, b, 0, 0) and len(pairs) == len(set(pairs.values()))
        assert all(a.tags[n] == b.tags[m] for n, m in pairs.items())
        assert all(pairs[p] == q for n, m in pairs.items() for p, c in enumerate(a.children) if n in c for q, d in enumerate(b.children) if m in d)


def test_deep_and_wide_pages_are_quick():
    pages = {"deep": ("<div>" * 5000 + "x", "<div>" * 4000 + "y"), "wide": ("<article>" + "<p>a</p>" * 20_000, "<article>" + "<h2>z</h2><p>a</p>" * 5 + "<p>a</p>" * 20_000)}
    for one, other in pages.values():
        start = time.process_time()
        root, leaves = html_text.parse(one)
        numbers = html_text.main_leaves(leaves)
        places = html_text.Aligner().places(html_text.shape_of(root), html_text.shape_of(html_text.parse(other)[0]))
        assert len(places) == len(leaves) and len(numbers) == len(leaves) and time.process_time() - start < 10


def test_class_words_decide_nothing_but_whole_names():
    def text(page):
        _, leaves = html_text.parse(page)
        return [leaves[i].text for i in html_text.main_leaves(leaves)]

    article = '<article><p>lead <span class="ad">BUY <span>now</span> it</span> on</p><div class="legal-analysis">law</div><div class="side-effects">pain</div><section class="notice-period">time</section><div class="comments">me first</div></article>'
    assert text(article) == ["lead", "on", "law", "pain", "time"]
    assert text('<article><p>a</p><div class="wide ad-slot-2">b</div><div id="share-buttons">c</div><div class="social-history">d</div></article>') == ["a", "d"]


def test_template_is_what_aligned_pages_share(spark):
    """A block that other pages have elsewhere in the order is found by alignment; slots that vary stay; a mostly constant page
    loses its template all the same."""
    word = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    page = lambda i: f"<article><h1>{word(i, 2)}</h1>{'<p>' + word(i, 9) + '</p>' if i % 2 else ''}<p>Our terms of use have changed for the better and for all of us</p><p>{word(i, 5)} end</p><ul><li>All rights are ours</ul></article>"
    rows = [(i, f"https://h.org/{i}", page(i)) for i in range(10)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join([word(i, 2), *([word(i, 9)] if i % 2 else []), word(i, 5) + " end"]) for i in range(10)}


def test_long_lists_are_matched_as_short_ones():
    """What lies far from the diagonal is found whatever the number of siblings, and with many labels."""
    rng = random.Random(2)
    for n in (3, 300, 3000):
        a, b = html_text.Tree("<p> # / " * n + "<h2> # / " * n), html_text.Tree("<h2> # / " * n + "<li> # / " * n)
        pairs = html_text.match_trees(a, b)
        assert sorted((m, k) for m, k in pairs.items() if a.tags[m] == "#" and m) == [(2 * n + 2 * i + 2, 2 * i + 2) for i in range(n)]
    # Runs of labelled leaves in a list: the longest common run beyond what any two leaves weigh, by the plain table.
    one, other = ([rng.randint(1, 60) for _ in range(n)] for n in (500, 420))
    best = [0] * (len(other) + 1)
    for u in one:
        above, best = best, [0]
        for j, v in enumerate(other):
            best.append(max(above[j + 1], best[j], above[j] + 2 + (u == v)))
    a, b = (html_text.Tree(" ".join(f"<p> #{k} /" for k in ks)) for ks in (one, other))
    pairs = html_text.match_trees(a, b)
    assert 1 + best[-1] == sum(1 + (a.tokens[n] == b.tokens[m] and n > 0 and a.tags[n] == "#" and a.tokens[n] != "#") for n, m in pairs.items())
