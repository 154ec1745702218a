"""Main text of planted pages, and importance against direct sums."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracewell.llm.html import PRIOR, extract, own_importance, page_facts, parsed, with_mark

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n_chars long, text string").repartition(3)
    return {r.page_id: (r.text, r.n_chars) for r in extract(pages).collect()}


CASES = [
    ("<article><h1>A &amp; B</h1><p>one\n two&nbsp;three<br>four<p>five</article><footer>x</footer>", "A & B\none two three four\nfive"),
    ("<nav><ul><li>m</ul></nav><div class='ad'>buy</div><main><p>t</p></main><aside>s</aside>", "t"),
    ("<body><div id=sidebar>s</div><p>t</p><form>f<p>g</p></form><div class='cookie-notice'>c</div>", "t"),
    ("<article><header><h1>h</h1></header><p>t</p><footer>f</footer><div class='comments'><p>c</div></article>", "h\nt"),
    ("<section class='comments'><article class='comment'>c</article></section><article>t</article>", "t"),
    ("<div class='page-with-sidebar'><article>t</article></div>", "t"),
    ("<script>var t='</p>';</script><style>p{}</style><p>t</p><!-- c --><!-- open", "t"),
    ("<p>a</p><script>never closed <p>b</p>", "a"),
    ("a < b & c <p title='x>y'>d</p", "a < b & c\nd"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>", "a\nb\nc\nd\ne\nf\ng"),
    ("<div>a<b>b</b>c<div>d</div>e</div></p></div>f", "abc\nd\ne\nf"),
    ("<p>x &lt;p&gt; &#233;&#x1F600;&bogus; &amp</p>", "x <p> é😀&bogus; &"),
    ("", ""), (None, ""), ("<nav>only</nav>", ""), ("plain", "plain"),
    ("<div>" * 300 + "deep" + "</div>" * 200 + "<p>after", "deep\nafter"),
    ("<p>" + "long " * 100_000 + "</p>", ("long " * 100_000).strip()),
    ('<a "' * 2000 + "<p>end</p>", None),
]


def test_cases(spark):
    rows = [(k, f"http://h{k}.example.com/x", page) for k, (page, _) in enumerate(CASES)]
    found = texts(spark, rows)
    for k, (_, want) in enumerate(CASES):
        if want is not None:
            assert found[k] == (want, len(want)), CASES[k][0][:200]


def test_repeated_rows_nulls_and_empty_table(spark):
    rows = [(1, "http://a/", "<p>t")] * 3 + [(None, None, "<p>u"), (None, None, None)]
    pages = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.text for r in extract(pages).collect()) == ["", "t", "t", "t", "u"]
    assert extract(pages.limit(0)).count() == 0


def site(host, n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    out = []
    for k in range(n):
        body = "".join(f"<p>{' '.join(word() for _ in range(9))}</p>" for _ in range(rng.randint(1, 5)))
        page = f"<html><body><div class=t1><div>Home</div><div>About us</div></div><div class=t2>{body}</div>"
        out.append((f"http://{host}/{k}", f"{page}<div class=t3>Made by <b>{host}</b></div></body></html>", body))
    return out


def test_unnamed_branches_by_the_style_tree(spark):
    big, small = site("big.example.com", 150, 1), site("Small.example.com", 2, 2)
    rows = [(k, url.replace("big", "BIG") if k % 2 else url, page) for k, (url, page, _) in enumerate(big + small)]
    found = texts(spark, rows)
    for k, (_, _, body) in enumerate(big):
        assert found[k][0] == body[3:-4].replace("</p><p>", "\n")
    for k in (150, 151):  # two pages are no evidence
        assert found[k][0].startswith("Home\nAbout us\n") and "Made by" in found[k][0]


def test_importance_like_direct_sums(spark):
    rng = random.Random(5)
    pages = [
        f"<div class=a>{rng.choice('xyz')}</div>" + "<section><p>s</p></section>" * rng.randint(0, 2) for _ in range(40)
    ]
    marked = with_mark(spark.createDataFrame([(k, "http://h/", p) for k, p in enumerate(pages)], SCHEMA))
    got = {(r.node, r.kind): (r.m, r.own) for r in own_importance(page_facts(marked)).collect()}
    shown = [p[len("<div class=a>")] for p in pages]
    path = next(n.path for _, n, *_ in parsed(pages[0]))
    same = sum(shown.count(x) * math.log(shown.count(x)) for x in "xyz") / 40 / math.log(40)
    m, own = next(v for (node, kind), v in got.items() if kind == "text" and v[0] == 40)
    assert (m, own) == (40, pytest.approx(1 - same * 40 / (40 + PRIOR)))
    assert got[path[-1], "style"] == (40, pytest.approx(1 - 40 / (40 + PRIOR)))
    assert marked.where(F.col("host").isNull()).count() == 0


def test_named_branches_are_in_the_tree(spark):
    # the paragraph has four texts, each on 50 of 200 pages; its own importance is just above LOW, and what
    # the wrapper holds besides is an article or a menu, whose importance is known by name
    def page(k, part):
        return f"<div class=w><{part}><p>t{k}</p></{part}><p>kind {k % 4}</p></div>"

    rows = [(200 * h + k, f"http://h{h}/{k}", page(k, part)) for h, part in enumerate(("article", "nav")) for k in range(200)]
    found = texts(spark, rows)
    for k in range(200):
        assert found[k][0] == f"t{k}\nkind {k % 4}"
        assert found[200 + k][0] == ""
