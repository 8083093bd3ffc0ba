import itertools
import random

from tallyspark.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body class="has-sidebar">
<header><a href=/>Site</a> name</header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<!-- ad --><div class="ad">Buy this long and very nice thing now, it is cheap and good.</div>
<div class="cookie-notice">We use cookies to make the site better for you.</div>
<article><header><h1>A   title &copy; x</h1></header><p><b>First<br>line of&nbsp;the text, which is long enough to be clear.
<p>Yes.</p><form><input><button>Send</button> mail</form><p>Second <a href=/x>link</a> &lt;here&gt; &amp;amp; there.</p><script>var t="</p>";</script>
<ul><li>one item</li><li>two item</li></ul></article>
<aside>Related stories that you may like to read today.</aside><div id="comments"><p>I think that this was a very good article, thank you.</p></div>
<footer>&copy; site &middot; All words reserved.</footer></body></html>"""


def test_article_without_the_rest():
    assert H.main_text(PAGE).split("\n") == ["A title © x", "First line of the text, which is long enough to be clear.", "Yes.", "Second link <here> &amp; there.", "one item", "two item"]


def test_plain_pages_and_damage():
    assert H.main_text("") == H.main_text(None) == H.main_text("<p>") == H.main_text("<!-- x") == ""
    assert H.main_text("<p>This is a page that has no article tag, but a paragraph that is long.</p><p>And one more sentence.</p>").count("\n") == 1
    cut = PAGE[: PAGE.index("there.")]
    assert H.main_text(cut).endswith("Second link <here> &amp;")
    assert H.main_text('<article><p>One sentence here, and here.</p><p>Two of them.</p><div class="foo') == "One sentence here, and here.\nTwo of them."
    assert H.main_text("<article><p>1 < 2 and 3 > 2 is what we know.</p></article>") == "1 < 2 and 3 > 2 is what we know."


def test_minimum_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 8)
        t = [rng.uniform(-3, 3) for _ in range(n)]
        e = [(a, b, rng.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(labels):
            return sum(x if x > 0 and not s else -x if x < 0 and s else 0 for x, s in zip(t, labels)) + sum(c for a, b, c in e if labels[a] != labels[b])  # noqa: B023

        assert abs(cost(H.minimum_cut(t, e)) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-6


def test_frame_keeps_all_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x")], "page_id long, url string, html string, text string")
    got = H.extract(df).collect()
    assert sorted(len(r.text) for r in got) == [0, len(H.main_text(PAGE)), len(H.main_text(PAGE))] and H.extract(df.limit(0)).count() == 0
