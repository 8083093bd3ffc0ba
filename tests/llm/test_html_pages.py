"""Extraction against pages made from known articles, and the cut against a plain maximum flow."""

import random
import time

from tallyspark.llm import html_text as H
from tests.llm.made_pages import noise, page, say


def test_made_pages():
    """All kinds of noise, around the article and inside it; a lone link that is a whole block may go."""
    rng = random.Random(11)
    for _ in range(300):
        html, text = page(rng)
        assert H.main_text(html) == text, html


def test_each_kind_of_noise_inside_an_article_goes():
    rng = random.Random(12)
    first, last = "It was a long way to go from there, and nobody knew.", "They went on"
    for kind in noise(rng):
        for _ in range(20):
            piece = noise(rng)[kind]
            assert H.main_text(f"<article><h1>Title</h1><p>{first}</p>{piece}<p>{last}</p></article>") == f"Title\n{first}\n{last}", piece
    said = '<div class="comments"><p>A reader said this article is wonderful, really.</p></div>'
    assert H.main_text(f"<article><p>{first}</p>{said}<p>{last}</p></article>") == f"{first}\n{last}"


def test_weights_are_those_that_made_pages_give(spark):
    rng = random.Random(3)
    rows = [page(rng) for _ in range(1500)]
    got = H.fit(spark.createDataFrame(rows, "html string, text string"))
    for name in ("bias", "hidden", "away_tag", "away_class", "inside_article", "words", "heading", "sentence", "links"):
        assert abs(getattr(got, name) - getattr(H.Weights(), name)) < 3.5, name
    few = H.fit(spark.createDataFrame([*rows, *rows], "html string, text string"), most=1000)
    wrong = 0
    for _ in range(200):
        html, text = page(rng)
        wrong += H.main_text(html, few) != text
    assert wrong <= 10
    assert H.fit(spark.createDataFrame([], "html string, text string")) == H.Weights()


def test_wrappers_with_misleading_names():
    text = ["It was a long way to go from there, and nobody knew.", "So they went on, slowly, until the evening came."]
    body = "".join(f"<p>{t}</p>" for t in text)
    for wrapper in ('<div class="layout has-sidebar"><article>{}</article></div>', '<div class="page with-nav">{}</div>', '<div class="sidebar-wrapper"><div>{}</div></div>', '<div id="widget">{}</div>', '<div class="comments-enabled post">{}</div>'):
        assert H.main_text(f"<nav><a href=/>Home</a></nav>{wrapper.format(body)}<footer>All words reserved.</footer>") == "\n".join(text), wrapper
    for short in ("A single long sentence that goes on and on, without any stop, until at last it comes to its end here.", "Short text.", "Not even this, by far."):
        assert H.main_text(f'<nav><a href=/>Home</a></nav><div class="sidebar-x"><p>{short}</p></div>') == short
        for name in ("ad", "comments", "cookie-notice", "newsletter-box"):
            assert H.main_text(f'<nav><a href=/>Home</a></nav><div class="{name}"><p>{short}</p></div>') == ""
    assert H.main_text('<div class="ad">Buy this now, it is cheap.</div>') == ""
    assert H.main_text(f'<article>{body}</article><div class="comments">{body * 9}</div>') == "\n".join(text)


def test_inline_names_and_foreign_markup_stay():
    got = H.main_text('<article><p>The <span class="legal">Treaty of Rome</span> was <i class="share">signed</i> <span hidden>not shown</span>then, as <math><mi>x</mi><mo>=</mo><mn>2</mn></math> says.</p><svg><style>a{}</style><title>t</title><text>label here</text></svg></article>')
    assert got == "The Treaty of Rome was signed then, as x=2 says.\nlabel here"


def plain_cut(terminal, edges):
    """Least value of a cut by augmenting paths over an adjacency matrix."""
    n = len(terminal)
    room = [[0.0] * (n + 2) for _ in range(n + 2)]
    for i, t in enumerate(terminal):
        room[n][i], room[i][n + 1] = max(t, 0), max(-t, 0)
    for a, b, c in edges:
        room[a][b] += c
        room[b][a] += c
    total = 0.0
    while True:
        came, queue = {n: n}, [n]
        for i in queue:
            for j in range(n + 2):
                if room[i][j] > 1e-9 and j not in came:
                    came[j] = i
                    queue.append(j)
        if n + 1 not in came:
            return total
        path = [n + 1]
        while path[-1] != n:
            path.append(came[path[-1]])
        flow = min(room[b][a] for a, b in zip(path, path[1:]))
        for a, b in zip(path, path[1:]):
            room[b][a] -= flow
            room[a][b] += flow
        total += flow


def test_cut_has_the_value_of_a_plain_maximum_flow():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randint(2, 40)
        t = [rng.uniform(-1.5, 1.5) for _ in range(n)]
        e = [(i, i + 1, rng.uniform(0, 2)) for i in range(n - 1)] + [(*sorted(rng.sample(range(n), 2)), rng.uniform(0, 1)) for _ in range(n // 2)]
        labels = H.minimum_cut(t, e)
        cost = sum(x if x > 0 and not s else -x if x < 0 and s else 0 for x, s in zip(t, labels)) + sum(c for a, b, c in e if labels[a] != labels[b])
        assert abs(cost - plain_cut(t, e)) < 1e-6


def test_long_and_deep_pages_in_seconds():
    rng = random.Random(1)
    items = "".join(f"<li>{say(rng, rng.randint(1, 9))}</li>" if rng.random() < 0.7 else f"<p>{say(rng, rng.randint(2, 25))}</p><div><a href=/>{say(rng, 4)}</a></div>" for _ in range(50_000))
    began = time.perf_counter()
    assert H.main_text(f"<ul>{items}</ul>")
    assert H.main_text("<article>" + "<div>" * 50_000 + "<p>Deep inside there is a text.</p>" + "</section>" * 1000 + "<p>And more of it.</p>") == "Deep inside there is a text.\nAnd more of it."
    assert H.main_text("<article><p>" + "<b>x " * 50_000 + "</b> end.</p></article>").endswith("x end.")
    assert time.perf_counter() - began < 30
