"""Web pages made from known articles, with what does not belong to them around and inside."""

from html import escape

WRAPPERS = ["<div>{}</div>", "{}", "<article>{}</article>", "<main><div>{}</div></main>", '<div class="layout has-sidebar"><article>{}</article></div>', '<div class="post-content">{}</div>', '<section class="page with-nav"><article>{}</article></section>']


def say(rng, n):
    return (" ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(n))).capitalize() + rng.choice(".!?")


def menu_of(rng):
    return "".join(f'<li><a href="/{i}">{say(rng, 1)[:-1]}</a></li>' for i in range(rng.randint(2, 9)))


def noise(rng):
    """One piece of each kind that is no content, wherever it stands."""
    return {
        "menu": f"<nav><ul>{menu_of(rng)}</ul></nav>",
        "advert": f'<div class="{rng.choice(["ad-slot", "advert", "sponsored"])}">{say(rng, rng.randint(3, 40))}</div>',
        "sidebar": rng.choice(["<aside><p>{}</p></aside>", '<div class="sidebar"><p>{}</p></div>']).format(say(rng, rng.randint(3, 40))),
        "comments": f'<div {rng.choice(["id", "class"])}="comments"><p>{say(rng, rng.randint(3, 45))}</p><p>{say(rng, rng.randint(3, 45))}</p></div>',
        "form": f"<form><label>{say(rng, 3)}</label><input><p>{say(rng, 8)}</p></form>",
        "notice": f'<div class="cookie-{rng.choice(["banner", "notice"])}"><p>{say(rng, rng.randint(3, 30))}</p></div>',
        "script": "<script>if (a < b) x('</p>')</script><style>p{margin:0}</style>",
        "share": f'<div class="share-links"><a href="/s">{say(rng, 2)}</a> <a href="/t">{say(rng, 1)}</a></div>',
        "hidden": f'<div style="display:none"><p>{say(rng, rng.randint(3, 30))}</p></div>',
    }


def page(rng, inside=True):
    """A page, and the text of its article."""
    blocks, kept = [], []
    wrapper = rng.choice(WRAPPERS)
    for k in range(rng.randint(3, 25)):
        text, tag = say(rng, rng.randint(3, 60)), rng.choice(["p", "p", "p", "h2", "li", "blockquote"])
        if k == 0:
            tag, text = "h1", text[:-1]
        elif "article" in wrapper or "main" in wrapper:  # there any line belongs, however short or unpunctuated
            text = say(rng, rng.randint(1, 60))[: -1 if rng.random() < 0.4 else None]
        shown = escape(text)
        if rng.random() < 0.3:
            w = shown.split(" ")
            i = rng.randrange(len(w))
            w[i] = rng.choice(['<b>{}</b>', '<span class="legal">{}</span>', '<a href="/x">{}</a>', '<em id="ad">{}</em>', "<math><mi>{}</mi></math>"]).format(w[i])
            shown = rng.choice([" ", "\n  ", "&nbsp;"]).join(w)
        blocks.append(f"<ul><li>{shown}</li></ul>" if tag == "li" else f"<{tag}>{shown}</{tag}>")
        kept.append(text)
    if inside:
        for piece in noise(rng).values():
            if rng.random() < 0.4:
                blocks.insert(rng.randint(1, len(blocks)), piece)
    outside = [*noise(rng).values(), f"<header><a href=/>{say(rng, 2)}</a></header>"]
    # without a name or tag that tells: links, and short lines
    outside += [f'<div><a href="/m">{say(rng, 3)}</a> <a href="/n">{say(rng, 2)}</a></div>', f"<div>{say(rng, rng.randint(1, 5))[:-1]}</div>", f"<ul>{menu_of(rng)}</ul>", f"<p>{say(rng, rng.randint(1, 4))[:-1]}</p>"]
    before, after = rng.sample(outside, 3), rng.sample(outside, 2)
    body = wrapper.format("".join(blocks))
    return f"<html><head><title>t</title></head><body>{''.join(before)}{body}{''.join(after)}<footer>{say(rng, 9)}</footer></body></html>", "\n".join(kept)
