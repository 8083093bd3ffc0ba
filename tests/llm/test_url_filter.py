from collections import Counter
from math import floor, log
from zlib import crc32

from tallyspark.llm import url_filter as U

RULES = [U.Rule("block", "net", "/"), U.Rule("allow", "example.net", "/en/"), U.Rule("block", "example.com", "/de/"), U.Rule("allow", "org", "/fr/")]


def split(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url[url.index("://") + 3 :]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    stop = min((rest.index(c, end) for c in "?#" if c in rest[end:]), default=len(rest))
    return host, rest[end:stop], host + rest[end:]


def rule(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.host + r.path), default=None)
    return (best.host + best.path, best.verdict) if best else (None, None)


class Model:
    def __init__(self, bodies, kinds, order=4):
        self.kinds, self.order, self.after = kinds, order, {}
        for body in bodies:
            padded = "\x02" * order + body
            for i in range(order, len(padded)):
                for k in range(order + 1):
                    self.after.setdefault(padded[i - k : i], Counter())[padded[i]] += 1

    def p(self, context, c):
        below = self.p(context[1:], c) if context else 1 / (self.kinds + 1)
        seen = self.after.get(context)
        return (seen[c] + len(seen) * below) / (seen.total() + len(seen)) if seen else below


def score(body, accepted, rejected):
    padded, total = "\x02" * 4 + body, 0
    for i in range(4, len(padded)):
        total += round((log(accepted.p(padded[i - 4 : i], padded[i])) - log(rejected.p(padded[i - 4 : i], padded[i]))) * 1e6)
    return floor(total / len(body))


def plain(rows):
    known = [(i, *split(u), *rule(*split(u)[:2])) for i, u in rows]
    kinds = len({c for r in known for c in r[3]})
    of = lambda v, held: [r[3] for r in known if r[5] == v and r[3] and (held or crc32(r[3].encode()) % 4)]
    models = [[Model(of(v, held), kinds) for v in ("allow", "block")] for held in (True, False)]
    usable = [all(of(v, held) for v in ("allow", "block")) for held in (True, False)]
    rate = lambda body, k: score(body, *models[k]) if body and usable[k] else 0
    held = [(rate(r[3], 1) // 1000, r[5]) for r in known if r[5] and r[3] and crc32(r[3].encode()) % 4 == 0]
    a, b = [x for x, v in held if v == "allow"], [x for x, v in held if v == "block"]
    least = 0
    if a and b:
        classes = sorted({x for x, _ in held})
        right = {t: sum(x >= t for x in a) * len(b) + sum(x < t for x in b) * len(a) for t in classes}
        best = min(t for t in classes if right[t] == max(right.values()))
        prior = max((x for x in classes if x < best), default=best)
        least = (prior + best + 1) // 2 * 1000
    return [(i, h, p, name, verdict or ("allow" if rate(body, 0) >= least else "block"), rate(body, 0) / 1e6) for i, h, p, body, name, verdict in known]


def urls():
    out = [None, "", "no scheme", "http://", "://x", "HTTP://EXAMPLE.NET/en/a", "http://example.net", "http://notexample.net/EN/", "http://a.b.org/fr/?q=1", "http://org/fr", "ftp://net/#://", "http://é.org/fr/ü", "x://net\n/a\nb?c", "http://user@WWW.Example.Com:80/de/x"]
    hosts = ("www.alpha.org", "beta.net", "shop.example.com", "example.net", "gamma.example.org", "m.delta.com")
    for k in range(240):
        out.append(f"https://{hosts[k % 6]}/{('en', 'de', 'fr')[k * k % 7 % 3]}/{k * 37 % 101}{('', '?page=2', '#top', '.html')[k % 4]}")
    return out


def test_equal_to_plain_version(spark):
    rows = list(enumerate(urls())) + [(5, urls()[20]), (5, urls()[20]), (None, urls()[21]), (900, "http://www." + "long-" * 4000 + ".org/fr/" + "y" * 3000)]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, host string, body string")
    got = sorted(map(str, (tuple(r)[:6] for r in U.filter_urls(pages, RULES).collect())))
    assert got == sorted(map(str, plain(rows)))


def test_without_one_class_all_scores_are_zero(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.com/y"), (3, None)], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.score, r.threshold) for r in U.filter_urls(pages, RULES).collect()}
    assert got == {1: ("block", 0.0, 0.0), 2: ("allow", 0.0, 0.0), 3: ("allow", 0.0, 0.0)}


def test_empty_table(spark):
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string"), RULES).collect() == []
