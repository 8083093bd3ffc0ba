"""URL filter: rules of hosts and paths where they speak, and elsewhere the ratio of two character language models.

The rules label URLs. Over those of accepted and of rejected ones a variable-order Markov model each is counted, with contexts
of up to ``order`` characters. The probability of a character blends all orders (Witten-Bell): a context met n times with t
different characters after it gives n parts of n + t to what followed it and t parts to the next shorter context; one never met gives all
to the shorter; below order 0 stand all characters met, and one more, alike. A URL's score is the difference of its two
log-likelihoods a character. The threshold is calibrated: every fourth labelled URL, by a hash of it, is scored by models that
were counted without those; the threshold is the one that tells most of both classes right (their shares weigh the same). Verdicts of the method come from models counted over all labelled URLs.

Counts, models and scores are tables. Distinct URLs are cut into windows of order + 1 characters; counts are of windows, so that
a window's score is computed once however often it occurs, and hot windows are one row on their side of the join, whose other side
Spark splits. Nothing of them passes the driver, and no row, context or count is left out. Scores of windows are whole millionths of a nat, so
that sums don't depend on their order.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no rule and has score 0, as has one with
nothing after ``://``. Without accepted or without rejected URLs all scores are 0 and so is the threshold; a score equal to the
threshold is allowed. Repeated URLs count as often as they stand; repeated rows give repeated rows. Of rules that fit the longest
wins, host and path taken together; among equals that of the longer host, then block. Other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, stored

#: Stands before the first character of a URL.
_START = "\x02"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and what follows the path."""
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    of = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$", k), F.lit(""))
    return lower(of(1)), of(2), of(3)


def judged(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The rule that speaks, like ``net/``, and its verdict; null where none does."""
    first = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r.verdict != "block"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(first):
        rule = F.when(r.fits(host, path), r.host + r.path).otherwise(rule)
        verdict = F.when(r.fits(host, path), r.verdict).otherwise(verdict)
    return rule, verdict


def window_scores(windows: DataFrame, order: int, names: list[tuple[str, str]]) -> DataFrame:
    """``windows`` has ``gram`` (order + 1 characters, each once) and counts; for each pair of names of counts a score by that pair's models.

    Column ``score_<k>``: log-likelihood of the last character after those before it, by the first name's model less by the second's."""
    counted = [c for pair in names for c in pair]
    known = windows.agg(F.countDistinct(F.substring("gram", order + 1, 1)).alias("kinds"), *(F.sum(c).alias(c) for c in counted)).first()
    n, t = (lambda c: F.col(f"n_{c}")), (lambda c: F.col(f"t_{c}"))
    out = None
    for k in range(order + 1):  # length of context
        grams = windows.groupBy(F.substring("gram", order - k + 1, k + 1).alias("own")).agg(*(F.sum(c).alias(c) for c in counted))
        grams = grams.withColumns({"context": F.substring("own", 1, k), "shorter": F.substring("own", 2, k)})
        after = grams.groupBy("context").agg(*(x for c in counted for x in (F.sum(c).alias(f"n_{c}"), F.count(F.when(F.col(c) > 0, 1)).alias(f"t_{c}"))))
        both = grams.join(after, "context")
        both = both.join(out, "shorter") if k else both.withColumns({f"p_{c}": F.lit(1 / (known["kinds"] + 1)) for c in counted})
        blend = {c: F.when(n(c) > 0, (F.col(c) + t(c) * F.col(f"p_{c}")) / (n(c) + t(c))).otherwise(F.col(f"p_{c}")) for c in counted}
        out = both.select(F.col("own").alias("shorter"), *(p.alias(f"p_{c}") for c, p in blend.items()))
    score = lambda a, r: F.round((F.log(f"p_{a}") - F.log(f"p_{r}")) * 1_000_000) if known[a] and known[r] else F.lit(0)
    return out.select(F.col("shorter").alias("gram"), *(score(a, r).cast("long").alias(f"score_{k}") for k, (a, r) in enumerate(names)))


def threshold(held: DataFrame) -> int:
    """Of ``score``, ``verdict`` (allow or block) and ``times``: the score that tells most of both classes right; 0 if a class is missing.

    Scores are counted in classes a thousandth of a nat wide. A character's likelihood is at least one part in the counts for each
    order, so there are some hundred thousand classes at most, whatever the number of URLs. Halfway to the next lower class, at the
    lowest of equally good ones."""
    times = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("times")).otherwise(0))
    classes = held.groupBy(F.floor(F.col("score") / 1000).alias("at")).agg(times("allow").alias("a"), times("block").alias("r")).orderBy("at").collect()
    all_a, all_r = sum(c.a for c in classes), sum(c.r for c in classes)
    if not all_a or not all_r:
        return 0
    best, least, a, r, last = None, 0, 0, 0, classes[0].at
    for c in classes:
        if best is None or r * all_a - a * all_r > best:  # rejected below, less accepted below
            best, least = r * all_a - a * all_r, (last + c.at + 1) // 2 * 1000
        a, r, last = a + c.a, r + c.r, c.at
    return least


def filter_urls(pages: DataFrame, rules: list[Rule], id: str = "page_id", url: str = "url", order: int = 4, hold: int = 4) -> DataFrame:
    """For each row its id, ``host``, ``path``, ``rule``, ``verdict``, and ``score`` and ``threshold`` in nats a character."""
    host, path, rest = parts(F.col(url))
    rows = pages.select(F.col(id).alias("id"), host.alias("host"), path.alias("path"), F.concat(host, path, rest).alias("body"))
    rule, verdict = judged(F.col("host"), F.col("path"), rules)
    # one row for each text that is scored; host and path are its beginning
    bodies = rows.where("body != ''").groupBy("body", "host", "path").agg(F.count("*").alias("times"))
    bodies = stored(bodies.select("body", "times", verdict.alias("verdict"), (F.crc32("body") % hold == 0).alias("held")), "url-bodies")
    signs = bodies.withColumn("sign", F.split(F.concat(F.lit(_START * order), "body"), ""))
    cut = F.transform(F.sequence(F.lit(0), F.length("body") - 1), lambda k: F.concat(*(F.get("sign", k + j) for j in range(order + 1))))
    windows = signs.withColumn("gram", F.explode(cut)).drop("sign")
    of = lambda v, also: F.sum(F.when((F.col("verdict") == v) & also, F.col("times")).otherwise(0))
    every, rest_only = F.lit(True), ~F.col("held")
    counts = windows.groupBy("gram").agg(of("allow", every).alias("a"), of("block", every).alias("r"), of("allow", rest_only).alias("a_rest"), of("block", rest_only).alias("r_rest"))
    counts = stored(counts, "url-windows")
    scores = stored(window_scores(counts, order, [("a", "r"), ("a_rest", "r_rest")]), "url-scores")
    summed = windows.select("body", "gram").join(scores, "gram").groupBy("body").agg(F.sum("score_0").alias("all"), F.sum("score_1").alias("rest"))
    a_char = lambda c: F.floor(F.col(c) / F.length("body"))
    scored = stored(summed.select("body", a_char("all").alias("score"), a_char("rest").alias("score_rest")), "url-scored")
    calibration = bodies.where("held and verdict is not null").join(scored, "body")
    least = threshold(calibration.select("verdict", "times", F.col("score_rest").alias("score")))
    discard(counts, scores, bodies)
    found = rows.join(scored.select("body", "score"), "body", "left").withColumn("score", F.coalesce("score", F.lit(0)))
    own = F.coalesce(verdict, F.when(F.col("score") >= least, "allow").otherwise("block"))
    return found.select(F.col("id").alias(id), "host", "path", rule.alias("rule"), own.alias("verdict"), (F.col("score") / 1_000_000).alias("score"), F.lit(least / 1_000_000).alias("threshold"))
