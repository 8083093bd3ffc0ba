"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a file is addressed by the SHA-256 of its text. The ledger is a Parquet table with one row per
(blob, rule version) that was scanned, holding its findings; ``scan_versions`` scans only the pairs that the ledger
lacks, each blob once however many paths and versions hold it, appends them, and joins findings back to all paths.
Only DataFrame functions are used.

Spans are code points, end exclusive. A null text is an empty blob. Repeated rows and rows with a null path come
back as often as they occur. Columns other than path and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks put around matches; texts that hold them are scanned with other control characters in their place.
_OPEN, _VALUE, _CLOSE, _STANDIN = "\x01", "\x02", "\x03", "\x04"
SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint>"
LEDGER = f"blob binary, rule_version string, spans array<{SPAN}>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern`` has two groups, what stands before the value and the value.

    Matches are leftmost and do not overlap; one whose value has under ``least`` characters is dropped.
    """

    kind: str
    pattern: str
    least: int


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6),
    Rule("access", r"()(AKIA[A-Z0-9]+)", 20),
    Rule("hex", r"()([0-9a-f]{24,})", 24),
)


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    """Names a set of rules by its content, so that a changed rule is scanned anew."""
    import hashlib

    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _spans(parts: Column, rule: Rule, rank: int) -> Column:
    """Spans from the pieces of a marked text: all but the first begin with a match.

    Positions are running sums of lengths, taken in runs of pieces, so that texts with very many matches stay linear.
    """
    run = 256
    pieces = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 2) / run).cast("int")), lambda k: F.slice(pieces, k * run + 1, F.lit(run)))
    width = lambda piece: (F.length(piece) - 2).cast("bigint")  # noqa: E731  without the two marks inside
    sized = F.transform(runs, lambda r: F.struct(r.alias("r"), F.aggregate(r, F.lit(0).cast("bigint"), lambda a, p: a + width(p)).alias("w")))
    empty = F.array().cast(f"array<struct<r:array<string>,at:bigint>>")
    placed = F.aggregate(
        sized,
        F.struct(F.length(parts[0]).cast("bigint").alias("at"), empty.alias("all")),
        lambda a, x: F.struct((a["at"] + x["w"]).alias("at"), F.concat(a["all"], F.array(F.struct(x["r"].alias("r"), a["at"].alias("at")))).alias("all")),
    )["all"]

    def one(a: Column, piece: Column) -> Column:
        before = F.length(F.substring_index(piece, _VALUE, 1))
        value = F.length(F.substring_index(F.substring_index(piece, _CLOSE, 1), _VALUE, -1))
        span = F.struct(a["at"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (a["at"] + before + value).alias("end"))
        found = F.when(value >= rule.least, F.concat(a["all"], F.array(span))).otherwise(a["all"])
        return F.struct((a["at"] + width(piece)).alias("at"), found.alias("all"))

    def within(r: Column) -> Column:
        return F.aggregate(r["r"], F.struct(r["at"].alias("at"), F.array().cast(f"array<{SPAN}>").alias("all")), one)["all"]

    return F.flatten(F.transform(placed, within))


def with_spans(df: DataFrame, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``spans``, all rules' spans by start and rule, to rows with a text that is not null, which goes."""
    keep = [c for c in df.columns if c != text]
    marked = F.col(text)
    has = marked.contains(_OPEN) | marked.contains(_VALUE) | marked.contains(_CLOSE)
    clean = df.select(*keep, F.when(has, F.translate(marked, _OPEN + _VALUE + _CLOSE, _STANDIN * 3)).otherwise(marked).alias("__clean"))
    parts = clean.select(*keep, *(F.regexp_replace("__clean", r.pattern, f"{_OPEN}$1{_VALUE}$2{_CLOSE}").alias(f"__m{k}") for k, r in enumerate(rules)))
    none = F.array().cast(f"array<{SPAN}>")
    split = parts.select(*keep, *(F.when(F.col(f"__m{k}").contains(_OPEN), F.split(f"__m{k}", _OPEN, -1)).alias(f"__p{k}") for k in range(len(rules))))
    found = (F.when(F.col(f"__p{k}").isNotNull(), _spans(F.col(f"__p{k}"), r, k)).otherwise(none) for k, r in enumerate(rules))
    return split.select(*keep, F.array_sort(F.concat(*found)).alias("spans"))


def scan_versions(versions: DataFrame, ledger_path: str, *, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings (path, blob, spans) of every version; the ledger at ``ledger_path`` gains the newly scanned blobs.

    path: a column, unique but for repeated rows, that tells versions apart.
    """
    spark = versions.sparkSession
    version = rule_version(rules)
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    addressed = versions.select(F.col(path).alias("__path"), F.unhex(F.sha2(content.cast("binary"), 256)).alias("__blob"), content.alias("__text"))
    owners = addressed.groupBy("__blob").agg(F.min("__path").alias("__owner"))
    # One plain key for a version of a path, so that the join and the grouping after it move texts once.
    key = lambda of: F.concat(F.hex("__blob"), F.lit(":"), F.coalesce(F.col(of).cast("string"), F.lit("")))
    try:
        known = spark.read.schema(LEDGER).parquet(ledger_path)
    except Exception as e:  # a new ledger
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    if known is not None:
        known = known.where(F.col("rule_version") == version)
        owners = owners.join(known.select(F.col("blob").alias("__blob")), "__blob", "left_anti")
    unseen = addressed.select(key("__path").alias("__key"), "__blob", "__text").join(owners.select(key("__owner").alias("__own")), F.col("__key") == F.col("__own"), "left_semi")
    unseen = unseen.dropDuplicates(["__key"]).select("__blob", "__text")  # the owner's row, if it comes several times
    scanned = with_spans(unseen, "__text", rules).groupBy("__blob").agg(F.any_value("spans").alias("spans"))
    scanned.select(F.col("__blob").alias("blob"), F.lit(version).alias("rule_version"), "spans").write.mode("append").parquet(ledger_path)

    found = spark.read.schema(LEDGER).parquet(ledger_path).where((F.col("rule_version") == version) & (F.size("spans") > 0))
    found = found.groupBy("blob").agg(F.any_value("spans").alias("spans")).withColumnRenamed("blob", "__of")
    joined = addressed.drop("__text").join(found, F.col("__blob") == F.col("__of"), "left")
    return joined.select(F.col("__path").alias(path), F.col("__blob").alias("blob"), F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mask``."""
    merged = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("all")),
        lambda a, s: F.when(
            s["start"] < a["at"],
            F.struct(
                F.greatest(a["at"], s["end"]).alias("at"),
                F.concat(F.slice(a["all"], 1, F.size(a["all"]) - 1), F.array(F.struct(F.element_at(a["all"], -1)["a"].alias("a"), F.greatest(a["at"], s["end"]).alias("b")))).alias("all"),
            ),
        ).otherwise(F.struct(s["end"].alias("at"), F.concat(a["all"], F.array(F.struct(s["start"].alias("a"), s["end"].alias("b")))).alias("all"))),
    )["all"]
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(merged, lambda m: m["b"]))
    starts = F.concat(F.transform(merged, lambda m: m["a"]), F.array(F.length(text).cast("bigint")))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.zip_with(ends, starts, cut), mask))
