"""Secret scans: fixed patterns, and windows of high entropy. Built-in functions only.

Besides the patterns, runs of one character class (hexadecimal, base64) are candidates. A window slides
over each candidate; the counts of its characters change by one in and one out at each step, and with
them the sum of ``c log2 c`` from which the entropy follows. Windows at or above the class's threshold are
joined to spans. A candidate that an allow-list pattern matches is left alone, as is a span that a base
span overlaps.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import picked, query, table


@dataclass(frozen=True)
class Pattern:
    kind: str
    regex: str
    group: int
    least: int  # characters of the group, else the match is dropped


@dataclass(frozen=True)
class CharacterClass:
    kind: str
    alphabet: str
    regex: str  # of candidate strings
    window: int
    threshold: float  # bits per character


# The patterns of the contract. A hex or access match that is too short holds no longer one,
# so its least length can stand in the pattern; an assignment's cannot, as a short match uses up its text.
# What is looked at first (one letter ahead, one character back) changes no match and passes over most text.
PATTERNS = (
    Pattern("assign", r"(?i)(?=[psta])(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Pattern("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Pattern("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
)
_HEX = "0123456789abcdefABCDEF"
_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
CLASSES = (
    CharacterClass("entropy_hex", _HEX, r"(?<![A-Za-z0-9+/_-])[0-9a-fA-F]{20,}(?![A-Za-z0-9+/_-])", 20, 3.0),
    CharacterClass("entropy_base64", _BASE64, r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}", 24, 3.8),
)
#: Candidates that match one of these are no secrets: placeholders, runs of the alphabet, checksums, paths,
#: and strings without both a letter and a digit.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|lorem",
    r"(?i)abcdefgh|12345678|deadbeef|00000000",
    r"(?i)^sha(1|224|256|384|512)-",
    r"/[a-z]+/[a-z]+/",
    r"^[^0-9]+$",
    r"^[^A-Za-z]+$",
)
MASK = "[SECRET]"

_SPAN = "array<struct<start:int,end:int>>"


def _matches(text: Column, regex: str, group: int, least: int) -> Column:
    """Spans of the matches, leftmost first and not overlapping, in code points.

    What lies between the matches comes from a split by the same pattern; lengths add up to places.
    """
    parts = F.arrays_zip(
        F.transform(F.split(text, regex, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(regex), 0), F.length).alias("long"),
        F.transform(F.regexp_extract_all(text, F.lit(regex), group), F.length).alias("inner"),
    )

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + part["gap"]
        end = start + F.coalesce(part["long"], F.lit(0))  # nothing follows the last gap
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        found = F.when(part["inner"] >= least, F.concat(state["found"], span)).otherwise(state["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))
    walked = F.aggregate(parts, first, step, lambda state: state["found"])
    return F.when(text.rlike(regex), walked).otherwise(F.array().cast(_SPAN))


def _flagged(candidate: Column, kind: CharacterClass) -> Column:
    """Spans of ``candidate`` whose windows reach the threshold; overlapping windows are joined."""
    size, width = len(kind.alphabet), kind.window
    # c log2 c for each count that a window can hold.
    weigh = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 1)])
    symbols = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(kind.alphabet), c))

    def step(state: Column, place: Column) -> Column:
        symbols = state["symbols"]
        enters = F.element_at(symbols, place)
        leaves = F.when(place > width, F.element_at(symbols, F.greatest(place - width, F.lit(1)))).otherwise(F.lit(0))
        counts = state["counts"]
        moved = enters != leaves
        more = F.element_at(counts, enters)
        fewer = F.when(leaves > 0, F.element_at(counts, F.greatest(leaves, F.lit(1)))).otherwise(F.lit(1))
        change = (
            F.element_at(weigh, F.least(more + 2, F.lit(width + 1)))
            - F.element_at(weigh, more + 1)
            - F.when(leaves > 0, F.element_at(weigh, fewer + 1) - F.element_at(weigh, fewer)).otherwise(F.lit(0.0))
        )
        total = state["total"] + F.when(moved, change).otherwise(F.lit(0.0))
        now = F.when(
            moved,
            F.transform(
                counts,
                lambda c, i: c + F.when(i + 1 == enters, 1).otherwise(0) - F.when(i + 1 == leaves, 1).otherwise(0),
            ),
        ).otherwise(counts)
        entropy = F.lit(math.log2(width)) - total / width
        start, spans = place - width, state["spans"]
        last = F.element_at(spans, -1)
        joined = F.when(
            (F.size(spans) > 0) & (start <= F.coalesce(last["end"], F.lit(-1))),
            F.concat(
                F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))),
                F.array(F.struct(last["start"].alias("start"), place.alias("end"))),
            ),
        ).otherwise(F.concat(spans, F.array(F.struct(start.alias("start"), place.alias("end")))))
        reached = (place >= width) & (F.round(entropy, 9) >= kind.threshold)
        return F.struct(
            symbols.alias("symbols"),
            now.alias("counts"),
            total.alias("total"),
            F.when(reached, joined).otherwise(spans).alias("spans"),
        )

    first = F.struct(
        symbols.alias("symbols"),
        F.array_repeat(F.lit(0), size).alias("counts"),
        F.lit(0.0).alias("total"),
        F.array().cast(_SPAN).alias("spans"),
    )
    walked = F.aggregate(F.sequence(F.lit(1), F.length(candidate)), first, step, lambda state: state["spans"])
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    return F.when(allowed, F.array().cast(_SPAN)).otherwise(walked)


def _overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def _labelled(spans: Column, kind: str, order: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")),
    )


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, text, base, spans)`` per row of ``docs``; both are arrays of (start, order, end, kind).

    ``base`` holds what the patterns find, ``spans`` also what entropy adds; sorted by start, then by kind as
    listed here. Places count code points; the end is exclusive. Null text counts as empty and has no
    spans. Repeated rows are returned as often as they occur, an empty table gives an empty result, a
    null id stays null, and columns other than the two are ignored. Whole texts are read.
    """
    rows = picked(docs, doc_id=id_column, text=text_column).withColumn("text", F.coalesce("text", F.lit("")))
    for p in PATTERNS:
        rows = rows.withColumn(f"_{p.kind}", _matches(F.col("text"), p.regex, p.group, p.least))
    base = F.concat(*[_labelled(F.col(f"_{p.kind}"), p.kind, i) for i, p in enumerate(PATTERNS)])
    rows = rows.withColumn("base", F.array_sort(base))
    more = []
    for i, kind in enumerate(CLASSES, len(PATTERNS)):
        rows = rows.withColumn(f"_runs_{kind.kind}", _matches(F.col("text"), kind.regex, 0, kind.window))
        flagged = F.flatten(
            F.transform(
                f"_runs_{kind.kind}",
                lambda run: F.transform(
                    _flagged(F.substring("text", run["start"] + 1, run["end"] - run["start"]), kind),
                    lambda s: F.struct((run["start"] + s["start"]).alias("start"), (run["start"] + s["end"]).alias("end")),
                ),
            )
        )
        rows = rows.withColumn(
            f"_{kind.kind}", F.when(F.size(f"_runs_{kind.kind}") > 0, flagged).otherwise(F.array().cast(_SPAN))
        )
        more.append(
            _labelled(F.filter(f"_{kind.kind}", lambda s: ~_overlaps(s, F.col("base"))), kind.kind, i)
        )
    return rows.select("doc_id", "text", "base", F.array_sort(F.concat("base", *more)).alias("spans"))


def _written(spans: Column) -> Column:
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with each span, or run of overlapping spans, replaced by the mask."""

    def step(state: Column, span: Column) -> Column:
        kept = F.substring(text, state["at"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        apart = span["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(apart, F.concat(state["out"], F.array(kept, F.lit(MASK)))).otherwise(state["out"]).alias("out"),
        )

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = F.aggregate(
        spans,
        first,
        step,
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def mask_secrets(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``[SECRET]``; all rows and columns stay.

    Rows without a secret are unchanged, null texts stay null.
    """
    names = docs.columns
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_column}`").alias("text"))
    found = secret_spans(numbered, "row", "text")
    masked = _masked(F.col("text"), F.col("spans"))
    out = F.when(F.col(f"doc_id.`{text_column}`").isNotNull(), masked)
    return found.select(
        *[out.alias(c) if c == text_column else F.col(f"doc_id.`{c}`").alias(c) for c in names]
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts per pattern, the digest of the base spans and all spans as text, from ``secret_spans``."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(p.kind) for p in PATTERNS]
    base = F.sha2(_written(F.col("base")), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), _written(F.col("spans")).alias("spans"))


@query("op10_secrets")
def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return digest(secret_spans(table(spark, folder, "documents")))
