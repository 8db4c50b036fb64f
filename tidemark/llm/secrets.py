"""Secret scan with DataFrame functions only.

Three base kinds are found by pattern. The fourth is found by entropy: runs of
key-like characters are sorted into character classes, and a window slides over
each run while a count per character is kept: a step adds the entering one,
takes off the leaving one and corrects the sum of c*log2(c), from which the
window's Shannon entropy follows. A run whose windows reach its class's limit
is a secret from the first such window to the last, unless the allow-list knows
the run or a base span already covers it. A placeholder word is no reason to pass
over a run: only the windows that touch it don't count.

Offsets are code points, the end exclusive. Matches of a pattern are located
by the lengths of what lies between them, so every text is scanned whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import once

#: Letters of either case, spelled out so that every regex engine reads them alike.
_KEYWORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""(?:{_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: Runs are maximal, so the least length can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
CANDIDATE = rf"[A-Za-z0-9+/_=.-]{{{WINDOW},}}"
#: The first class whose pattern fits the whole run decides its limit, in bits per character of a window.
CLASSES = (
    ("hex", "^[a-fA-F]*[0-9][0-9a-fA-F]*$", 3.0),
    ("mixed", "^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).*$", 3.7),
    ("alphanumeric", "^(?=.*[A-Za-z])(?=.*[0-9]).*$", 3.4),
)
#: Runs that are no secrets: UUIDs, dates and versions, dotted or slashed words. A pattern without ^ is one of
#: placeholders, and speaks only of where it stands.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^[0-9._/=+-]+$",
    "^[./=_-]*[A-Za-z]+[0-9]{0,4}(?:[./=_-]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,4}))*[./=_-]*$",
    "(?i:example|placeholder|changeme|dummy|xxxx|0123456789|123456789|abcdefgh|deadbeef)",
)


@dataclass(frozen=True)
class Entropy:
    """Window, classes with limits, and allow-list of the entropy kind."""

    window: int = WINDOW
    classes: tuple[tuple[str, str, float], ...] = CLASSES
    allowed: tuple[str, ...] = ALLOWED

    @property
    def whole(self) -> tuple[str, ...]:
        """The patterns that excuse a whole run.

        Java repeats a group by recursion, which a run of many parts exhausts,
        unless it need not go back; the groups of these patterns never need to.
        """
        return tuple(p.replace(")*", ")*+") for p in self.allowed if p.startswith("^"))

    @property
    def placeholder(self) -> str | None:
        """A placeholder with its part between separators, as far as a window to either side."""
        words = "|".join(p for p in self.allowed if not p.startswith("^"))
        return f"[A-Za-z0-9]{{0,{self.window}}}(?:{words})[A-Za-z0-9]{{0,{self.window}}}" if words else None


def _scan(values: Column, start: Column) -> Column:
    """Sums of the values before each, from ``start``."""
    zero = F.struct(start.cast("long").alias("sum"), F.array().cast("array<long>").alias("out"))
    step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["out"], acc["sum"]).alias("out"))
    return F.aggregate(values, zero, step, lambda acc: acc["out"])


def running(values: Column, chunk: int = 256) -> Column:
    """Exclusive running sums of an array that is not empty, chunk by chunk so that long ones stay cheap."""
    count = F.floor((F.size(values) - 1) / chunk)
    chunks = F.transform(F.sequence(F.lit(0).cast("bigint"), count), lambda c: F.slice(values, (c * chunk + 1).cast("int"), chunk))
    sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))
    return F.flatten(F.zip_with(chunks, _scan(sums, F.lit(0)), lambda c, base: _scan(c, base)))


def _located(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Add array ``name`` of start, end, what for every match of the pattern."""
    hit = F.col("text").rlike(pattern)
    found = df.withColumn("_found", F.when(hit, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    found = found.withColumn("_between", F.when(F.col("_found").isNotNull(), F.split("text", pattern, -1)))
    lengths = F.zip_with(F.slice("_between", 1, F.size("_found")), F.col("_found"), lambda a, b: (F.length(a) + F.length(b)).cast("long"))
    found = found.withColumn("_before", F.when(F.col("_found").isNotNull(), running(lengths)))
    place = F.zip_with(
        F.arrays_zip("_before", F.slice("_between", 1, F.size("_found")).alias("gap")),
        F.col("_found"),
        lambda at, what: F.struct((at["_before"] + F.length(at["gap"])).alias("start"), (at["_before"] + F.length(at["gap"]) + F.length(what)).alias("end"), what.alias("what")),
    )
    return found.withColumn(name, F.when(F.col("_found").isNotNull(), place)).drop("_found", "_between", "_before")


def _kind(matches: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def _symbol(c: Column) -> Column:
    """A character's number in the alphabet, from 0; a blank has the next one."""
    return F.call_function("locate", c, F.lit(ALPHABET + " ")) - 1


def _blanked(run: Column, rule: Entropy) -> Column:
    """The run with blanks for its placeholders."""
    if not rule.placeholder:
        return run
    between, found = F.split(run, rule.placeholder, -1), F.regexp_extract_all(run, F.lit(rule.placeholder), F.lit(0))
    blanks = F.transform(found, lambda x: F.call_function("repeat", F.lit(" "), F.length(x)))
    joined = F.array_join(F.zip_with(between, blanks, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(run.rlike(rule.placeholder), joined).otherwise(run)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _windows(run: Column, rule: Entropy) -> Column:
    """First start and last end, within a run, of its windows at or over its class's limit (nulls without one).

    The counts of the characters lie side by side in a few long numbers, so a
    step changes two of them, by adding and taking off a one at their places.
    """
    width, none = rule.window, F.lit(None).cast("int")
    wide = (width + 1).bit_length()
    each = 62 // wide
    steps = F.array(*[F.lit((c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0)) for c in range(width + 1)])
    places = F.array(*[F.struct(F.lit(c // each).alias("word"), F.lit(c % each * wide).alias("shift"), F.lit(1 << c % each * wide).cast("bigint").alias("one"), F.lit(c == len(ALPHABET)).alias("blank")) for c in range(len(ALPHABET) + 1)])
    limit = F.coalesce(*[F.when(run.rlike(pattern), F.lit(bits)) for _, pattern, bits in rule.classes])
    symbols = F.transform(F.split(_blanked(run, rule), ""), lambda c: F.get(places, _symbol(c)))
    counts = F.array_repeat(F.lit(0).cast("bigint"), -(-(len(ALPHABET) + 1) // each))
    left = lambda line: F.slice(F.concat(F.array_repeat(F.lit(None), width), line), F.lit(1), F.size(line))
    pairs = lambda line: F.zip_with(line, left(line), lambda entering, leaving: F.struct(entering.alias("entering"), leaving.alias("leaving")))
    zero = F.struct(counts.alias("count"), F.lit(0.0).alias("sum"), none.alias("first"), none.alias("last"), F.lit(0).alias("at"), F.lit(0).alias("clear"), limit.alias("limit"))
    count = lambda counts, c: F.call_function("shiftright", F.get(counts, c["word"]), c["shift"]).bitwiseAND(F.lit((1 << wide) - 1).cast("bigint")).cast("int")
    changed = lambda counts, c, one: F.transform(counts, lambda x, j: F.when(j == c["word"], x + one).otherwise(x))

    def step(acc: Column, pair: Column) -> Column:
        entering, leaving = pair["entering"], pair["leaving"]
        more = acc["sum"] + F.get(steps, count(acc["count"], entering))
        added = F.struct(changed(acc["count"], entering, entering["one"]).alias("count"), more.alias("sum"))
        return _let(F.when(leaving.isNotNull(), _let(added, lambda x: taken(x, leaving))).otherwise(added), lambda x: judged(acc, entering, x))

    def taken(x: Column, leaving: Column) -> Column:
        less = x["sum"] - F.get(steps, count(x["count"], leaving) - 1)
        return F.struct(changed(x["count"], leaving, -leaving["one"]).alias("count"), less.alias("sum"))

    def judged(acc: Column, entering: Column, x: Column) -> Column:
        clear = F.when(entering["blank"], 0).otherwise(acc["clear"] + 1)
        dense = (clear >= width) & (F.lit(math.log2(width)) - x["sum"] / width >= acc["limit"] - 1e-9)
        return F.struct(
            x["count"].alias("count"),
            x["sum"].alias("sum"),
            F.when(acc["first"].isNull() & dense, acc["at"] - (width - 1)).otherwise(acc["first"]).alias("first"),
            F.when(dense, acc["at"] + 1).otherwise(acc["last"]).alias("last"),
            (acc["at"] + 1).alias("at"),
            clear.alias("clear"),
            acc["limit"].alias("limit"),
        )

    return _let(symbols, lambda line: F.aggregate(pairs(line), zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))


def _suspect(run: Column, rule: Entropy) -> Column:
    known = F.coalesce(*[F.when(run.rlike(p), F.lit(True)) for p in rule.whole], F.lit(False))
    classed = F.coalesce(*[F.when(run.rlike(p), F.lit(True)) for _, p, _ in rule.classes], F.lit(False))
    return classed & ~known


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(documents: DataFrame, rule: Entropy = Entropy()) -> DataFrame:
    """The documents with ``base`` and ``found``: arrays of start, rank, end, kind, in order.

    A null or empty text has none. Other columns stay as they are; columns of
    these two names are replaced.
    """
    plain = documents.drop("base", "found").withColumn("_text", F.col("text")).withColumn("text", F.coalesce("text", F.lit("")))
    df = plain
    for name, pattern in (("_assign", ASSIGN), ("_access", ACCESS), ("_hex", HEX), ("_runs", CANDIDATE)):
        df = _located(df, name, pattern)
    long_enough = F.filter("_assign", lambda m: F.length(F.regexp_extract(m["what"], ASSIGN, 1)) >= ASSIGN_LEAST)
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    kinds = [F.coalesce(_kind(c, k), empty) for c, k in ((long_enough, "assign"), (F.col("_access"), "access"), (F.col("_hex"), "hex"))]
    df = df.withColumn("base", F.array_sort(F.concat(*kinds)))
    suspects = F.filter("_runs", lambda m: _suspect(m["what"], rule))
    df = df.withColumn("_runs", F.when(F.col("_runs").isNotNull(), suspects))
    dense = F.transform("_runs", lambda m: F.struct(m["start"].alias("at"), _windows(m["what"], rule).alias("w")))
    df = df.withColumn("_dense", F.when(F.size("_runs") > 0, dense))
    spans = F.transform(F.filter("_dense", lambda d: d["w"]["first"].isNotNull()), lambda d: F.struct((d["at"] + d["w"]["first"]).alias("start"), (d["at"] + d["w"]["last"]).alias("end")))
    fresh = F.filter(spans, lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    spans = F.struct("base", F.array_sort(F.concat("base", F.coalesce(_kind(fresh, "entropy"), empty))).alias("found"))
    df = once(df.withColumn("text", F.col("_text")), "_spans", spans)
    return df.select(*[F.col(f"`{c}`") for c in documents.columns if c not in ("base", "found")], "_spans.*")


def secret_report(documents: DataFrame, rule: Entropy = Entropy()) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans and all spans written out."""
    scanned = scan_secrets(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), rule)
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"))


def redact(documents: DataFrame, mark: str = "<secret>", rule: Entropy = Entropy()) -> DataFrame:
    """The documents with every found span, overlapping ones as one, replaced by a mark.

    ``n_chars``, where there is such a column, is set to the new length of
    texts that changed; null texts stay null. Columns keep names and order.
    """
    scanned = scan_secrets(documents, rule)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substr("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"]).alias("out"))

    joined = F.aggregate("found", zero, step, lambda acc: F.array_join(F.array_append(acc["out"], F.substr("text", (acc["at"] + 1).cast("int"))), ""))
    changed = F.size("found") > 0
    out = scanned.withColumn("text", F.when(changed, joined).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(documents.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in documents.columns])
