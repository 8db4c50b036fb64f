"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. All that
expectation-maximisation needs is how often each combination of votes occurs,
a table bounded by the labellers and not by the corpus, so the accuracies are
estimated from all documents exactly. The posterior of a document's votes is
its soft label. A hashed linear scorer is then fitted to the soft labels: per
bucket, the log ratio of n-gram counts weighted by the posteriors of good and
of bad, counted over all documents as whole numbers. A document is kept unless
its votes make it bad or its n-grams score as those of bad documents do.
Everything runs as DataFrame functions.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import ngrams
from tidemark.llm.common import SPACES, Tables

GOOD, BAD, NONE = 1, 0, -1


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def _bad(when: Column) -> Column:
    return F.when(when, BAD).otherwise(NONE)


def measures(text: Column, hashes: Column, pairs: Column) -> dict[str, Column]:
    """What the labellers look at, from a text and the hashes of its words and pairs; null where there is nothing to measure."""
    n_words, n_chars = F.size(hashes), F.length(text)
    bare = F.length(F.translate(text, SPACES, ""))
    without = lambda chars: n_chars - F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    twins = F.zip_with(F.slice(hashes, 1, n_words - 1), F.slice(hashes, 2, n_words - 1), lambda a, b: (a == b).cast("int"))
    return {
        "words": F.when(n_words > 0, n_words),
        "word_length": _share(bare, n_words),
        "capitals": _share(without("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), bare),
        "shouts": _share(without("!"), n_words),
        "symbols": _share(without("#*$%&|<>{}[]\\~^=_@"), bare),
        "symbol_words": _share(without("#*$%&|"), n_words),
        "variety": _share(F.size(F.array_distinct(hashes)), n_words),
        "pair_variety": F.when(n_words > 1, F.size(F.array_distinct(pairs)) / (n_words - 1)),
        "twins": F.when(n_words > 1, F.aggregate(twins, F.lit(0), lambda total, x: total + x) / (n_words - 1)),
        "line_repeats": _share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        "sentences": _share(without(".?"), n_words),
    }


def labellers(m: dict[str, Column]) -> dict[str, Column]:
    """The votes of the heuristic labellers: most call bad or abstain, one can also call good.

    Each fault is looked at by more than one of them, so their votes overlap.
    """
    long = m["words"] >= 20
    return {
        "prose": F.when(m["words"].between(10, 100_000) & m["sentences"].between(0.01, 0.6), GOOD).when(m["words"] < 3, BAD).otherwise(NONE),
        "word_length": _bad(~m["word_length"].between(2.5, 12)),
        "capitals": _bad(m["capitals"] > 0.3),
        "shouts": _bad(m["shouts"] > 0.3),
        "symbols": _bad(m["symbols"] > 0.05),
        "symbol_words": _bad(m["symbol_words"] > 0.25),
        "variety": _bad((m["variety"] < 0.25) & long),
        "pair_variety": _bad((m["pair_variety"] < 0.5) & long),
        "twins": _bad((m["twins"] > 0.2) & long),
        "line_repeats": _bad(m["line_repeats"] > 0.5),
    }


@dataclass
class LabelModel:
    """How often each labeller is right when it votes; whether it votes says nothing, and the classes weigh alike."""

    names: list[str]
    accuracy: list[float] = field(default_factory=list)

    def posterior(self, pattern: tuple[int, ...]) -> float:
        """The chance of good, given the votes."""
        odds = sum(math.log(a / (1 - a)) * (1 if vote == GOOD else -1) for a, vote in zip(self.accuracy, pattern, strict=True) if vote != NONE)
        return 1 / (1 + math.exp(-odds))


def fit_labels(names: list[str], patterns: dict[tuple[int, ...], int], rounds: int = 100, least: float = 0.55, most: float = 0.98) -> LabelModel:
    """Expectation-maximisation of the accuracies over counted vote patterns, from 0.75 each and kept within bounds."""
    model = LabelModel(names, [0.75] * len(names))
    ordered = sorted(patterns.items())
    for _ in range(rounds):
        right, cast = [0.75] * len(names), [1.0] * len(names)
        for pattern, n in ordered:
            p = model.posterior(pattern)
            for i, vote in enumerate(pattern):
                if vote != NONE:
                    cast[i] += n
                    right[i] += n * (p if vote == GOOD else 1 - p)
        found = [min(most, max(least, r / c)) for r, c in zip(right, cast, strict=True)]
        moved, model.accuracy = max(abs(x - y) for x, y in zip(found, model.accuracy, strict=True)), found
        if moved < 1e-9:
            break
    return model


@dataclass(frozen=True)
class Scorer:
    """Buckets of the scorer, the posterior's steps, and what a kept document has at least: mean score in thousandths of a nat, posterior in steps."""

    buckets: int = ngrams.BUCKETS
    steps: int = 1000
    threshold: int = -400
    belief: int = 400


def classify(documents: DataFrame, scorer: Scorer = Scorer()) -> DataFrame:
    """doc_id, votes, posterior, score and kept of every document.

    ``votes`` has one of +, - and 0 per labeller; ``posterior`` is the chance of
    good by the label model, in thousandths; ``score`` is the linear scorer's
    mean log odds per n-gram. The votes and buckets are
    written once to the shared folder, so texts are read and hashed once. A text that is null or has no words gets no votes
    and is not kept. Repeated rows are scored alike. Only doc_id and text are read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("_hashes", ngrams.hashes(ngrams.words(F.col("text")))).withColumn("_pairs", ngrams.neighbours(F.col("_hashes")))
    m = measures(F.col("text"), F.col("_hashes"), F.col("_pairs"))
    grams = F.transform(F.concat("_hashes", "_pairs"), lambda h: ngrams.bucket(h, scorer.buckets))
    rows = rows.select("doc_id", grams.alias("_grams"), *[v.alias(f"_m_{k}") for k, v in m.items()])
    cast = labellers({k: F.col(f"_m_{k}") for k in m})
    names = list(cast)
    sign = lambda v: F.when(v == GOOD, "+").when(v == BAD, "-").otherwise("0")
    tables = Tables(documents.sparkSession)
    voted = tables.put("voted", rows.select("doc_id", "_grams", F.concat(*[sign(v) for v in cast.values()]).alias("votes")))
    counted = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    read = {"+": GOOD, "-": BAD, "0": NONE}
    patterns = {tuple(read[c] for c in row["votes"]): row["n"] for row in counted}
    model = fit_labels(names, patterns)
    write = {GOOD: "+", BAD: "-", NONE: "0"}
    posterior = {"".join(write[v] for v in p): round(scorer.steps * model.posterior(p)) for p in sorted(patterns)}
    known = F.create_map(*[F.lit(x) for x in itertools.chain(*posterior.items())]) if posterior else F.lit(None).cast("map<string,int>")
    labelled = voted.select("doc_id", "votes", known[F.col("votes")].alias("posterior"), "_grams")
    sums = ngrams.bucket_sums(labelled, "_grams", {"good": F.col("posterior"), "bad": F.lit(scorer.steps) - F.col("posterior")}, scorer.buckets)
    weights = ngrams.log_ratio(sums["good"], sums["bad"], smoothing=float(scorer.steps))
    scored = labelled.withColumn("_sum", ngrams.score(F.col("_grams"), ngrams.table(weights))).withColumn("_n", F.size("_grams"))
    kept = (F.col("_n") > 0) & (F.col("posterior") >= scorer.belief) & (F.col("_sum") >= F.lit(scorer.threshold) * F.col("_n"))
    return scored.select("doc_id", "votes", "posterior", F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")).otherwise(F.lit(0.0)).alias("score"), kept.alias("kept"))
