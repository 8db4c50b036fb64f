"""Weights, scores and verdicts of quality rules and of the weak-label classifier, recomputed by plain Python."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.brute_hash import grams
from tests.llm.test_operators import EDGES, brute_surface, words
from tidemark.llm import quality, weak


@pytest.fixture(scope="module")
def documents(spark):
    out = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(EDGES, "doc_id long, text string"))
    for clash in ("_trusted", "bucket", "votes", "_grams", "kept", "score"):
        out = out.withColumn(clash, F.lit("clash"))
    return out.repartition(4).checkpoint()


@pytest.fixture(scope="module")
def rows(documents):
    return [(r[0], r[1]) for r in documents.select("doc_id", "text").collect()]


def log_ratio(target, base, smoothing):
    t, b = sum(target.values()) + smoothing * 8192, sum(base.values()) + smoothing * 8192
    return [round(1000 * math.log((target[i] + smoothing) / t * b / (base[i] + smoothing))) for i in range(8192)]


def test_quality_scores(spark, documents, rows):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    trusted = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    raw, target = Counter(), Counter()
    for d, text in rows:
        found = grams(words(text))
        raw.update(found)
        if d in trusted:
            target.update(found)
    weights = log_ratio(target, raw, 1.0)
    assert quality.fit_ratio(documents, labels) == weights
    expected = Counter()
    for d, text in rows:
        found = grams(words(text))
        total = sum(weights[g] for g in found)
        failed = brute_surface(text)[-1]
        expected[d, round(total / len(found), 6) if found else 0.0, not failed and total >= -120 * len(found)] += 1
    got = quality.judge(documents, labels).select("doc_id", F.round("ratio_score", 6), "kept").collect()
    assert Counter((r[0], r[1], r[2]) for r in got) == expected
    assert {k for _, _, k in expected} == {True, False}


def brute_votes(text):
    text, w = text or "", words(text)
    n, bare = len(w), sum(map(len, w))
    share = lambda a, b: a / b if b > 0 else None
    count = lambda chars: sum(c in chars for c in text)
    lines = [x for x in text.split("\n") if words(x)]
    pairs = list(zip(w, w[1:], strict=False))
    over = lambda value, limit: value is not None and value > limit
    under = lambda value, limit: value is not None and value < limit
    sentences, length = share(count(".?"), n), share(bare, n)
    good = 10 <= n <= 100_000 and sentences is not None and 0.01 <= sentences <= 0.6
    bad = [
        length is not None and not 2.5 <= length <= 12, over(share(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), bare), 0.3), over(share(count("!"), n), 0.3),
        over(share(count("#*$%&|<>{}[]\\~^=_@"), bare), 0.05), over(share(count("#*$%&|"), n), 0.25), under(share(len(set(w)), n), 0.25) and n >= 20,
        n > 1 and len(set(pairs)) / (n - 1) < 0.5 and n >= 20, n > 1 and sum(a == b for a, b in pairs) / (n - 1) > 0.2 and n >= 20, over(share(len(lines) - len(set(lines)), len(lines)), 0.5),
    ]
    return ("+" if good else "-" if 0 < n < 3 else "0") + "".join("-" if b else "0" for b in bad)


def expectation_maximisation(patterns, n_labellers):
    accuracy = [0.75] * n_labellers

    def posterior(votes):
        odds = sum(math.log(a / (1 - a)) * (1 if v == "+" else -1) for a, v in zip(accuracy, votes, strict=True) if v != "0")
        return 1 / (1 + math.exp(-odds))

    for _ in range(100):
        p = {votes: posterior(votes) for votes in patterns}
        before = list(accuracy)
        for i in range(n_labellers):
            cast = 1.0 + sum(k for v, k in patterns.items() if v[i] != "0")
            right = 0.75 + sum(k * (p[v] if v[i] == "+" else 1 - p[v]) for v, k in patterns.items() if v[i] != "0")
            accuracy[i] = min(0.98, max(0.55, right / cast))
        if max(abs(a - b) for a, b in zip(accuracy, before, strict=True)) < 1e-9:
            break
    return {votes: round(1000 * posterior(votes)) for votes in patterns}


def test_weak_scores(documents, rows):
    votes = [(d, t, brute_votes(t)) for d, t in rows]
    posterior = expectation_maximisation(Counter(v for _, _, v in votes), 10)
    good, bad = defaultdict(int), defaultdict(int)
    for _, text, v in votes:
        for g in grams(words(text)):
            good[g] += posterior[v]
            bad[g] += 1000 - posterior[v]
    weights = log_ratio(good, bad, 1000.0)
    expected = Counter()
    for d, text, v in votes:
        found = grams(words(text))
        total = sum(weights[g] for g in found)
        expected[d, v, posterior[v], round(total / len(found), 6) if found else 0.0, bool(found) and posterior[v] >= 400 and total >= -400 * len(found)] += 1
    got = weak.classify(documents).select("doc_id", "votes", "posterior", F.round("score", 6), "kept").collect()
    assert Counter(map(tuple, got)) == expected
    assert len({v for _, _, v in votes}) > 5
