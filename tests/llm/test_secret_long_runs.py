"""Long runs take time in proportion, and exhaust no stack."""

import time

from tests.llm.test_operators import brute_spans, multiset
from tidemark.llm import secrets


def test_long_runs(spark):
    rows = [(1, "1234567890" * 10_000 + "z"), (2, "ab/c1." * 10_000 + "+"), (3, "ab/c1." * 60_000), (4, "aB3" * 30_000), (5, "token " * 40_000), (6, "AKIA" * 40_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    began = time.monotonic()
    found = {r["doc_id"]: r for r in secrets.secret_report(frame).collect()}
    assert time.monotonic() - began < 90
    assert found[3]["spans"] == "" and found[1]["n_hex"] == 1
    for at in (1, 2, 5, 6):
        assert found[at]["base_sha256"] == brute_spans(rows[at - 1][1])[3]


def test_other_windows(spark):
    rule = secrets.Entropy(window=40, classes=(("mixed", "^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).*$", 4.2),))
    text = "x " + "aB3dE5fG7hI9jK1lM3nO5pQ7rS9tUvWxYz0246813579ACEG" + " y " + "aB1" * 20
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert multiset([r["spans"] for r in secrets.secret_report(frame, rule).collect()]) == multiset(["entropy:2:50"])
