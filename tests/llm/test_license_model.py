"""Chances and similarities recomputed from the model, and notices in words it hasn't seen."""

import math
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm.brute_hash import grams
from tests.llm.test_operators import EDGES
from tidemark.llm import licenses, ngrams

WRAPPED = """/*
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met.
 */
int main() {}
"""
UNSEEN = {
    800001: ("mit", "The library and its documentation are made available under the MIT license, see COPYING."),
    800002: ("apache-2.0", "All files in this folder are covered by the Apache License, Version 2.0, unless stated otherwise."),
    800003: ("gpl-3.0", "You may copy this program under the terms of the GNU General Public License, version 3."),
    800004: ("cc-by-sa", "Photographs are licensed under the Creative Commons Attribution-ShareAlike 4.0 license."),
    800005: ("bsd", WRAPPED),
}
PLAIN = ["She asked for permission to use the software, which was granted.", "The public license office opens at nine.", "Attribution of the painting to Vermeer is disputed.", "Redistribution of wealth was the theme of the debate."]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [*EDGES, *[(d, t) for d, (_, t) in UNSEEN.items()], *[(810000 + i, t) for i, t in enumerate(PLAIN)], (820000, "\n\n".join(licenses.TEMPLATES["mit"][3:]))]
    base = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    out = base.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    for clash in ("paragraph", "_grams", "family", "chance", "_top"):
        out = out.withColumn(clash, F.lit("clash"))
    return out.repartition(4).checkpoint()


@pytest.fixture(scope="module")
def model(spark, documents):
    return licenses.train(spark, documents)


def brute(doc_id, paragraph, text, model, training):
    clean = re.sub(r"[^a-z0-9.+-]+|[.](?![0-9])", " ", text.lower()).strip(" ")
    if not clean:
        return None
    found = grams(re.split(" +", clean), training.buckets)
    hits = [g for g in found if model.weights[g].any()]
    if not hits:
        return None
    logits = [sum(int(model.weights[g, k]) for g in hits) / math.sqrt(len(found)) + int(model.bias[k]) for k in range(len(model.classes))]
    top = logits.index(max(logits))
    if model.classes[top] == licenses.UNKNOWN:
        return None
    chance = 1 / sum(math.exp((z - max(logits)) / ngrams.SCALE) for z in logits)
    similarity = max(len(set(notice) & set(found)) / len(notice) for notice in model.templates[model.classes[top]])
    return doc_id, paragraph, model.classes[top], chance, similarity


def test_scores_are_the_model_s(documents, model):
    training = licenses.Training()
    found = {(r["doc_id"], r["paragraph"], round(r["chance"], 5), round(r["similarity"], 5), r["family"], r["confirmed"]) for r in licenses.scan(documents, model, training).collect()}
    expected = set()
    for r in licenses.paragraphs(documents).collect():
        if b := brute(r["doc_id"], r["paragraph"], r["text"], model, training):
            expected.add((b[0], b[1], round(round(b[3], 6), 5), round(round(b[4], 6), 5), b[2], round(b[3], 6) >= training.chance and round(b[4], 6) >= training.share))
    assert len(expected) > 10 and found == expected


def test_unseen_wording(documents, model):
    found = licenses.scan(documents.where("doc_id >= 800000"), model).collect()
    best = {}
    for r in found:
        if r["doc_id"] in UNSEEN and r["chance"] > best.get(r["doc_id"], (0, ""))[0]:
            best[r["doc_id"]] = (r["chance"], r["family"])
    assert {d: family for d, (_, family) in best.items()} == {d: family for d, (family, _) in UNSEEN.items()}
    assert not [r for r in found if 810000 <= r["doc_id"] < 820000 and r["confirmed"]]
    assert {r["family"] for r in found if r["doc_id"] in (800005, 820000) and r["confirmed"]} == {"bsd", "mit"}
