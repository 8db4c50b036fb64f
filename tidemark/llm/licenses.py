"""License scan: a trained paragraph classifier whose finds a template must confirm.

Paragraphs are lines up to a blank one, joined, and beside them single lines and sentences. A sparse logistic regression over hashed words
and word pairs tells licence families and an unknown class apart. It is trained
here, on notices written from the templates below and on a bounded sample of the
corpus's own paragraphs as the unknown class; soft thresholding keeps its weights
few. A temperature fitted on held-out paragraphs calibrates its chances. What it
calls a licence is compared with the family's templates and confirmed if it
holds enough of one's words and pairs. Scoring is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ngrams
from tidemark.llm.common import SPACES, Tables, once

#: Notices by family, as licensors write them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache License 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "This software is distributed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license.",
        "Released under the 3-Clause BSD License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL version 3 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute this library under the terms of the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This article is distributed under the terms of the Creative Commons Attribution 4.0 License, which permits unrestricted use and redistribution provided that the original author and source are credited.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This is an open access article distributed under the Creative Commons Attribution-NonCommercial License, which permits non-commercial use only.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "cc0": (
        "Released into the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "This work has been dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",
    ),
}
UNKNOWN = "unknown"
#: Prose that speaks of licences without being one.
NEAR_MISSES = (
    "The driver must carry a license and a permit at all times.",
    "The committee discussed which license to choose and put off the decision.",
    "A copy of the contract was sent under separate cover to the public office.",
    "Version 3 of the software was released under great pressure in May.",
    "The restaurant lost its license to sell alcohol and closed in the spring.",
    "Permission to film was granted by the mayor, and any person in the street could watch.",
    "Students at MIT built the first version of this software in a cellar.",
    "The general public may visit the museum free of charge on Sundays.",
    "All conditions of the sale were met and the copies were delivered without modification.",
    "The book compares the history of free software with that of the commons.",
    "Our commercial license allows redistribution to paying customers only; contact sales for terms.",
    "The university holds the copyright and all rights are reserved.",
)


#: Notices in other words. No fit sees them: they calibrate the chances.
REWORDED: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("The source is available under version 2.0 of the Apache License.", "Copyright 2019 the contributors; licensed under the Apache 2.0 license."),
    "mit": ("You may use this code under the MIT license.", "This module, like the rest, is MIT licensed; permission is granted to any person to copy it."),
    "bsd": ("Distributed under the BSD license, three clauses.", "Redistribution in source and binary forms is permitted provided that this notice is retained."),
    "gpl-3.0": ("You can modify this software under the GNU General Public License as published by the Free Software Foundation, version 3.", "This tool is released under the GNU GPL, version 3."),
    "lgpl": ("The library may be redistributed under the GNU Lesser General Public License.", "Licensed under the LGPL, the Lesser General Public License, version 2.1 or later."),
    "mpl-2.0": ("This file is covered by the Mozilla Public License, version 2.0.", "The terms of the Mozilla Public License 2.0 apply to this source code."),
    "cc-by": ("The figures are published under the Creative Commons Attribution 4.0 International license.", "This text is available under CC BY 4.0."),
    "cc-by-nc": ("Slides are licensed under a Creative Commons Attribution-NonCommercial 4.0 license.", "This dataset is released under CC BY-NC 4.0 terms."),
    "cc-by-sa": ("Pictures are shared under the Creative Commons Attribution-ShareAlike 4.0 International License.", "The content is available under CC BY-SA 4.0."),
    "cc0": ("The author waives all rights and dedicates this work to the public domain under CC0.", "Dedicated to the public domain under the CC0 1.0 Universal terms."),
}


@dataclass(frozen=True)
class Model:
    """Weights per bucket and class, scaled to whole numbers; the last class is the unknown one."""

    classes: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    templates: dict[str, list[list[int]]]


@dataclass(frozen=True)
class Training:
    """Bounds and rates of the fit: at most ``sample`` paragraphs of ``documents`` corpus texts are read as the unknown class."""

    sample: int = 2000
    documents: int = 4000
    buckets: int = ngrams.BUCKETS
    rounds: int = 300
    rate: float = 0.5
    sparsity: float = 2e-4
    share: float = 0.6
    chance: float = 0.8


#: What separates the lines and sentences of a text.
PIECE = r"\n|\x20(?<=[.!?]\x20)\x20*(?=[A-Z])"
#: What separates the sentences of lines that belong together. Looking back from a character that may separate is cheaper than from each.
SENTENCE = r"[\x20\t\r\n#*/;%!-](?<=[.!?][\x20\t\r\n#*/;%!-])[\x20\t\r\n#*/;%!-]*(?=[A-Z])"
#: White space and the marks of comments, which stand at the starts of lines and alone on blank ones.
_MARKS = r"[\x20\t\x0B\f\r#*/;%!-]*"
#: Words of a joined text that are classified at once, and how many of them the next ones repeat; notices are shorter than that.
SPAN, OVERLAP = 256, 64


def paragraphs(documents: DataFrame) -> DataFrame:
    """doc_id, paragraph (its number from 0) and text of every paragraph that has a word.

    First come the lines and the sentences of lines. Then come, of the lines up
    to a blank one, without comment marks and joined by spaces: the sentences
    that go over the end of a line, and the whole, where it is more than one
    line or sentence. A whole of more than ``SPAN`` words is given as spans
    that overlap, so that it can't hold a notice by its mere length.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = lambda b: F.regexp_replace(b, rf"[\x20\t\x0B\f\r]*\n{_MARKS}", " ")
    rows = once(rows, "_blocks", F.filter(F.split("text", rf"\n(?:{_MARKS}\n)+", -1), lambda b: b.rlike(PIECE)))
    sentences = F.flatten(F.transform("_blocks", lambda b: F.split(b, SENTENCE, -1)))
    wrapped = F.transform(F.filter(sentences, lambda x: F.btrim(x, F.lit(SPACES)).contains("\n")), joined)

    def spans(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - OVERLAP, F.lit(1)), F.lit(SPAN - OVERLAP))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, SPAN), " "))

    words = F.transform("_blocks", lambda b: F.split(joined(b), " +", -1))
    whole = F.flatten(F.transform(words, spans))
    pieces = F.concat(F.split("text", PIECE, -1), wrapped, whole)
    rows = rows.select("doc_id", F.posexplode(pieces).alias("paragraph", "text"))
    return rows.withColumn("text", F.btrim("text", F.lit(SPACES))).where("text <> ''")


#: What stands between the words of a paragraph in lower case. Java looks characters that are named one by one up in a table, but
#: tests ranges in turn, which takes five times as long.
BETWEEN = "[^abcdefghijklmnopqrstuvwxyz0123456789.+-]+|[.](?![0123456789])"


def with_features(rows: DataFrame, buckets: int) -> DataFrame:
    """Add ``_grams``: buckets of the lower-cased words, without punctuation at their ends, and of pairs."""
    clean = F.regexp_replace(F.lower("text"), BETWEEN, " ")
    rows = once(rows, "_clean", F.btrim(clean))
    rows = once(rows.where("_clean <> ''"), "_hashes", ngrams.hashes(F.split("_clean", " +", -1)))
    rows = once(rows, "_pairs", ngrams.neighbours(F.col("_hashes")))
    grams = F.transform(F.concat("_hashes", "_pairs"), lambda h: ngrams.bucket(h, buckets))
    return once(rows, "_grams", grams).drop("_clean", "_hashes", "_pairs")


def _variants(text: str) -> list[str]:
    """A notice as it stands and as it appears among other words."""
    bare = text.rstrip(".")
    return [text, bare, f"Copyright 2021 the authors. {text}", f"{bare} by the authors", f"Note: {text} See the file for details."]


def held_share(notices: list[list[int]]) -> Column:
    """The largest share of a notice's distinct buckets that ``_grams`` holds."""
    return F.greatest(*[F.size(F.array_intersect("_grams", F.array(*[F.lit(g) for g in notice]))) / len(notice) for notice in notices], F.lit(0.0))


def unlike(rows: DataFrame, templates: dict[str, list[list[int]]], training: Training) -> DataFrame:
    """The ``training.sample`` distinct texts of the lowest hashes that hold no template's share.

    Only hashes are told apart over the whole corpus, and texts only up to the
    last hash that is needed. Whether a text holds a template is asked of twice
    as many texts as are needed, and of more where too few of them remain.
    """
    hashed = rows.select("text", F.xxhash64("text").alias("_hash"))
    asked = 2 * training.sample
    while True:
        hashes = [r[0] for r in hashed.select("_hash").distinct().orderBy("_hash").limit(asked).collect()]
        lowest = hashed.where(F.col("_hash") <= (hashes[-1] if hashes else 0)).distinct()
        share = F.greatest(*[held_share(notices) for notices in templates.values()], F.lit(0.0))
        left = with_features(lowest, training.buckets).where(share < training.share).orderBy("_hash", "text").limit(training.sample).select("text").collect()
        if len(left) == training.sample or len(hashes) < asked:
            return rows.sparkSession.createDataFrame([(r["text"],) for r in left], "text string")
        asked *= 4


def lowest_texts(documents: DataFrame, most: int) -> DataFrame:
    """The distinct texts of the ``most`` lowest hashes, with a null doc_id: a bounded sample in which copies count once."""
    hashed = documents.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").withColumn("_hash", F.xxhash64("text"))
    hashes = [r[0] for r in hashed.select("_hash").distinct().orderBy("_hash").limit(most).collect()]
    lowest = hashed.where(F.col("_hash") <= hashes[-1] if hashes else F.lit(False)).distinct()
    return lowest.select(F.lit(None).cast("bigint").alias("doc_id"), "text")


def train(spark: SparkSession, documents: DataFrame, training: Training = Training()) -> Model:
    """Fit the classifier on the buckets that notices have.

    The sample is the distinct paragraphs of the lowest hashes that no template
    confirms, out of a bounded number of texts. One that speaks of licences without being one is among them. The
    chances are calibrated on rows that the fit hasn't seen: notices in other
    words, every third near miss and every tenth paragraph of the sample.
    """
    known = [(kind, False, variant) for kind, notices in TEMPLATES.items() for notice in notices for variant in _variants(notice)]
    known += [(kind, True, variant) for kind, notices in REWORDED.items() for notice in notices for variant in _variants(notice)]
    known += [(UNKNOWN, i % 3 == 2, text) for i, text in enumerate(NEAR_MISSES)]
    labelled = spark.createDataFrame(known, "kind string, held boolean, text string")
    noticed = spark.createDataFrame([(k, t) for k, ts in TEMPLATES.items() for t in ts], "kind string, text string")
    notices = with_features(noticed, training.buckets).select("kind", F.col("_grams").alias("grams")).collect()
    templates: dict[str, list[list[int]]] = {}
    for row in notices:
        templates.setdefault(row["kind"], []).append(sorted(set(row["grams"])))
    tables = Tables(spark)
    texts = tables.put("texts", lowest_texts(documents, training.documents))
    sample = unlike(paragraphs(texts), templates, training).select(F.lit(UNKNOWN).alias("kind"), "text")
    tables.drop("texts")
    sample = sample.select("kind", (F.pmod(F.xxhash64("text"), F.lit(10)) == 9).alias("held"), "text")
    rows = with_features(labelled.unionByName(sample), training.buckets)
    rows = rows.select("kind", "held", F.col("_grams").alias("grams"), F.xxhash64("text").alias("at")).orderBy("kind", "held", "at").collect()
    classes = (*TEMPLATES, UNKNOWN)
    seen = np.array(sorted({g for row in rows if row["kind"] != UNKNOWN and not row["held"] for g in row["grams"]}))
    column = {g: i for i, g in enumerate(seen.tolist())}
    x = np.zeros((len(rows), len(seen)), np.float32)
    y = np.array([classes.index(row["kind"]) for row in rows])
    for i, row in enumerate(rows):
        np.add.at(x[i], [column[g] for g in row["grams"] if g in column], 1.0 / max(1.0, np.sqrt(len(row["grams"]))))
    held = np.array([row["held"] for row in rows])
    w, b = fit(x[~held], y[~held], len(classes), training)
    heat = calibrated(x[held] @ w + b, y[held])
    weights = np.zeros((training.buckets, len(classes)), np.int64)
    weights[seen] = np.rint(w * heat * ngrams.SCALE).astype(np.int64)
    return Model(classes, weights, np.rint(b * heat * ngrams.SCALE).astype(np.int64), templates)


def fit(x: np.ndarray, y: np.ndarray, classes: int, training: Training) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a logistic regression whose classes weigh alike; soft thresholding keeps the weights few."""
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    target = np.eye(classes, dtype=np.float32)[y]
    balance = (1.0 / np.maximum(1, np.bincount(y, minlength=classes)))[y]
    weight = (balance / max(balance.sum(), 1e-12))[:, None].astype(np.float32)
    for _ in range(training.rounds):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        gap = (p / p.sum(axis=1, keepdims=True) - target) * weight
        w -= training.rate * 20 * (x.T @ gap)
        b -= training.rate * 20 * gap.sum(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - training.rate * training.sparsity, 0)
    return w, b


def calibrated(z: np.ndarray, y: np.ndarray) -> float:
    """The factor of the logits that makes the chances of held-out rows most likely, each class weighing alike."""
    balance = (1.0 / np.maximum(1, np.bincount(y)))[y]

    def loss(heat: float) -> float:
        e = (z - z.max(axis=1, keepdims=True)) * heat
        return float(-(balance * (e[np.arange(len(y)), y] - np.log(np.exp(e).sum(axis=1)))).sum())

    return float(min(np.linspace(0.25, 4, 40), key=loss)) if len(y) else 1.0


def scan(documents: DataFrame, model: Model, training: Training = Training()) -> DataFrame:
    """One row per licence paragraph: doc_id, paragraph, family, chance, similarity, confirmed.

    Every paragraph of every text is classified; those of the unknown class
    have no row. A notice can have a row for its line and one for what it is
    joined into. ``similarity`` is the largest share of a family template's
    distinct buckets that the paragraph holds. The sum of each bucket's largest
    lead over the unknown class bounds every family's lead, so a paragraph in
    which it isn't reached is of the unknown class. Null and empty texts have no
    paragraphs; repeated rows give repeated results. No row is moved.
    """
    rows = with_features(paragraphs(documents), training.buckets)
    lead, ahead = (model.weights[:, :-1] - model.weights[:, -1:]).max(axis=1), int((model.bias[:-1] - model.bias[-1]).max())
    scale = F.sqrt(F.size("_grams").cast("double"))
    rows = rows.where(ngrams.score(F.col("_grams"), ngrams.table(lead.tolist())) / scale + F.lit(ahead) >= -1)
    weighty = F.split(F.lit(",".join("1" if row.any() else "0" for row in model.weights)), ",").cast("array<int>")
    rows = once(rows, "_hits", F.filter("_grams", lambda g: F.get(weighty, g) == 1)).where(F.size("_hits") > 0)
    logits = [ngrams.score(F.col("_hits"), ngrams.table(model.weights[:, k].tolist())) / scale + F.lit(int(model.bias[k])) for k in range(len(model.classes))]
    rows = once(rows, "_logits", F.array(*logits)).withColumn("_top", F.array_max("_logits"))
    rows = once(rows, "_class", F.array_position("_logits", F.col("_top")).cast("int")).where(F.col("_class") <= len(TEMPLATES))
    total = F.aggregate("_logits", F.lit(0.0), lambda a, z: a + F.exp((z - F.col("_top")) / ngrams.SCALE))
    rows = rows.withColumn("chance", F.round(F.lit(1.0) / total, 6)).withColumn("family", F.get(F.array(*[F.lit(c) for c in model.classes]), F.col("_class") - 1))
    shares = F.lit(0.0)
    for family, notices in model.templates.items():
        shares = F.when(F.col("family") == family, held_share(notices)).otherwise(shares)
    rows = rows.withColumn("similarity", F.round(shares, 6))
    return rows.select("doc_id", "paragraph", "family", "chance", "similarity", ((F.col("chance") >= training.chance) & (F.col("similarity") >= training.share)).alias("confirmed"))


def scan_licenses(documents: DataFrame, training: Training = Training()) -> DataFrame:
    """Train on the documents' own bounded sample and scan them all."""
    return scan(documents, train(documents.sparkSession, documents, training), training)
