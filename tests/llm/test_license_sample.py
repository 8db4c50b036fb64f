from pyspark.sql import functions as F

from tidemark.llm import licenses


def test_sample_is_of_distinct_texts_with_other_licences(spark):
    lines = [f"line {i} of prose" for i in range(30)] + ["Licensed under the Sun and Moon Terms of the house."]
    texts = [(i, line) for i, line in enumerate(lines)] + [(100 + i, line) for line in lines[:3] for i in range(500)] + [(2000, "Released under the MIT License.")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    notices = licenses.with_features(spark.createDataFrame([(t,) for ts in licenses.TEMPLATES.values() for t in ts], "text string"), licenses.Training().buckets)
    templates = {"any": [sorted(set(r["_grams"])) for r in notices.collect()]}
    for size in (5, 2000):
        found = [r["text"] for r in licenses.unlike(licenses.paragraphs(docs), templates, licenses.Training(sample=size)).collect()]
        ranked = [r["text"] for r in docs.select("text").distinct().orderBy(F.xxhash64("text")).collect() if "MIT" not in r["text"]]
        assert sorted(found) == sorted(ranked[:size])


def test_lowest_texts_count_copies_once(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(70)] + [(None, "text 7"), (71, None), (72, "")], "doc_id long, text string")
    found = {most: [tuple(r) for r in licenses.lowest_texts(docs, most).collect()] for most in (0, 3, 100)}
    assert found[0] == [] and len(set(found[3])) == len(found[3]) == 3 and set(found[3]) < set(found[100])
    assert sorted(found[100]) == sorted([(None, ""), *[(None, f"text {i}") for i in range(8)]])
    assert licenses.lowest_texts(docs.where("false"), 5).count() == 0
