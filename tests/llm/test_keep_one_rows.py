from tidemark.llm import neardup


def test_rows_that_share_an_id_are_kept_by_their_text(spark):
    words = lambda name: " ".join(f"{name}{i}" for i in range(40))
    data = [
        (1, words("a"), "x"), (2, words("a"), "copy of a smaller id"), (2, words("b"), "clean"), (3, words("c"), "y"), (3, words("d"), "z"),
        (4, words("e"), "near"), (4, words("e") + " more", "near"), (5, words("f"), "p"), (5, words("f"), "o"), (6, None, "q"), (6, words("g"), "r"), (None, words("a"), "s"),
    ]
    frame = spark.createDataFrame(data, "doc_id long, text string, _tie string")
    kept = [sorted(map(repr, neardup.keep_one(frame.repartition(n)).collect())) for n in (1, 3, 7)]
    assert kept[0] == kept[1] == kept[2]
    out = neardup.keep_one(frame)
    assert out.columns == frame.columns
    got = sorted((r["doc_id"] or 0, r["_tie"]) for r in out.collect())
    assert got == [(0, "s"), (1, "x"), (2, "clean"), (3, "y"), (3, "z"), (4, "near"), (5, "o"), (6, "q"), (6, "r")]
