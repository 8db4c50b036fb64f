from tidemark.llm import secrets

KEY = "9aF3kLm2Qx7Zt8Wp4Rb6Yc1"


def test_placeholders_excuse_only_their_part(spark):
    blob = "Zq8Lr3Vn6Tb1Kd9Xw4Mf7" * 4
    texts = [f"EXAMPLE_SERVICE_KEY={KEY}", f"api.example.com/v1/keys/{KEY} end", f"{blob}xxxx{blob}", "my_exampleA1b2C3d4E5f6G7h8I9", f"{KEY}/dummy"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    masked = [r["text"] for r in secrets.redact(frame).orderBy("doc_id").collect()]
    assert KEY not in masked[0] and KEY not in masked[1] and KEY not in masked[4]
    assert masked[1].endswith("<secret> end") and masked[2] == "<secret>" and masked[3] == texts[3]
    spans = {r["doc_id"]: r["spans"] for r in secrets.secret_report(frame).collect()}
    assert all("entropy" in spans[i] for i in (0, 1, 2, 4)) and spans[3] == ""
