from tidemark.llm import licenses

BSD = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met."
GPL = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation."
PROSE = "The river ran past the mill and the fields beyond it were green in May. "


def test_wrapped_notices_are_confirmed(spark):
    texts = [
        (1, f"#!/bin/sh\n# Copyright 2020 the authors. All rights reserved.\n#\n{BSD}\n\nimport os"), (2, f"/*\n{GPL}\n */\nint main() {{}}"),
        (3, f"{PROSE * 60}\n{BSD[2:]}\n{PROSE * 60}"), (4, f"{PROSE}\n" * 400), (5, "A driver must carry a license\nand a permit at all times."), (6, None),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = licenses.scan_licenses(docs).where("confirmed").collect()
    assert {(r["doc_id"], r["family"]) for r in found} == {(1, "bsd"), (2, "gpl-3.0"), (3, "bsd")}
    pieces = [r["text"] for r in licenses.paragraphs(docs.where("doc_id = 4")).collect()]
    assert max(len(p.split()) for p in pieces) == licenses.SPAN and len(pieces) > 400
