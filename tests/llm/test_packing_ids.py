import zlib

import numpy as np

from tidemark.llm import packing


def test_added_tokens_are_encoded_as_tokenizers_does(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    contract = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|> is text", "a<|endoftext|><|endoftext|>b", "plain <|endoftext|", "<|endoftext|>"]
    found = packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in found:
        ids = [*contract.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["length"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert contract.encode(texts[0], add_special_tokens=False).ids == [50256, 318, 2420]
