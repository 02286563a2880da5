import zlib

import numpy as np
import pytest

from tagloom.llm import packing


def test_added_tokens_have_the_ids_of_the_file(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    assert "<|endoftext|>" in added
    texts = ["a b c", "", *[f"a {t} b" for t in added], *[f"{t}x{t} y  {t}" for t in added], "plain words", "<|endoftext |>", "\u6f22 \u5b57"]
    ids = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.file_ids(texts, path)] == ids
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = packing.pack(table, path).collect()
    crc = lambda x: zlib.crc32(np.asarray([*x, packing.END_ID], "<u4").tobytes())
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in found} == {k: (len(x) + 1, crc(x)) for k, x in enumerate(ids)}
