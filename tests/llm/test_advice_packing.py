"""Ids of texts that hold an added token of the tokenizer's file."""

import zlib

import numpy as np

import corpus_pipeline
from strandmill.llm import packing, queries
from tests.llm.helpers import docs

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", " <|endoftext|>\n", "a<|endoftext|", "x  <|endoftext|>  y z", "plain text here", ""]


def test_added_tokens(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: [*t.encode(x, add_special_tokens=False).ids, 1] for k, x in enumerate(TEXTS)}
    assert 50256 in want[0]
    table = docs(spark, list(enumerate(TEXTS)))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    for got in (queries.op5_packing(spark, str(tmp_path)).collect(), corpus_pipeline.pack_sequences(spark, table, "").collect()):
        assert {r["doc_id"] for r in got} == set(want)
        for r in got:
            part = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert r["doc_tokens"] == len(want[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())


def test_long_texts_in_parts(monkeypatch):
    """Texts that are encoded in parts have the ids that they have as a whole, whatever stands at the spaces."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tests.llm.helpers import prose
    from tests.llm.test_other_operators import SPACES

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(packing, "LONG", 37)
    encode = packing.tokenizer.__wrapped__("byte_bpe_50k.json", True)
    for text in [*SPACES, *TEXTS, *(prose(k, 60).replace(".", SPACES[k % len(SPACES)]) for k in range(40)), "x" * 500, "é " * 300, "a1 b2  c3 " * 40]:
        assert encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
