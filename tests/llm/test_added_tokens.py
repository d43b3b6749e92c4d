"""Added tokens of the tokenizer file in running text get their ids, as in the public library."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from corpuslens.llm import packing
from corpuslens.llm.queries import BYTE_BPE

TEXTS = [
    "hello <|endoftext|> world",
    "<|endoftext|>",
    "<|endoftext|><|endoftext|> I'll\n\n<|endoftext|>\n",
    "a  <|endoftext|>  b <|endoftext <|ENDOFTEXT|> été<|endoftext|>漢字",
    "word " * 3000 + "<|endoftext|>" + " more words" * 3000,
    "none at all",
]


def test_ids_are_those_of_the_library():
    plain, own = Tokenizer.from_file(BYTE_BPE), packing.Tokeniser(BYTE_BPE, added=True)
    for text in TEXTS:
        assert own(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packed_pieces(spark):
    plain = Tokenizer.from_file(BYTE_BPE)
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string"), BYTE_BPE)
    want = [np.array(plain.encode(t, add_special_tokens=False).ids + [0], dtype="<u4") for t in TEXTS]
    pieces = rows.collect()
    assert sum(r.length for r in pieces) == sum(map(len, want))
    for r in pieces:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
