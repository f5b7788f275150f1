import hashlib
import random

import cases
import numpy as np
import pytest

from wattspan.llm.bpe import Codec, decode_documents, encode_documents, round_trip_digests

AWKWARD = [
    "", "  ", "a  b", "hello\n\n world's  \t x", "x<|endoftext|> y <|endoftext|>", "日本語   é́", "a" * 300 + " " + "ab12" * 100,
    "\x1c a\x1d", "'sall I'LL don't", " \n ", "\r\n\r\nA1b2", "¿Qué?", "𝔘nicode 𝟘𝟙", "zero​width", "\x00\x01", "!!!???...  ...",
    "tab\t\tword", "x " * 5 + "\n  y", "　wide　", "9" * 70_000,
]


@pytest.fixture(scope="module")
def library(byte_bpe):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe)


def test_equals_the_library(byte_bpe, library):
    draw = random.Random(1)
    noise = ["".join(chr(draw.choice([32, 32, 10, 97, 101, 116, 49, 33, 39, 233, 0x4E00, 0x1F600])) for _ in range(200)) for _ in range(50)]
    own = Codec(byte_bpe, held=500)
    texts = AWKWARD + noise + [cases.prose(400, 1)]
    ids = own.encode(texts)
    for text, one in zip(texts, ids):
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(one, "<u4").tolist() == expected, text[:40]
    assert own.decode(ids) == texts
    broken = [np.array([x], "<u4").tobytes() for x in range(120, 260)]
    assert own.decode(broken) == [library.decode([x], skip_special_tokens=False) for x in range(120, 260)]


def test_documents_round_trip(docs, empty, byte_bpe, library):
    rows = docs.collect()
    digests = {(r.doc_id, r.ids_sha256): r for r in round_trip_digests(docs, byte_bpe).collect()}
    for r in rows:
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()
        one = digests[(r.doc_id, hashlib.sha256(ids).hexdigest())]
        assert one.n_tokens == len(ids) // 4
        assert one.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    coded = encode_documents(docs, byte_bpe)
    back = sorted((r.doc_id or 0, r.text) for r in decode_documents(coded, byte_bpe).collect())
    assert back == sorted((r.doc_id or 0, r.text or "") for r in rows)
    assert round_trip_digests(empty, byte_bpe).collect() == []
    assert decode_documents(encode_documents(empty, byte_bpe), byte_bpe).collect() == []
