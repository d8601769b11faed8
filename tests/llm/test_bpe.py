import hashlib
import random
from pathlib import Path

import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from noticelake.llm.bpe import Coder, contract, encode, read_ranks

LINES = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(LINES), special_tokens={})


def odd_texts():
    rng = random.Random(1)
    signs = "abcdeXY ñé鿦\n\t  　\x85\x1c\x00'sll123²Ⅷ.,!-😀"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    return [*texts, "", "a" * 3000, " " * 500, "ab" * 2000, "<|endoftext|> it's  we'll\r\n\r\n x "]


def test_against_library(library):
    texts = odd_texts()
    ids, n, decoded = Coder.get(LINES, public_tokenizers.PATTERN).code(pa.array(texts))
    for text, a, k, back in zip(texts, ids.to_pylist(), n.tolist(), decoded.to_pylist()):
        expected = library.encode_ordinary(text)
        assert a == ",".join(map(str, expected)) and k == len(expected) and back == text.encode()


def test_heap_contraction(library):
    rng, ranks = random.Random(2), read_ranks(LINES)
    for _ in range(100):
        piece = "".join(rng.choice("abcde ñé鿦\n") for _ in range(rng.randint(1, 300))).encode()
        assert contract(piece, ranks) == library._encode_single_piece(piece)


def test_rows(spark, library):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", None), (None, "the cat's  hat", None), (4, "word " * 60000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(2)
    found = encode(docs, LINES, public_tokenizers.PATTERN, with_values=True).collect()
    assert len(found) == len(rows)
    for r in found:
        text = next(t or "" for k, t, _ in rows if k == r.doc_id)
        expected = library.encode_ordinary(text)
        assert r.n_tokens == len(expected) and r.decoded == text.encode() and r.ids == ",".join(map(str, expected))
        assert r.ids_sha256 == hashlib.sha256(r.ids.encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert encode(docs.limit(0), LINES, public_tokenizers.PATTERN).collect() == []
