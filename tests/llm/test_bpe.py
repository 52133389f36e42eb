import hashlib
import random

import numpy as np
import pytest

from sparvane.llm import bpe

LETTERS = [*"aB'sS tTreéÉ.,!\n\t\x1c\x85\xa0\u3000\u0301ΣİßǅªºΩ日12²½_-ﬁ😀<|", "<|endoftext|>", "'ll", "'VE", "aa "]


def test_ids_and_decoding_equal_the_library():
    rng, words = random.Random(2), bpe.WordEncoder(most=200)
    store = bpe.ChunkStore(words, most_chars=5_000)
    for i in range(3000):
        text = "".join(rng.choices(LETTERS, k=rng.randint(0, 30))) * (1 + i % 40 // 39 * 90)
        wanted = words.tokenizer.encode(text, add_special_tokens=False).ids
        ids = bpe.encode_text(text, store)
        assert np.frombuffer(ids, "<u4").tolist() == wanted, text
        assert words.decode(ids) == words.tokenizer.decode(wanted, skip_special_tokens=False)


def test_shared_passages_are_encoded_once():
    rng = random.Random(4)
    make = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))
    passage, store = make(4000), bpe.ChunkStore(bpe.encoder())
    bpe.encode_text(make(300) + " " + passage, store)
    before = store.hits
    bpe.encode_text(make(500) + passage, store)
    assert store.hits - before > 0.8 * len(bpe.cuts(passage))


def test_encode_decode_frames(spark):
    docs = spark.createDataFrame([(1, "Hello World", "x"), (1, "Hello World", "x"), (2, None, None), (None, "", "y"), (3, "x" * 200_000, "")], "doc_id long, text string, ids string")
    out = bpe.encode(docs).toPandas()
    assert len(out) == 5
    library = bpe.encoder().tokenizer
    for r in out.itertuples():
        assert r.decoded == library.decode(list(r.ids), skip_special_tokens=False) and r.n_tokens == len(r.ids)
    assert out[out.doc_id == 1].decoded.tolist() == ["hello</w> world</w>"] * 2
    assert sorted(bpe.decode(bpe.encode(docs)).toPandas().decoded) == sorted(out.decoded)
    digest = bpe.digests(docs).toPandas()
    assert digest[digest.doc_id == 2].ids_sha256.tolist() == [hashlib.sha256(b"").hexdigest()]
    assert bpe.encode(docs.limit(0)).count() == 0


def test_vocabularies_of_another_kind_are_refused():
    with pytest.raises(ValueError, match="not a vocabulary of words"):
        bpe.WordEncoder("byte_bpe_50k.json")
