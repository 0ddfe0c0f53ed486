"""Tree concatenation of texts and of pieces, with small leaves, against the library."""

import random

import numpy as np
import pytest

from kinfold.llm import bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def odd(seed=1, n=60):
    rnd = random.Random(seed)
    parts = ["a", "th", "'s", "'", "!", "é", "é", "\n", "  ", "3", "²", "ß", "क", "́", "Σ", "<|", "|>", "<|endoftext|>", "İ", "ﬀ", "\x1c", "\x85", "日本", "'re", "''", "straße", "1́"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(30, 300))) for _ in range(n)] + ["thequick" * 400, "'" * 700 + "s" * 700, "é" * 900, "a1" * 500]


@pytest.mark.parametrize("leaf", [1, 7, 64])
def test_halves_of_a_text(library, leaf):
    encoder = bpe.Encoder(bpe.default_vocabulary(), leaf=leaf, symbols=8)
    for x in odd(leaf):
        want = library.encode(x, add_special_tokens=False).ids
        ids, said = encoder.encode(x)
        assert np.frombuffer(ids, "<u4").tolist() == want and said == library.decode(want, skip_special_tokens=False)


def test_parts_as_rows(spark, library):
    texts = odd(9, 12) + [None, "", "short"]
    rows = [(i, x) for i, x in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bpe.encode(docs, spread=50, leaf=16).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode((texts[4] if r.doc_id is None else texts[r.doc_id]) or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want and r.n_tokens == len(want) and r.decoded == library.decode(want, skip_special_tokens=False)
    assert sorted(r.n_tokens for r in bpe.token_counts(docs, spread=50, leaf=16).collect()) == sorted(r.n_tokens for r in got)
