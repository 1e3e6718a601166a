import random

import numpy as np
import pytest

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from quarry.llm import pieces as P  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return P.Pieces.load(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


EDGES = [None, "", " ", "  ", "▁", "a▁ b", "\x00", "日本語 テスト", "😀😀 x", "a" * 40, " " * 700,
         "\n" * 50, "x" * 3000, "  leading", "trailing  ", "é", "<s></s><unk>", "<0x41>",
         "word " * 900]


def _random_texts(seed, n, alphabet, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest)))
            for _ in range(n)]


@pytest.mark.parametrize("texts", [
    EDGES, _random_texts(1, 400, "ab th eiou▁\nñé日😀0=", 200),
    _random_texts(2, 80, "thereinonand", 900)], ids=["edges", "mixed", "long words"])
def test_ids_and_text_equal_the_library(model, library, texts):
    flat, bounds = model.decoder()
    for text, ids in zip(texts, P._encode_batch(model, P.Memory(), texts)):
        want = library.encode(text or "")
        assert ids.tolist() == want
        assert model.decode(ids, flat, bounds) == library.decode(want)


def test_any_ids_decode_like_the_library(model, library):
    flat, bounds = model.decoder()
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(0, 700) if rng.random() < 0.5 else rng.randrange(32000)
               for _ in range(rng.randrange(12))]
        assert model.decode(np.array(ids, int), flat, bounds) == library.decode(ids)


def test_rounds_and_queue_agree(model):
    for word in _random_texts(4, 40, "thearinos0", 300):
        if word:
            assert model._rounds([word])[0].tolist() == model._queue(word).tolist()


def test_operator_handles_nulls_repeats_clashes_and_empty_tables(frame, library):
    rows = [(1, "The cat."), (1, "The cat."), (None, None), (4, "")]
    docs = frame(rows, "doc_id long, text string", clash=("ids", "decoded", "word"))
    got = P.encode(docs, PATH).collect()
    assert sorted((r.doc_id or 0, list(r.ids), r.decoded) for r in got) == sorted(
        (i or 0, library.encode(t or ""), t or "") for i, t in rows)
    assert P.encode(docs.filter("doc_id = 99"), PATH).count() == 0
