import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from quillspark.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", "a", " a", "a ", "  a   b ", "\n\n x\ty", "naïve ﬁ 日本語テキスト 🎉🎉 emoji", "a" * 27, "            lots    of     spaces",
    "ab▁cd", "▁", "<s> </s> <unk> <0x41>", "lololololol banana bananana", "x" * 3000, "ha" * 999, "\0nul", "été İstanbul ß ẞ", "é", "www.example.com/i.e.,x...!?",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_equals_the_library(library):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abet hinos .,\n'éß") for _ in range(rng.randrange(200))) for _ in range(400)]
    model = pieces.Pieces(PATH)
    for text, ids in zip(texts, model.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text), text
        assert model.decode(ids).decode() == library.decode(library.encode(text))


def test_operator(spark, library):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(None, "no id", 0), (1, None, 0), (1, "twice", 0), (1, "twice", 0), (2, "long words " * 20_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    got = sorted(map(str, map(tuple, pieces.round_trips(df, PATH).collect())))
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "")
        out = library.decode(ids)
        want.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32(out.encode()), out == (text or "").replace("▁", " ")))
    assert got == sorted(map(str, want))
    back = pieces.decode_pieces(pieces.encode_pieces(df, PATH), PATH)
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(str((i, (t or "").replace("▁", " "))) for i, t, _ in rows)
    assert pieces.round_trips(df.limit(0), PATH).count() == 0


def test_unigram_state_is_the_best_sum():
    """The same walk with the best sum as its state, against all splits."""
    model = pieces.Pieces(PATH)
    model.merges = False
    model.score = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "ba": -3.1, "▁a": -4.1, "aba": -6.2}

    def all_splits(word):
        if not word:
            yield ()
        for i in range(1, len(word) + 1):
            if i == 1 or word[:i] in model.score:
                yield from ((word[:i], *rest) for rest in all_splits(word[i:]))

    total = lambda split: sum(model.score.get(p, model.least) for p in split)
    words = sorted({"▁" + "".join(x) for x in (random.Random(i).choices("abc", k=i % 7) for i in range(60))})
    for word, split in zip(words, model.split_words(words)):
        assert "".join(split) == word
        assert abs(total(split) - max(map(total, all_splits(word)))) < 1e-9
