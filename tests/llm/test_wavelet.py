import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillspark.llm import wavelet

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n_tokens string"


def test_shard_answers_like_the_list():
    rng = random.Random(3)
    ids = np.array([rng.choice([1, 7, 7, 300, 49407]) for _ in range(70_000)] + [0])
    shard = wavelet.WaveletShard(wavelet.build_shard(ids, [5, 6], [70_000, 1], 49_408))
    assert (shard.tokens() == ids).all()
    where = np.flatnonzero(ids == 7)
    for i in (0, 1, 511, 65_535, 65_536, 70_000):
        assert shard.access(i) == ids[i]
        assert shard.count(7, i) == int((ids[:i] == 7).sum())
    for k in (0, 5, len(where) // 2, len(where) - 1):
        assert shard.locate(7, k) == where[k]
    assert shard.locate(7, len(where)) == -1 and shard.count(9) == 0 and shard.count(1 << 20) == 0
    assert [(d, s, len(x)) for d, s, x in shard.documents()] == [(5, 0, 70_000), (6, 70_000, 1)]


def test_equals_whole_text_encoding(spark):
    texts = ["", None, "It's 42,000 naïve cafés!! é", "a\n\t b" * 9, "<|endoftext|> x<|endoftext|>y", "word " * 30_000, "word " * 30_000, "İΣς 가 日本"]
    rows = [(i * 3, t, "clash") for i, t in enumerate(texts)] + [(3, "again", None), (None, "no id", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = wavelet.encode_and_read(df, PATH).collect()
    plain, start, expected = Tokenizer.from_file(PATH), 0, []
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_many_shards_and_empty_table(spark):
    df = spark.createDataFrame([(i, "one two three", None) for i in range(100)], SCHEMA)
    shards = wavelet.write_shards(df, PATH, shard_tokens=40)
    assert shards.count() >= 10
    rows = sorted(wavelet.read_documents(shards).collect())
    assert [r.start for r in rows] == [4 * i for i in range(100)]
    assert wavelet.encode_and_read(df.limit(0), PATH).count() == 0


def test_one_id_for_most_rows(spark):
    """Rows without an id, or of one id, go to several ranges, and starts still add up."""
    texts = [f"text {i % 7} " * (i % 5) for i in range(300)]
    rows = [(None if i % 3 else 8, t, "") for i, t in enumerate(texts)] + [(i, "x", "") for i in range(20)]
    df = spark.createDataFrame(rows, "`doc.id` long, `te``xt` string, part string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = wavelet.save(wavelet.write_shards(df, PATH, id_col="doc.id", text_col="te`xt", shard_tokens=100), "shards")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.part for r in shards.select("part").collect()}) > 1
    got = wavelet.read_documents(shards).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    by_start = sorted(got, key=lambda r: r.start)
    at = 0
    for r in by_start:
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in by_start]
    assert ids == sorted(ids)
