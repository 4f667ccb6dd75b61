"""Token-ID output: one wavelet-matrix file per shard of the token stream.

A shard holds the ids of consecutive documents (ascending doc_id) as bit-planes, most
significant plane first, every plane stably partitioned by the plane above. Planes
are cut into blocks of ``BLOCK`` bits, each compressed alone, beside a directory of
block offsets and the number of ones before each block. So one file answers

* ``access(i)``: the id at a position, ``documents()``: all ids again,
* ``count(id, i)``: occurrences before a position (rank),
* ``locate(id, k)``: the position of the k-th occurrence (select),

and reads only the blocks that it touches. Files travel as one binary column written
by Spark's own writer, so they can stand in any store that Spark reaches.

Defined results: a null text is the empty text; a document without tokens still has
its end id; a null doc_id sorts first; repeated doc_ids stand beside each other, by
text; other columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, save
from .words import Words, classes, first_places, ragged

BLOCK = 1 << 16
MAGIC = b"QWM1"
SHARD_TOKENS = 1 << 21

# ------------------------------------------------------------------ the file format


def build_shard(ids: np.ndarray, doc_ids: list, lengths: list[int], vocab: int) -> bytes:
    """The file of one shard. ids: the concatenated ids of all its documents."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    planes = max(1, int(max(vocab - 1, 1)).bit_length())
    seq = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    zeros, offsets, ones, body, at = [], [], [], [], 0
    for level in range(planes - 1, -1, -1):
        bit = (seq >> seq.dtype.type(level)).astype(np.uint8) & 1
        mask = bit.view(bool)
        zeros.append(int(len(seq) - np.count_nonzero(mask)))
        packed = np.packbits(bit).tobytes()
        level_offsets, level_ones, before = [at], [0], 0
        for start in range(0, len(packed), BLOCK // 8):
            block = pack(packed[start : start + BLOCK // 8])
            body.append(block)
            at += len(block)
            level_offsets.append(at)
            before += int(np.count_nonzero(mask[start * 8 : start * 8 + BLOCK]))
            level_ones.append(before)
        offsets.append(level_offsets)
        ones.append(level_ones)
        seq = np.concatenate([seq[~mask], seq[mask]])
    head = json.dumps({"n": len(ids), "planes": planes, "zeros": zeros, "offsets": offsets, "ones": ones}).encode()
    docs = json.dumps([doc_ids, lengths]).encode()
    head, docs = zlib.compress(head, 1), zlib.compress(docs, 1)
    return MAGIC + struct.pack("<II", len(head), len(docs)) + head + docs + b"".join(body)


class WaveletShard:
    """Reads one shard file."""

    def __init__(self, data: bytes):
        import zstandard

        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        n_head, n_docs = struct.unpack_from("<II", data, 4)
        head = json.loads(zlib.decompress(data[12 : 12 + n_head]))
        self.n, self.planes = head["n"], head["planes"]
        self._zeros, self._offsets, self._ones = head["zeros"], head["offsets"], head["ones"]
        self.doc_ids, self.lengths = json.loads(zlib.decompress(data[12 + n_head : 12 + n_head + n_docs]))
        self._body, self._unpack = memoryview(data)[12 + n_head + n_docs :], zstandard.ZstdDecompressor().decompress
        self._blocks: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, p: int, b: int) -> np.ndarray:
        """The bits of one block, after which their running count is one cumsum."""
        if (p, b) not in self._blocks:
            if len(self._blocks) >= 64:
                self._blocks.clear()
            raw = self._unpack(self._body[self._offsets[p][b] : self._offsets[p][b + 1]])
            self._blocks[p, b] = np.unpackbits(np.frombuffer(raw, np.uint8))
        return self._blocks[p, b]

    def _rank1(self, p: int, i: int) -> int:
        b, r = divmod(i, BLOCK)
        return self._ones[p][b] + (int(self._block(p, b)[:r].sum()) if r else 0)

    def _select(self, p: int, bit: int, k: int) -> int:
        """The position of the k-th (from 0) bit of a plane."""
        ones = self._ones[p]
        lo, hi = 0, len(ones) - 1
        before = (lambda b: ones[b]) if bit else (lambda b: min(b * BLOCK, self.n) - ones[b])
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if before(mid) <= k else (lo, mid)
        inside = np.flatnonzero(self._block(p, lo) == bit)
        return lo * BLOCK + int(inside[k - before(lo)])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.planes):
            b, r = divmod(i, BLOCK)
            bit, ones = int(self._block(p, b)[r]), self._rank1(p, i)
            i = self._zeros[p] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def count(self, token: int, i: int | None = None) -> int:
        """Occurrences of an id before position i (in all, by default)."""
        return self._walk(token, self.n if i is None else i)[1]

    def _walk(self, token: int, i: int) -> tuple[int, int]:
        start, end = 0, i
        if token >> self.planes:
            return 0, 0
        for p in range(self.planes):
            a, b = self._rank1(p, start), self._rank1(p, end)
            if token >> (self.planes - 1 - p) & 1:
                start, end = self._zeros[p] + a, self._zeros[p] + b
            else:
                start, end = start - a, end - b
        return start, end - start

    def locate(self, token: int, k: int) -> int:
        """The position of the k-th occurrence (from 0); -1 if there are fewer."""
        start, found = self._walk(token, self.n)
        if k >= found or k < 0:
            return -1
        i = start + k
        for p in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - p) & 1
            i = self._select(p, bit, i - self._zeros[p] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All ids in order: the stable partitions undone from the last plane up."""
        dtype = np.uint16 if self.planes <= 16 else np.uint32
        values = np.zeros(self.n, dtype)
        for p in range(self.planes - 1, -1, -1):
            offsets = self._offsets[p]
            raw = b"".join(self._unpack(self._body[a:b]) for a, b in zip(offsets, offsets[1:]))
            mask = np.unpackbits(np.frombuffer(raw, np.uint8))[: self.n].view(bool)
            above, z = np.empty(self.n, dtype), self._zeros[p]
            above[~mask] = values[:z]
            above[mask] = values[z:] | dtype(1 << (self.planes - 1 - p))
            values = above
        return values

    def documents(self) -> Iterator[tuple[object, int, np.ndarray]]:
        """(doc_id, start in the shard, ids) of each document."""
        ids, at = self.tokens(), 0
        for doc_id, n in zip(self.doc_ids, self.lengths):
            yield doc_id, at, ids[at : at + n]
            at += n


# ------------------------------------------------------------------ encoding

_tokenizers: dict[str, tuple] = {}


#: Between an ASCII letter or digit and these marks the tokenizer always ends a token.
_KINDS = classes(b'.,;:!?$%&*#"()-')


class _Chunks(dict):
    """hash of a chunk (bytes without white space) -> its ids as little-endian bytes.

    The tokenizer lower-cases, drops white space and then looks for words, so a text's
    ids are those of its chunks in order, chunks ending at white space and between
    letters and marks. A chunk is encoded when it is first met. Texts with ``<|`` may
    hold the strings of special tokens and are encoded as they are."""

    LIMIT = 900_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.vocab <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(self.vocab, bool)  # ids that end a word
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = piece.endswith("</w>")

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in chunks], add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters alone: one text, cut after each id that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):  # a letter that the tokenizer rewrites to more
            return self._ids(words)
        data, size = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        cuts = [0, *(ends * size).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        special = {i: t for i, t in enumerate(texts) if b"<|" in t}
        words = Words([b"" if i in special else t.lower() for i, t in enumerate(texts)], _KINDS)
        codes, hashes = pd.factorize(words.hashes())
        hashes, new = hashes.tolist(), []
        if len(self) + len(hashes) > self.LIMIT:
            self.clear()
        first = first_places(codes, len(hashes))
        new = [(h, words.word(i)) for h, i in zip(hashes, first.tolist()) if h not in self]
        plain = [x for x in new if x[1].isalpha() or x[1].decode().isalpha()]
        other = [x for x in new if not (x[1].isalpha() or x[1].decode().isalpha())]
        for part, how in ((plain, self._words), (other, self._ids)):
            for at in range(0, len(part), 5000):
                self.update(zip((h for h, _ in part[at : at + 5000]), how([w for _, w in part[at : at + 5000]])))
        found = [self[h] for h in hashes]
        size = self.dtype.itemsize
        flat = np.frombuffer(b"".join(found), self.dtype)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // size
        each = lengths[codes]
        ids = flat[ragged((np.cumsum(lengths) - lengths)[codes], each)].tobytes()
        cuts = (np.concatenate(([0], np.cumsum(each)))[words.first] * size).tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        for i, t in special.items():
            out[i] = self._ids([t])[0]
        return out


def chunks_of(path: str) -> _Chunks:
    if path not in _tokenizers:
        _tokenizers[path] = _Chunks(path)
    return _tokenizers[path]


SHARDS = "first_doc long, part int, seq int, n_docs long, n_tokens long, file binary"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per shard file, ordered by (part, seq); no id is left out.

    The one shuffle deals whole texts by ranges of the id, and rows of one id (or without
    one) by the beginning of their text and their place, so that none is one task's work; a
    range's documents are then encoded and cut into shards in one pass, so a task holds one
    shard at a time."""

    def run(batches):
        from pyspark import TaskContext

        chunks, seq, part = chunks_of(tokenizer), 0, TaskContext.get().partitionId()
        tail = np.array([end_id], chunks.dtype).tobytes()
        doc_ids, lengths, parts, held = [], [], [], 0

        def shard():
            ids = np.frombuffer(b"".join(parts), chunks.dtype)
            data = build_shard(ids, doc_ids, lengths, chunks.vocab)
            return pa.RecordBatch.from_arrays(
                [pa.array([doc_ids[0]], pa.int64()), pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())],
                names=["first_doc", "part", "seq", "n_docs", "n_tokens", "file"],
            )

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for at in range(0, len(ids), 500):
                for doc_id, code in zip(ids[at : at + 500], chunks.encode([t or b"" for t in texts[at : at + 500]])):
                    code += tail
                    doc_ids.append(doc_id)
                    lengths.append(len(code) // chunks.dtype.itemsize)
                    parts.append(code)
                    held += lengths[-1]
                    if held >= shard_tokens:
                        yield shard()
                        seq, held = seq + 1, 0
                        doc_ids, lengths, parts = [], [], []
        if doc_ids:
            yield shard()

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    ranged = rows.repartitionByRange("doc_id", F.substring("text", 1, 64), F.monotonically_increasing_id())
    return ranged.sortWithinPartitions("doc_id", "text").mapInArrow(run, SHARDS)


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, from the shard files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for part, seq, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                doc_ids, starts, lengths, sums = [], [], [], []
                for doc_id, start, ids in WaveletShard(data).documents():
                    doc_ids.append(doc_id)
                    starts.append(start)
                    lengths.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(doc_ids), pa.int32()), pa.array([seq] * len(doc_ids), pa.int32()), *(pa.array(x, pa.int64()) for x in (doc_ids, starts, lengths, sums))],
                    names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("part", "seq", "file").mapInArrow(run, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # one small row per shard of about two million ids; the files themselves do not move
    before = F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    starts = shards.select("part", "seq", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_documents(save(write_shards(docs, tokenizer), "shards"))
