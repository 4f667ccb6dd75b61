"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A text is marked (a leading ``\\u2581``, and one for each space) and cut into marked words.
The distinct words of a batch are sorted, which is a depth-first walk of their trie, and
the forward pass over a word starts at the end of the prefix that it shares with the
word before: its states are reused, none is computed twice along a path.

The vocabularies here are merge models: the library joins the best-scored neighbours
until none can be joined, which is not the best sum of scores. So the lattice's states
carry what such a model needs. A split of a word is the model's if, and only if, each
two neighbouring pieces, joined by the model alone, come out as these two pieces. Hence
the model's split of a prefix ends in exactly one piece, the one that fits the last piece
of the prefix before it; that piece is the forward state, and following the states
back gives the split. Whether two pieces fit is worked out once and kept. Unigram
models take the same walk with the best sum of scores as the state.

Characters outside the vocabulary become byte pieces (or the unknown piece if the model
has none). Decoding joins the pieces' strings and bytes, and drops the leading mark.

Defined results: null and empty texts have no ids and decode to the empty text; a text's
own ``\\u2581`` decodes to a space, as in the library; equal texts give equal ids; other
columns are not read. Any batch's words live in one task only, so memory is bounded by
the batch and by fixed limits of the word and pair tables.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, tidy
from .words import first_places, hash_spans, ragged

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the model format


def _bpe(symbols: list[str], score: dict[str, float], least: int = 1) -> list[str]:
    """Joins of the best-scored neighbours, leftmost first, until none is a piece or
    ``least`` symbols are left."""
    symbols = list(symbols)
    while len(symbols) > least:
        best, where = None, -1
        for i in range(len(symbols) - 1):
            s = score.get(symbols[i] + symbols[i + 1])
            if s is not None and (best is None or s > best):
                best, where = s, i
        if best is None:
            break
        symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]
    return symbols


class Pieces:
    """One model, ready to encode and decode."""

    WORDS, PAIRS = 300_000, 200_000

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models that keep texts as they are can be read")
        self.merges = model.trainer_spec.model_type == 2
        self.ids, self.score, self.strings, self.byte_ids, self.unknown = {}, {}, [], {}, 0
        for i, p in enumerate(model.pieces):
            self.strings.append(p.piece.replace(MARK, " ").encode() if p.type in (NORMAL, USER) else b"")
            if p.type == NORMAL:
                self.ids[p.piece], self.score[p.piece] = i, p.score
            elif p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.strings[-1] = bytes((int(p.piece[1:-1], 16),))
            elif p.type == UNKNOWN:
                self.unknown, self.strings[-1] = i, " ⁇ ".encode()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes over a word's start")
        self.longest = max(map(len, self.ids))
        self.least = min(self.score.values(), default=0.0) - 10.0
        self.words: dict[int, bytes] = {}  # hash of a word -> its packed ids
        #: whether a word ends between two bytes: characters stay whole, and without
        #: byte pieces runs of unknown characters do too
        together = np.zeros((256, 256), bool)
        together[:, 128:192] = True
        for p in self.ids:
            raw = p.replace(MARK, " ").encode()
            together[list(raw[:-1]), list(raw[1:])] = True
        if not self.byte_ids:
            together[:, np.arange(256) != 32] = True
        self.ends_word = ~together.ravel()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.trees: dict[str, tuple[str, str] | None] = {}
        #: what pieces end with: whether it is a piece
        self.tails = {p[i:]: False for p in self.ids for i in range(len(p))} | dict.fromkeys(self.ids, True)

    def _tree(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the model joins last to make a piece; a single character
        is its own part; None if the model never makes the piece."""
        if piece not in self.trees:
            parts = [piece, piece] if len(piece) == 1 else _bpe(list(piece), self.score, 2)
            whole = len(parts) == 2 and (len(piece) == 1 or _bpe(parts, self.score) == [piece])
            self.trees[piece] = tuple(parts) if whole else None
        return self.trees[piece]

    def fits(self, a: str, b: str) -> bool:
        """Whether the model, given both pieces' characters alone, ends in a and b (in b
        if a is empty).

        The joins inside a and b are undone, last first; at each moment the neighbours
        at the border are the right edge of a and the left edge of b. If these may be
        joined before the join that was undone last, the model would have done so."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= self.PAIRS:
                self.pairs.clear()
            if len(b) > 1 and not self._tree(b):
                known = False
            elif not a:
                known = True
            elif not a.strip(MARK) or not b.strip(MARK):  # runs of marks have equal scores
                known = _bpe(list(a + b), self.score) == [a, b]
            else:
                known = self._unjoined(a, b)
            self.pairs[a, b] = known
        return known

    def _unjoined(self, a: str, b: str) -> bool:
        score, limit = self.score, math.inf  # of the time of joins: minus their score
        when = lambda x: -score[x] if len(x) > 1 else -math.inf
        while True:
            joined = score.get(a + b)
            if joined is not None and -joined < limit:
                return False
            if len(a) == 1 and len(b) == 1:
                return True
            ta, tb = when(a), when(b)
            if ta > tb:
                limit, a = ta, self._tree(a)[1]
            else:  # of equal joins the left one is first, but one over the border is before b
                limit, b = math.nextafter(tb, math.inf), self._tree(b)[0]

    def _last_merged(self, word: str, i: int, last: list[str]) -> str:
        """The last piece of the model's split of word[:i]: pieces that end here are met
        from short to long, as far as any piece ends like this."""
        tails, pairs = self.tails, self.pairs
        for j in range(i - 2, -1, -1):
            piece = word[j:i]
            whole = tails.get(piece)
            if whole is None:
                break
            if whole:
                fit = pairs.get((last[j], piece))
                if fit or fit is None and self.fits(last[j], piece):
                    return piece
        return word[i - 1]

    def _last_best(self, word: str, i: int, best: list[float]) -> tuple[str, float]:
        """The last piece of the best-scored split of word[:i], and its sum."""
        out, top = word[i - 1], best[i - 1] + self.score.get(word[i - 1], self.least)
        for j in range(max(0, i - self.longest), i - 1):
            s = self.score.get(word[j:i])
            if s is not None and best[j] + s > top:
                out, top = word[j:i], best[j] + s
        return out, top

    def split_words(self, words: list[str]) -> list[list[str]]:
        """The split of each of some sorted distinct words."""
        last, best, before, out = [""], [0.0], "", []
        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                if self.merges:
                    last.append(self._last_merged(word, i, last))
                else:
                    piece, top = self._last_best(word, i, best)
                    last.append(piece)
                    best.append(top)
            before, i, back = word, len(word), []
            while i:
                back.append(last[i])
                i -= len(last[i])
            out.append(back[::-1])
        return out

    def _packed(self, pieces: list[str]) -> bytes:
        ids = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                ids.append(i)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in p.encode())
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)  # a run of unknown characters is one piece
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        marked = [b" " + t.replace(MARK.encode(), b" ") if t else b"" for t in texts]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        data = b"".join(marked) + b" " * 8
        raw = np.frombuffer(data, np.uint8)[: sizes.sum()]
        begin = np.ones(len(raw), bool)
        begin[1:] = self.ends_word[raw[:-1].astype(np.uint16) * np.uint16(256) + raw[1:]]
        where = np.concatenate(([0], np.cumsum(sizes)))
        begin[where[:-1][sizes > 0]] = True
        starts = np.flatnonzero(begin)
        lengths = np.diff(np.concatenate((starts, [len(raw)])))
        codes, hashes = pd.factorize(hash_spans(data, starts, lengths))
        hashes, words = hashes.tolist(), self.words
        if len(words) + len(hashes) > self.WORDS:
            words.clear()
        at = first_places(codes, len(hashes))
        new = [(data[a : a + n].decode().replace(" ", MARK), h) for h, a, n in zip(hashes, starts[at].tolist(), lengths[at].tolist()) if h not in words]
        new.sort()
        for (_, h), pieces in zip(new, self.split_words([w for w, _ in new])):
            words[h] = self._packed(pieces)
        found = [words[h] for h in hashes]
        flat = np.frombuffer(b"".join(found), "<u4")
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        each = counts[codes]
        ids = flat[ragged((np.cumsum(counts) - counts)[codes], each)].tobytes()
        cuts = (np.concatenate(([0], np.cumsum(each)))[np.searchsorted(starts, where)] * 4).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).removeprefix(b" ")


_models: dict[str, Pieces] = {}


def model_of(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


OUT = "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean"


def _blocks(texts: list[bytes], most: int = 1_000_000):
    """Runs of texts of about a million bytes in all: (start, end)."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of each text."""

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in _blocks(texts):
                ids = [np.frombuffer(x, "<i4") for x in model_of(model).encode(texts[a:b])]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of each row of ids."""

    def run(batches):
        for batch in batches:
            texts = [model_of(model).decode(np.array(x or [], "<u4").tobytes()).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


def round_trips(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, decode its ids, and digest both in the same pass: number and
    crc32 of the ids, crc32 of the decoded text, and whether it is the text again."""
    names = [x.split()[0] for x in OUT.split(", ")]

    def run(batches):
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in _blocks(texts):
                p, rows = model_of(model), []
                for doc_id, text, ids in zip(doc_ids[a:b], texts[a:b], p.encode(texts[a:b])):
                    decoded = p.decode(ids)
                    rows.append((doc_id, len(ids) // 4, zlib.crc32(ids), zlib.crc32(decoded), decoded == text.replace(MARK.encode(), b" ")))
                kinds = [*[pa.int64()] * 4, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")).mapInArrow(tidy(run), OUT)


def encode_and_check(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids (array<int>) and round_trip: whether they decode to the text."""

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in _blocks(texts):
                p = model_of(model)
                packed = p.encode(texts[a:b])
                same = [p.decode(x) == t.replace(MARK.encode(), b" ") for x, t in zip(packed, texts[a:b])]
                sizes = np.array([len(x) // 4 for x in packed], np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sizes), ids, pa.array(same)], names=["doc_id", "n_pieces", "ids", "round_trip"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")).mapInArrow(tidy(run), "doc_id long, n_pieces long, ids array<int>, round_trip boolean")
