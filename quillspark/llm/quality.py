"""Quality classifier by co-training of a text view and a metadata view.

One pass over all documents turns each into two small feature vectors: what its text
looks like (kinds of characters, repetition, hashed words) and what is known about it
(source, language, both together, declared and real length). Two logistic models start
from the labelled rows, one per view. In every round each view scores all unlabelled
documents, names those that it is surest of and gives them, with its answer, to the
other view, which is fitted again on them and the labelled rows.

How sure is sure is a view's own quantile: the best ``TAKEN`` share of the rows that
labels would call good, and the worst of those that they would call bad, on labelled
rows that no model was fitted on. What a pseudo-label weighs is measured on the same rows:
how much more often the view is right beyond its cut than always saying that class would
be, shrunk towards nothing where few rows tell, and ``LEAST`` at least. So a view that knows
little teaches little, and one that knows much counts like labels. ``taught`` of the model
has the numbers and weights of pseudo-labels by view and round. At the end each view is
calibrated on the held-out rows, a logistic combination of the two calibrated log-odds is
fitted on them, and all documents are scored.

Bounds (parameters): models are fitted on about ``SAMPLE`` labelled rows, of which
three in ten are held out, and about ``POOL`` pseudo-labelled rows per view and round,
both drawn by a hash of the row; equal rows are drawn together and count once. Everything
else covers all rows.

Defined results: null and empty texts have text features 0; null metadata is a value of
its own; rows without an id have no label; several labels of one id count as their
rounded mean; without any labels, or with labels of one kind, every score is the share
of good labels (1 without labels), and nothing is exchanged; without held-out rows of both
kinds pseudo-labels weigh ``LEAST`` beyond the quantiles of the fitted rows and the text view
decides; equal rows get equal scores; extra columns of any name are kept by
:func:`keep_good` and not read else.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, quoted, save, tidy
from .words import Words

SAMPLE = 20_000
POOL = 10_000
ROUNDS = 3
TAKEN = 0.3  # of the rows of a class, the share that a view is surest of
LEAST = 0.02  # least weight of a pseudo-label
DOUBT = 10.0  # rows that the odds of the class count for when a weight is measured
BAG = 32
_CLASSES = [b" \t\r\x0b\x0c", b"\n", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".", b",", b"!?", b"|", b"$%&#*", b"<>{}[]()=/\\_@", b"'\"-;:"]
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i
_CLASS[128:] = len(_CLASSES) + 1
N_CLASS = len(_CLASSES) + 2
N_TEXT = N_CLASS + 7 + BAG
N_SOURCE, N_LANG, N_BOTH, N_LENGTH = 32, 8, 64, 24
N_META = N_SOURCE + N_LANG + N_BOTH + N_LENGTH + 3


def text_features(texts: list[bytes]) -> np.ndarray:
    words = Words(texts)
    hashes = words.hashes()
    out = np.zeros((len(texts), N_TEXT), np.float32)
    for row, text, a, b in zip(out, texts, words.first[:-1].tolist(), words.first[1:].tolist()):
        if not text:
            continue
        row[:N_CLASS] = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=N_CLASS) / len(text)
        n = b - a
        if n:
            h = hashes[a:b]
            s = np.sort(h)
            new = np.flatnonzero(s[1:] != s[:-1])
            runs = np.diff(np.concatenate(([-1], new, [n - 1])))
            lengths = words.ends[a:b] - words.starts[a:b]
            row[N_CLASS : N_CLASS + 7] = (
                np.log1p(n),
                lengths.mean() / 10,
                (lengths == 1).mean(),
                len(runs) / n,
                len(runs) / n * np.log1p(n),  # distinct words, as texts grow
                runs.max() / n,
                (h[1:] == h[:-1]).mean() if n > 1 else 0.0,
            )
            row[N_CLASS + 7 :] = np.bincount((h & np.uint64(BAG - 1)).astype(np.int64), minlength=BAG) / n
    return out


def meta_features(source: list, lang: list, n_chars: list, texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), N_META), np.float32)
    slot = lambda v, n: 0 if v is None else 1 + zlib.crc32(str(v).encode()) % (n - 1)
    for row, s, lang_of, n, t in zip(out, source, lang, n_chars, texts):
        row[slot(s, N_SOURCE)] = 1
        row[N_SOURCE + slot(lang_of, N_LANG)] = 1
        row[N_SOURCE + N_LANG + slot(None if s is None or lang_of is None else f"{s} {lang_of}", N_BOTH)] = 1
        length = max(n or 0, 0)
        row[N_SOURCE + N_LANG + N_BOTH + min(length.bit_length(), N_LENGTH - 1)] = 1
        row[-3:] = np.log1p(length), n is None, np.log1p(len(t))
    return out


# ------------------------------------------------------------------ models


class Logistic:
    """Ridge-penalised logistic regression by Newton steps on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0):
        x = x.astype(np.float64)
        weight = np.ones(len(x)) if weight is None else weight
        self.mean = np.average(x, axis=0, weights=weight)
        self.scale = np.maximum(np.sqrt(np.average((x - self.mean) ** 2, axis=0, weights=weight)), 1e-6)
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(25):
            p = _sigmoid(z @ self.w)
            slope = z.T @ (weight * (p - y)) + penalty * self.w
            step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), slope)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break

    def odds(self, x: np.ndarray) -> np.ndarray:
        # far outside what was seen, features say no more than at its border
        z = np.clip((x.astype(np.float64) - self.mean) / self.scale, -12, 12)
        return z @ self.w[:-1] + self.w[-1]


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


class CoModel:
    """Both views' models and their calibrated combination."""

    def __init__(self, text: Logistic, meta: Logistic):
        self.views, self.scales, self.combined = (text, meta), None, None
        self.taught: list[tuple[dict, dict]] = []  # what the text's and the metadata's view taught, by round

    def fit_calibration(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray) -> None:
        odds = [m.odds(x)[:, None] for m, x in zip(self.views, (text, meta))]
        self.scales = [Logistic(o, y) for o in odds]
        both = np.column_stack([s.odds(o) for s, o in zip(self.scales, odds)])
        self.combined = Logistic(both, y)
        # a calibrated view that would count against itself only fits noise: it is left out
        for v in np.flatnonzero(self.combined.w[:-1] < 0).tolist():
            both[:, v] = 0
        if not both.any(axis=0).all():
            self.combined = Logistic(both, y)

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities by the text, by the metadata, and by both."""
        odds = [m.odds(x) for m, x in zip(self.views, (text, meta))]
        if self.scales is None:
            return _sigmoid(odds[0]), _sigmoid(odds[1]), _sigmoid(odds[0])
        odds = [s.odds(o[:, None]) for s, o in zip(self.scales, odds)]
        return _sigmoid(odds[0]), _sigmoid(odds[1]), _sigmoid(self.combined.odds(np.column_stack(odds)))


def _unpack(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, n)


def featured(docs: DataFrame, labels: DataFrame | None, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and metadata features as packed floats, label (null if unknown)."""
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"))

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            meta = meta_features(*(batch.column(i).to_pylist() for i in (2, 3, 4)), texts)
            for at in range(0, len(texts), 200):
                part = text_features(texts[at : at + 200])
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [ids[at : at + n], pa.array([r.tobytes() for r in part], pa.binary()), pa.array([r.tobytes() for r in meta[at : at + n]], pa.binary())],
                    names=["doc_id", "tf", "mf"],
                )

    found = rows.mapInArrow(tidy(run), "doc_id long, tf binary, mf binary")
    if labels is None:
        return found.withColumn("label", F.lit(None).cast("double"))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.round(F.avg("quality")).alias("label"))
    # rows without an id meet no label; a key of their own each keeps them out of one task
    key, has = F.coalesce("doc_id", F.xxhash64("tf", F.monotonically_increasing_id())), F.col("doc_id").isNotNull()
    known = known.select(F.col("doc_id").alias("key"), F.lit(True).alias("has"), "label")
    return found.withColumns({"key": key, "has": has}).join(known, ["key", "has"], "left").drop("key", "has")


def _share(n: int, most: int) -> int:
    """What a 30-bit hash must stay under so that about ``most`` of n rows are drawn."""
    return int(min(1.0, most / max(n, 1)) * (1 << 30))


def _draw(salt: int):
    return F.pmod(F.xxhash64("doc_id", "tf", "mf", F.lit(salt)), F.lit(1 << 30))


def _arrays(rows: DataFrame, *more: str) -> tuple[np.ndarray, ...]:
    """The distinct rows as arrays, in an order of their own."""
    got = rows.select("doc_id", "tf", "mf", *more).distinct().orderBy("doc_id", "tf", "mf").toArrow()
    table = got.combine_chunks()
    text = np.frombuffer(b"".join(table.column("tf").to_pylist()), np.float32).reshape(-1, N_TEXT)
    meta = np.frombuffer(b"".join(table.column("mf").to_pylist()), np.float32).reshape(-1, N_META)
    return (text, meta, *(np.array(table.column(c).to_pylist(), float) for c in more))


def surest(odds: np.ndarray, y: np.ndarray, trusted: bool) -> dict[str, float]:
    """A view's cuts and the weights of its answers beyond them, from its odds on rows
    with known labels; rows that it was fitted on are not ``trusted`` to weigh."""
    good = float(y.mean())
    high, low = np.quantile(odds, 1 - TAKEN * good), np.quantile(odds, TAKEN * (1 - good))

    def weight(right: np.ndarray, base: float) -> float:
        precision = (right.sum() + DOUBT * base) / (len(right) + DOUBT)
        return float(max(LEAST, (precision - base) / (1 - base))) if trusted and base < 1 else LEAST

    return {"high": float(high), "low": float(low), "good": weight(y[odds >= high] == 1, good), "bad": weight(y[odds <= low] == 0, 1 - good)}


def co_train(features: DataFrame) -> CoModel | float:
    """The fitted model, or the constant score that stands in for it."""
    labelled = features.where("label is not null")
    sample = labelled.where(_draw(1) < _share(labelled.count(), SAMPLE)).withColumn("held", (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(10)) < 3).cast("double"))
    text, meta, y, held = _arrays(sample, "label", "held")
    own = held == 0
    if len(set(y[own])) < 2:
        return float(y.mean()) if len(y) else 1.0
    model = CoModel(Logistic(text[own], y[own]), Logistic(meta[own], y[own]))
    told = len(set(y[~own])) == 2
    seen = ~own if told else own
    unlabelled = features.where("label is null")
    for number in range(ROUNDS):
        sure = [surest(m.odds(x[seen]), y[seen], told) for m, x in zip(model.views, (text, meta))]
        marked = named(unlabelled, model, sure)
        counts = marked.groupBy("view", "label").count().collect()  # four rows at most
        share = [_share(sum(r["count"] for r in counts if r.view == v), POOL) for v in (0, 1)]
        drawn = marked.where(_draw(10 + number) < F.when(F.col("view") == 0, share[0]).otherwise(share[1]))
        tf, mf, view, label = _arrays(drawn, "view", "label")
        taught, views = [], []
        for v, (x, found) in enumerate(((text, tf), (meta, mf))):
            teacher = 1 - v
            given = view == teacher
            weight = np.where(label[given] == 1, sure[teacher]["good"], sure[teacher]["bad"])
            views.append(Logistic(np.concatenate([x[own], found[given]]), np.concatenate([y[own], label[given]]), np.concatenate([np.ones(own.sum()), weight])))
            by = {r.label: r["count"] for r in counts if r.view == v}
            taught.append({"good": by.get(1, 0), "bad": by.get(0, 0), "used": int((view == v).sum()), "weight_good": sure[v]["good"], "weight_bad": sure[v]["bad"]})
        taught = [*model.taught, tuple(taught)]
        model = CoModel(*views)
        model.taught = taught
    if told:
        model.fit_calibration(text[~own], meta[~own], y[~own])
    return model


def named(features: DataFrame, model: CoModel, sure: list[dict[str, float]]) -> DataFrame:
    """The rows of features beyond a view's cuts: doc_id, tf, mf, view (0 the text's, 1
    the metadata's) and label (0 or 1) that it gives."""

    def run(batches):
        for batch in batches:
            vectors = _unpack(batch.column("tf"), N_TEXT), _unpack(batch.column("mf"), N_META)
            for v, (m, x, cut) in enumerate(zip(model.views, vectors, sure)):
                odds = m.odds(x)
                for label, at in ((1, odds >= cut["high"]), (0, (odds <= cut["low"]) & (odds < cut["high"]))):
                    part = batch.filter(pa.array(at))
                    n = part.num_rows
                    if n:
                        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "tf", "mf")), pa.array([v] * n, pa.int32()), pa.array([label] * n, pa.int32())], names=["doc_id", "tf", "mf", "view", "label"])

    return features.select("doc_id", "tf", "mf").mapInArrow(tidy(run), "doc_id long, tf binary, mf binary, view int, label int")


SCORES = "text_score double, meta_score double, score double"


def score(features: DataFrame, model: CoModel | float) -> DataFrame:
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if isinstance(model, float):
                found = [np.full(n, model)] * 3
            else:
                found = model.scores(_unpack(batch.column("tf"), N_TEXT), _unpack(batch.column("mf"), N_META))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found)], names=["doc_id", "text_score", "meta_score", "score"])

    return features.select("doc_id", "tf", "mf").mapInArrow(tidy(run), f"doc_id long, {SCORES}")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_score, meta_score, score: probabilities of good quality; and what the
    views taught each other over all rounds, the same in every row: text_taught,
    meta_taught (numbers of pseudo-labels)."""
    features = save(featured(docs, labels, id_col, text_col), "features")
    model = co_train(features)
    taught = [0, 0] if isinstance(model, float) else [sum(r[v]["good"] + r[v]["bad"] for r in model.taught) for v in (0, 1)]
    return score(features, model).withColumns({"text_taught": F.lit(taught[0]).cast("long"), "meta_taught": F.lit(taught[1]).cast("long")})


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs (all columns) whose text and metadata score at least the
    threshold. Rows are scored where they are: equal rows go or stay together."""
    features = save(featured(docs, labels, "doc_id", "text"), "features")
    model = co_train(features)
    drop(features)
    if isinstance(model, float):
        return docs if model >= threshold else docs.limit(0)
    schema = docs.schema
    places = [docs.columns.index(c) for c in ("text", "source", "lang", "n_chars")]

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(places[0]).cast(pa.binary()).to_pylist()]
            meta = meta_features(*(batch.column(i).to_pylist() for i in places[1:]), texts)
            good = [model.scores(text_features(texts[at : at + 200]), meta[at : at + 200])[2] >= threshold for at in range(0, len(texts), 200)]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.empty(0, bool)))

    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(tidy(run), schema)
