"""Approximate nearest neighbours: inverted file, product-quantised residuals, rerank.

Coarse centroids and the codebooks of the residuals are fitted on a bounded sample; the
number of centroids grows with the vectors (twice the root of their number, up to an
eighth of the sample). Every vector is indexed: its list is that of its nearest centroid,
its code the nearest codeword in each slice of its residual. How many lists a query
probes is measured: the true neighbours of ``TRIALS`` queries are found in one pass over all
vectors, and the nearest lists that hold ``AIM`` of them are as many as are probed. Where
vectors have structure these are few and their share falls as lists become more; where
they have none no inverted file can leave much out.

A query fills one table of its products with all codewords; with what a list adds to
them, a code's table entries sum to the query's distance from the coded vector
(asymmetric distance). The ``keep`` best over all lists are measured again on the
original vectors, in double precision.

Lists are dealt to shelves of about ``BLOCK`` vectors, lists of near centroids together, large
lists in several parts, and the visitors of a shelf to blocks of about ``VISITORS`` queries. A
task scans one shelf for one block, whatever the table's size. Of a shelf only what is nearer
than a bound of the query's own returns: the distance from its so-manieth nearest
sampled vector, chosen so that somewhat more than ``keep`` of all vectors should be nearer.
The best of each shelf are merged by shelves of a row first, then over these.

Defined results: vectors that are null, zero, of another length than most, or that hold
a null, NaN or infinite component take no part, as queries or candidates; equal
vectors rank by vec_id; where the probed lists hold fewer than ``k`` vectors a query gets
those; rows with a null id take no part; an id on several rows is as many queries and
candidates, of which a query leaves out only its own row; extra columns, whatever their
names, are not read. ``probed`` (lists of each query), ``lists`` and ``recall`` (the share of
the trial queries' true neighbours that the answer has) are the same in every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, quoted, save, tidy
from .words import ragged

SAMPLE = 65_536  # centroids and codebooks are fitted on about so many vectors
TRIALS = 128  # queries whose true neighbours are found, to tell how many lists to probe
AIM = 0.985  # share of these neighbours that the probed lists hold
BLOCK = 16_384
VISITORS = 4_096
SLICES = 16
TASTED = 16_384  # sampled vectors that a query is held against for its bound
CODEWORDS = 256


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array<double>) of the vectors that take part."""
    v = F.col(quoted(vec_col)).cast("array<double>")
    rows = df.select(F.col(quoted(id_col)).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~F.coalesce(bad, F.lit(False)) & F.exists("v", lambda x: x != 0))


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[rng.choice(len(distinct), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        empty = np.flatnonzero(counts == 0)
        centres[empty] = distinct[rng.choice(len(distinct), len(empty))]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


def in_order(centres: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The centroids so that near ones follow each other: sorted by halving along the widest
    direction."""
    out, open_ = [], [np.arange(len(centres))]
    while open_:
        part = open_.pop()
        if len(part) <= 2:
            out.append(part)
            continue
        x = centres[part] - centres[part].mean(axis=0)
        axis = rng.standard_normal(x.shape[1])
        for _ in range(5):  # the direction of the most variance, roughly
            axis = x.T @ (x @ axis)
            axis /= max(np.linalg.norm(axis), 1e-300)
        order = part[np.argsort(x @ axis, kind="stable")]
        open_ += [order[len(order) // 2 :], order[: len(order) // 2]]
    return centres[np.concatenate(out)]


class Quantiser:
    """Coarse centroids and residual codebooks; all of a bounded size."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.centres = in_order(k_means(sample, max(1, min(lists, len(sample) // 8)), 8, rng), rng)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = np.linspace(0, self.dim, min(SLICES, self.dim) + 1).astype(int)
        self.books = [k_means(rest[:, a:b], CODEWORDS, 6, rng) for a, b in zip(self.cuts, self.cuts[1:])]
        lists, codes = self.encode(sample)
        near = rng.choice(len(sample), min(len(sample), TASTED), replace=False)
        self.tasted = lists[near], codes[near].astype(np.int64) + np.arange(codes.shape[1]) * CODEWORDS
        self.tasted_added = self.added(*self.tasted)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = nearest(x, self.centres)
        rest = x - self.centres[lists]
        codes = [nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]
        return lists, np.stack(codes, axis=1).astype(np.uint8)

    def probed(self, x: np.ndarray, n: int | None = None) -> np.ndarray:
        """The n nearest lists of each row, nearest first."""
        distance = (self.centres**2).sum(axis=1) - 2 * (x @ self.centres.T)
        return np.argsort(distance, axis=1, kind="stable")[:, :n]

    def bound(self, query: np.ndarray, products: np.ndarray, total: int, keep: int) -> float:
        """A coded distance within which about ``keep`` of all vectors, and some more, lie."""
        lists, places = self.tasted
        due = keep * len(lists) / max(total, 1)
        rank = int(due + 4 * due**0.5 + 16)
        if rank >= len(lists):
            return np.inf
        distance = ((self.centres - query) ** 2).sum(axis=1)[lists] + self.tasted_added + products[places].sum(axis=1)
        return float(np.partition(distance, rank)[rank])

    def products(self, query: np.ndarray) -> np.ndarray:
        """-2 query . codeword for every slice and codeword."""
        out = np.zeros((len(self.books), CODEWORDS))
        for i, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            out[i, : len(book)] = -2 * (book @ query[a:b])
        return out.ravel()

    def added(self, lists: np.ndarray, places: np.ndarray) -> np.ndarray:
        """What a coded vector adds to the products whatever the query: the sum over its
        slices of |codeword|^2 + 2 centroid . codeword."""
        out = np.zeros(len(lists))
        for list_id in np.unique(lists):
            table = np.zeros((len(self.books), CODEWORDS))
            for i, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
                table[i, : len(book)] = (book**2).sum(axis=1) + 2 * (book @ self.centres[list_id, a:b])
            own = lists == list_id
            out[own] = table.ravel()[places[own]].sum(axis=1)
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _true_neighbours(good: DataFrame, trials: np.ndarray, own: np.ndarray, k: int, quantiser) -> list:
    """(query number, row, list) of the k nearest of each trial query, by one pass over all
    vectors: each task keeps k a query, and these meet by query."""

    def run(batches):
        best = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))] * len(trials)
        half = (trials**2).sum(axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, ids, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), trials.shape[1])
            lists = nearest(x, quantiser.value.centres)
            distance = half[:, None] - 2 * trials @ x.T + (x * x).sum(axis=1)
            distance[rows[None, :] == own[:, None]] = np.inf
            for q in range(len(trials)):
                at = np.flatnonzero(distance[q] < np.inf)
                at = at[np.argpartition(distance[q, at], k - 1)[:k]] if len(at) > k else at
                d, i, r, w = (np.concatenate(pair) for pair in zip(best[q], (distance[q, at], ids[at], rows[at], lists[at])))
                first = np.lexsort((r, i, d))[:k]
                best[q] = d[first], i[first], r[first], w[first]
        for q, (d, i, r, w) in enumerate(best):
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(d), pa.int32()), pa.array(d), pa.array(i), pa.array(r), pa.array(w, pa.int32())], names=["q", "d", "id", "row", "list"])

    found = good.mapInArrow(tidy(run), "q int, d double, id long, row long, list int")
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "id", "row"))).where(F.col("r") <= k)
    return first.select("q", "row", "list").collect()  # TRIALS x k rows


def _lists_to_probe(quantiser: Quantiser, trials: np.ndarray, truth: list) -> int:
    """So many nearest lists hold ``AIM`` of the trial queries' true neighbours."""
    ranks = np.argsort(quantiser.probed(trials), axis=1)
    depth = sorted(int(ranks[r.q, r.list]) + 1 for r in truth)
    return depth[min(len(depth) - 1, int(np.ceil(AIM * len(depth))))] if depth else 1


def _shelves(sizes: dict[int, int]) -> list[tuple[int, int, int]]:
    """(list, its first shelf, its parts): lists in the order of their centroids, a new shelf
    where the next does not fit any more; a list over ``BLOCK`` has shelves of its own."""
    out, shelf, held = [], 0, 0
    for number in sorted(sizes):
        parts = -(-sizes[number] // BLOCK)
        if held and held + sizes[number] > BLOCK:
            shelf, held = shelf + 1, 0
        out.append((number, shelf, parts))
        shelf, held = (shelf + parts, 0) if parts > 1 else (shelf, held + sizes[number])
    return out


def neighbours(vectors: DataFrame, id_col: str, vec_col: str, is_query, k: int = 10, share: float | None = None, keep: int = 200) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found; probed, lists, recall.
    is_query: a condition on the column ``id``. share: of the lists to probe, if it is not to
    be measured."""
    spark = vectors.sparkSession
    good = usable(vectors, id_col, vec_col)
    lengths = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, probed int, lists int, recall double")
    dim = lengths[0].d
    good = save(good.where(F.size("v") == dim).select(F.monotonically_increasing_id().alias("row"), "id", "v"), "vectors")
    total = good.count()

    def drawn(df: DataFrame, most: int, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """row and vector of about ``most`` of n rows, by a hash, so reruns draw the same;
        repeated rows come once, so they cannot fill the driver."""
        some = df.where(F.pmod(F.xxhash64("id", "v", F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, most / max(n, 1)) * (1 << 30)))
        t = some.groupBy("id", "v").agg(F.min("row").alias("row")).orderBy("id", "row").toArrow().combine_chunks()
        return t.column("row").to_numpy(), _matrix(t.column("v").combine_chunks(), dim) if len(t) else np.empty((0, dim))

    _, sample = drawn(good, SAMPLE, total, 0)
    sample = sample if len(sample) else drawn(good.where(good["id"] == good.agg(F.min("id")).first()[0]), 1 << 30, 1, 0)[1]
    quantiser = spark.sparkContext.broadcast(Quantiser(sample, int(2 * total**0.5) + 1))
    pq, n_lists = quantiser.value, len(quantiser.value.centres)
    asking = good.where(is_query)
    trial_rows, trials = drawn(asking, TRIALS, asking.count(), 1)
    truth = _true_neighbours(good, trials, trial_rows, k, quantiser) if len(trials) else []
    probes = _lists_to_probe(pq, trials, truth) if share is None else max(1, int(np.ceil(share * n_lists)))

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                lists, codes = quantiser.value.encode(_matrix(batch.column(2), dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["row", "id", "list", "code"])

    codes = save(good.mapInArrow(tidy(index), "row long, id long, list int, code binary"), "codes")
    places = _shelves({r["list"]: r["count"] for r in codes.groupBy("list").count().collect()})  # one row per centroid
    first, parts = np.zeros(n_lists, np.int64), np.zeros(n_lists, np.int64)
    for number, shelf, n in places:
        first[number], parts[number] = shelf, n

    def ask(batches):
        """Each query with the bound that it is given and the shelves that it visits."""
        for batch in batches:
            rows = []
            for at, (row, q) in enumerate(zip(batch.column(0).to_pylist(), _matrix(batch.column(2), dim) if batch.num_rows else [])):
                near = quantiser.value.probed(q[None], probes)[0]
                shelves = np.unique(ragged(first[near], parts[near]))
                rows.append((at, quantiser.value.bound(q, quantiser.value.products(q), total, keep), shelves))
            if rows:
                again = pa.array(np.repeat([r[0] for r in rows], [len(r[2]) for r in rows]))
                bounds = np.repeat([r[1] for r in rows], [len(r[2]) for r in rows])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(again), pa.array(bounds), pa.array(np.concatenate([r[2] for r in rows]).astype(np.int32))], names=["query", "bound", "shelf"])

    visits = save(asking.mapInArrow(tidy(ask), "query long, bound double, shelf int"), "visits")
    # one row per shelf
    blocks = F.broadcast(visits.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(VISITORS))).cast("int").alias("blocks")))
    queries = asking.select(F.col("row").alias("query"), F.col("v").alias("q"))
    visitors = visits.join(blocks, "shelf").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).drop("blocks").join(queries, "query")
    where = F.broadcast(spark.createDataFrame(places, "list int, first int, parts int"))  # one row per centroid
    dealt = codes.join(where, "list").withColumn("shelf", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int")).drop("first", "parts")
    shelves = dealt.join(blocks, "shelf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def scan(key, codes_of, queries_of):
        import pandas as pd

        out = []
        if len(codes_of) and len(queries_of):
            codes_of = codes_of.sort_values(["id", "row"], kind="stable")  # ties in distance go to smaller ids
            rows, ids, lists = (codes_of[c].to_numpy() for c in ("row", "id", "list"))
            code = np.frombuffer(b"".join(codes_of["code"]), np.uint8).reshape(len(ids), -1).astype(np.int64)
            code += np.arange(code.shape[1]) * CODEWORDS
            pq = quantiser.value
            added = pq.added(lists, code)
            for query, q, bound in zip(queries_of["query"], queries_of["q"], queries_of["bound"]):
                q = np.asarray(q)
                base = np.full(len(pq.centres), np.inf)
                near = pq.probed(q[None], probes)[0]
                base[near] = ((pq.centres[near] - q) ** 2).sum(axis=1)
                start = base[lists]
                at = np.flatnonzero((start < np.inf) & (rows != query))
                distance = start[at] + added[at] + pq.products(q)[code[at]].sum(axis=1)
                within = distance <= bound
                at, distance = at[within], distance[within]
                if len(at) > keep:
                    best = distance <= np.partition(distance, keep - 1)[keep - 1]
                    at, distance = at[best], distance[best]
                best = np.argsort(distance, kind="stable")[:keep]
                if len(best):
                    out.append((query, key[0], rows[at[best]], ids[at[best]], distance[best]))
        return pd.DataFrame(out, columns=["query", "shelf", "rows", "ids", "near"])

    met = shelves.groupBy("shelf", "block").cogroup(visitors.groupBy("shelf", "block")).applyInPandas(scan, "query long, shelf int, rows array<long>, ids array<long>, near array<double>")
    flat = met.select("query", "shelf", F.explode(F.arrays_zip("near", "ids", "rows")).alias("x")).select("query", "shelf", "x.*")
    # the best of 64 shelves each, then of all
    for group in (["query", F.floor(F.col("shelf") / 64)], ["query"]):
        flat = flat.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("near", "ids", "rows"))).where(F.col("r") <= keep).drop("r")
    originals = good.select(F.col("row").alias("rows"), F.col("id").alias("vec_id"), "v")
    squares = F.aggregate(F.zip_with("q", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    askers = asking.select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("q"))
    scored = flat.select("query", "rows").join(originals, "rows").join(askers, "query").select("query", "query_id", "rows", "vec_id", F.sqrt(squares).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id", "rows")).cast("int"))
    answer = save(ranked.where(F.col("rank") <= k), "answer")
    true = {(int(trial_rows[r.q]), r.row) for r in truth}
    got = {tuple(r) for r in answer.where(F.col("query").isin([int(i) for i in trial_rows])).select("query", "rows").collect()}  # TRIALS x k rows
    drop(good, codes, visits)
    figures = {"probed": F.lit(probes).cast("int"), "lists": F.lit(n_lists).cast("int"), "recall": F.lit(len(true & got) / len(true) if true else 1.0)}
    return answer.select("query_id", "rank", "vec_id", "score").withColumns(figures)
