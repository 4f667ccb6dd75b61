"""N-gram Jaccard join through a token-group matrix.

A document's set holds its distinct ``width``-word shingles (with fewer words the whole
sequence; without words nothing), as 64-bit hashes. Two documents link when
100 * intersection >= percent * union. The join is exact on these hashes:

1. Documents with equal sets form a class, whose smallest doc_id stands for it. The
   rest works on classes, so copies cost one partial aggregate.
2. A set of size x is cut by hash range into slightly more parts than linked sets may
   differ in tokens. Linked sets agree on a whole part, so only classes that share a
   part (a matrix row that marks two columns) go on. Parts hold several tokens, so a
   passage that many documents share does not make them meet.
   Linked sets agree on many parts (on all but so many), and a class that shares fewer
   with all others together is left out.
3. Classes are partitioned into groups of similar ones: by the most shared part that
   each has, then drawn to the heaviest group that they would visit. Large groups are
   split to about ``GROUP_TOKENS`` tokens.
4. A query's overlap with the parts of a heavier group bounds its overlap with every
   member's; where the bound allows a link, the document visits the group, which holds
   its token union. The overlap with that bounds a link again; only where it allows one
   the group is opened and all its members are counted through the group's postings.
   The visitors of a group are dealt to copies of it, each of about ``VISIT_TOKENS`` tokens
   of visitors, so no task holds more than one group and such a share of its visitors.
5. Of the links found at a copy of a group only a spanning forest leaves it; components
   come from star contractions over these. Links are counted where they are found: a row
   per member and a row per visitor, whatever the number of links.

What grows with the square of a neighbourhood of unequal near copies is the number of
comparisons, as every link is counted, and, by one in ``GROUP_TOKENS`` / set size, the number of
visits; rows that leave the groups grow with the visits only.

Defined results: null and empty texts have size 0 and link with nothing; a row without
doc_id has no links and a null component; rows with equal doc_ids are one node of the
graph but each gives a row; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, drop, mix64, quoted, save, tidy
from .words import Words, ragged

GROUP_TOKENS = 1 << 20
VISIT_TOKENS = 1 << 22
REGROUPINGS = 3
LOOKED_AT = 3
SAMPLED = 64  # of so many classes one is sampled to find parts that very many have
HOT = 8  # sampled classes that have such a part, at least
HOT_PARTS = 1 << 20
#: Tables of keys that are sent to all executors are no larger than this; larger ones are
#: joined by shuffling. All other joins are left to the planner.
BROADCAST_BYTES = 16 << 20


def sent(keys: DataFrame) -> DataFrame:
    """A table of longs, for a join with a much larger one."""
    return F.broadcast(keys) if keys.count() * 8 * len(keys.columns) <= BROADCAST_BYTES else keys.hint("merge")

# ------------------------------------------------------------------ sets


def sets_of(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words([t.lower() for t in texts])
    h, first = words.hashes(), words.first
    if len(h) >= width:
        s = h[: len(h) - width + 1]
        for i in range(1, width):
            s = mix64(s * U64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
        s = mix64(s)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        if n >= width:
            t = np.sort(s[a : b - width + 1])
            keep = np.ones(len(t), bool)
            np.not_equal(t[1:], t[:-1], out=keep[1:])
            out.append(t[keep])
        elif n:
            v = np.full(1, n, U64)
            for i in range(a, b):
                v = mix64(v * U64(0xC2B2AE3D27D4EB4F) + h[i : i + 1])
            out.append(v)
        else:
            out.append(np.empty(0, U64))
    return out


@lru_cache(None)
def bands(percent: int) -> tuple[int, list[int]]:
    """Least size that can link with another set, and the first size of each band of
    sizes; a band's last size is half as large again as its first."""
    gap = 100 - percent
    edges = [-(-percent // gap)]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * 3 // 2 + 1)
    return edges[0], edges


def parts_of(largest: int, percent: int) -> int:
    """Parts of a scheme whose band ends with this size: enough that a set of any size
    in it nearly always has more parts with tokens than differ()."""
    return -(-115 * (differ(largest, percent) + 1) // 100) + 4


def differ(size: int, percent: int) -> int:
    """Most tokens by which a set of this size differs from a linked one at least as
    large: (a + b)(1 - J)/(1 + J) with b = size/J at most."""
    return size * (100 - percent) // percent


@lru_cache(4096)
def cuts(parts: int) -> np.ndarray:
    return np.array([(k << 64) // parts for k in range(1, parts)], U64)


def signatures(tokens: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """For each scheme in which the set may meet linked sets (those of the bands where the
    smaller set of such a pair may lie): hashes of its parts, and how many of them it must
    share with any set that it links with.

    A linked set differs in at most differ() tokens, so it agrees on all but so many of
    the parts that hold tokens. Empty parts count only where that promises nothing."""
    size = len(tokens)
    least, edges = bands(percent)
    if size < least:
        return []
    band = int(np.searchsorted(edges, size, "right")) - 1
    schemes = [band]
    if band and -(-size * percent // 100) < edges[band]:
        schemes.append(band - 1)
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix64(tokens ^ U64(0xD6E8FEB86659FD93)))))
    out = []
    for scheme in schemes:
        parts = parts_of(edges[scheme + 1] - 1, percent)
        at = np.concatenate(([0], np.searchsorted(tokens, cuts(parts)), [size]))
        full = at[1:] > at[:-1]
        names = mix64(np.arange(parts, dtype=U64) + U64((scheme + 1) << 32))
        sig = mix64((sums[at[1:]] - sums[at[:-1]]) ^ names)
        promised = int(np.count_nonzero(full)) - differ(size, percent)
        out.append((sig[full], promised) if promised > 0 else (sig, 1))
    return out


SETS = "doc_id long, n_shingles long, h1 long, h2 long, parts array<long>, cut int, need0 int, need1 int"


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            rows = []
            for at in range(0, len(texts), 200):
                for t in sets_of(texts[at : at + 200], width):
                    signed = [*signatures(t, percent), *[(np.empty(0, U64), 0)] * 2]
                    rows.append((len(t), mix64(t).sum(dtype=U64), mix64(t ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64), np.concatenate([signed[0][0], signed[1][0]]), len(signed[0][0]), signed[0][1], signed[1][1]))
            offsets = np.concatenate(([0], np.cumsum([len(r[3]) for r in rows]))).astype(np.int32)
            flat = np.concatenate([r[3] for r in rows]).view(np.int64) if rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    *(pa.array(np.array([r[i] for r in rows], U64).view(np.int64)) for i in (1, 2)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    *(pa.array([r[i] for r in rows], pa.int32()) for i in (4, 5, 6)),
                ],
                names=["doc_id", "n_shingles", "h1", "h2", "parts", "cut", "need0", "need1"],
            )

    return docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text")).mapInArrow(tidy(run), SETS)


# ------------------------------------------------------------------ the matrix


class Group:
    """The token union of some documents and the postings of each token."""

    def __init__(self, ids: list[int], members: list[int], sets: list[np.ndarray]):
        self.ids, self.members = np.array(ids), np.array(members)
        self.sizes = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        tokens = tokens[order]
        self.starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        self.union = tokens[self.starts]
        self.counts = np.diff(np.concatenate((self.starts, [len(tokens)])))

    def linked(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Numbers of the members that link with the query. The overlap with the union
        bounds the overlap with each; the group is opened only if that can suffice."""
        at = np.searchsorted(self.union, query)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == query]
        if 100 * len(at) < percent * len(query):
            return np.empty(0, np.int64)
        met = np.bincount(self.owners[ragged(self.starts[at], self.counts[at])], minlength=len(self.ids))
        return np.flatnonzero(100 * met >= percent * (self.sizes + len(query) - met))


class Forest:
    """Disjoint sets over small numbers; tells which unions were new."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


FOUND = "a long, b long, links long"


def _open_groups(percent: int, width: int):
    """Rows (home, copy, visit, asks, rep, members, text) sorted by the first three: the
    members of a copy of a group first, then its visitors. Every visitor and the members that
    ask here are its queries. Yields (a, b, null) for spanning links and (a, null, links)
    for counts of links."""

    def run(batches):
        import pyarrow.compute as pc

        place, members, group = None, {}, None
        out: list[tuple[list, list, list]] = []

        def put(a, b, links):
            out.append((a, b, links))

        def opened() -> tuple[Group, Forest, np.ndarray]:
            """Build the group and let those of its members that ask be its first queries."""
            keys = list(members)
            g, f = Group([k[0] for k in keys], [members[k][0] for k in keys], [members[k][1] for k in keys]), Forest()
            for i, key in enumerate(keys):
                if not members[key][2]:
                    continue
                to = g.linked(members[key][1], percent)
                to = to[to != i]
                if len(to):
                    put([key[0]], [None], [int(g.members[to].sum())])
                    new = [int(g.ids[j]) for j in to[to < i].tolist() if f.join(i, j)]
                    put([key[0]] * len(new), new, [None] * len(new))
            return g, f, np.zeros(len(keys), np.int64)

        def closed():
            """The links that visitors brought to each member, summed."""
            if not members:
                return
            ids, _, met = (g := group or opened())[0].ids, g[1], g[2]
            at = np.flatnonzero(met)
            put(ids[at].tolist(), [None] * len(at), met[at].tolist())

        def flushed():
            cols = [[x for part in out for x in part[i]] for i in range(3)]
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "links"])
            out.clear()
            return batch

        for batch in batches:
            homes, copies, visits, asks, reps, counts = (batch.column(i).to_pylist() for i in range(6))
            texts = pc.fill_null(batch.column(6).cast(pa.binary()), b"").to_pylist()
            for at in range(0, len(texts), 200):
                part = slice(at, at + 200)
                for home, copy, visit, ask, rep, n, tokens in zip(*(c[part] for c in (homes, copies, visits, asks, reps, counts)), sets_of(texts[part], width)):
                    if (home, copy) != place:
                        closed()
                        place, members, group = (home, copy), {}, None
                    if not visit:
                        # equal rows are one document
                        members[rep, int(mix64(tokens).sum(dtype=U64))] = (n, tokens, ask)
                        continue
                    if group is None:
                        group = (*opened(), [0])
                    g, forest, met, seen = group
                    to = g.linked(tokens, percent)
                    if len(to):
                        seen[0] += 1
                        me = len(g.ids) + seen[0]
                        put([rep], [None], [int(g.members[to].sum())])
                        met[to] += n
                        new = [int(g.ids[j]) for j in to.tolist() if forest.join(j, me)]
                        put([rep] * len(new), new, [None] * len(new))
                if len(out) > 2_000:
                    yield flushed()
        closed()
        yield flushed()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component) by alternating large and small stars until nothing changes."""
    edges = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # large star: every larger neighbour of a node goes to the node's least one
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = save(large, "large")
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(least, F.col("a") == F.col("n"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        small = save(small, "small")
        same = small.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(edges), drop(large)
        edges = small
        if same:
            return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")


def _grouped(keyed: DataFrame, most: int) -> DataFrame:
    """rep, members, n, key, home: classes with equal keys share a group, split by a hash
    into groups of about ``most`` tokens. The number of a group starts with its tokens, so
    heavier groups have larger numbers; the few that agree in number are one group."""
    splits = keyed.groupBy("key").agg(F.ceil(F.sum("n") / F.lit(float(most))).alias("splits"))
    placed = keyed.join(splits, "key").select("rep", "members", "n", "key", F.xxhash64("key", F.pmod(F.xxhash64("rep"), "splits")).alias("g"))
    weights = placed.groupBy("g").agg(F.least(F.sum("n"), F.lit((1 << 31) - 1)).alias("w"))
    home = F.shiftleft("w", 32).bitwiseOR(F.col("g").bitwiseAND(F.lit((1 << 32) - 1)))
    return save(placed.join(weights, "g").select("rep", "members", "n", "key", home.alias("home")), "grouped")


def _drawn(marks: DataFrame, grouped: DataFrame, turn: int) -> DataFrame:
    """rep, drawn: the heaviest group that holds about as many of a class's parts as one
    that it links with must. It only decides where documents are compared, so the
    heaviest group of each part and, by turns, one in ``LOOKED_AT`` parts are looked at."""
    some = marks.where(F.pmod("part", F.lit(LOOKED_AT)) == turn % LOOKED_AT)
    placed = some.select("rep", "scheme", "part", "need").join(sent(grouped.select("rep", "home")), "rep")
    heaviest = placed.groupBy("part").agg(F.max("home").alias("to"))
    met = placed.join(heaviest, "part").where("to > home").groupBy("rep", "scheme", "to").agg(F.count(F.lit(1)).alias("met"), F.min("need").alias("need"))
    return met.where(F.col("met") * 2 * LOOKED_AT >= F.col("need")).groupBy("rep").agg(F.max("to").alias("drawn"))


def _visits(marks: DataFrame, grouped: DataFrame, needs: DataFrame) -> DataFrame:
    """rep, to: heavier groups that a class must visit. Those of its own key it visits
    without further ado; of the others those that hold as many of its parts as a class
    that it links with must. Rows of the matrix are parts, its columns groups."""
    own = grouped.select("key", F.col("home").alias("to")).distinct()
    own = grouped.select("rep", "key", "home").join(own, "key").where("to > home").select("rep", "to")
    placed = marks.select("rep", "scheme", "part").join(sent(grouped.select("rep", "key", "home")), "rep")
    cells = placed.select("part", F.col("key").alias("to_key"), F.col("home").alias("to")).distinct()
    met = placed.join(cells, "part").where("to > home and to_key <> key").groupBy("rep", "scheme", "to").agg(F.count(F.lit(1)).alias("met"))
    return own.unionByName(met.join(needs, ["rep", "scheme"]).where("met >= need").select("rep", "to")).distinct()


def _shared(marks: DataFrame) -> DataFrame:
    """marks with ``columns``, the classes that have the part, where these are two or more.

    Nearly all parts are of one class, and marks are counted where they meet, after one
    shuffle. A part that very many classes have would meet in one task: such parts are found
    in a sample (by classes, so each shows in proportion) and counted by partial sums; what
    the sample misses is counted all the same. At most ``HOT_PARTS`` of them are sent."""
    seen = marks.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLED)) == 0).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    seen = save(seen.where("n > 1"), "sampled")
    total = seen.agg(F.sum("n")).first()[0] or 0
    hot = save(seen.where(F.col("n") > max(HOT, total // HOT_PARTS)).select("part"), "hot")
    often = save(marks.join(F.broadcast(hot), "part", "left_semi"), "often")
    counts = F.broadcast(often.groupBy("part").agg(F.count(F.lit(1)).alias("columns")))
    seldom = marks.join(F.broadcast(hot), "part", "left_anti").withColumn("columns", F.count(F.lit(1)).over(Window.partitionBy("part")))
    out = save(seldom.unionByName(often.join(counts, "part")).where("columns > 1").select("part", "rep", "scheme", "columns"), "shared")
    drop(seen, hot, often)
    return out


def _trips(grouped: DataFrame, visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The copies of each group, and rep, members, home, copy, visit, asks: where each class goes. A group has a copy for
    every ``VISIT_TOKENS`` tokens of visitors; its members go to all of its copies and ask
    at one, a visitor goes to one."""
    deal = lambda copies: F.pmod(F.xxhash64("rep"), copies)
    coming = grouped.select("rep", "members", "n").join(visits, "rep")
    copies = coming.groupBy(F.col("to").alias("home")).agg(F.ceil(F.sum("n") / F.lit(float(VISIT_TOKENS))).alias("copies"))
    copies = save(copies, "copies")
    visitors = coming.withColumnRenamed("to", "home").join(copies, "home")
    visitors = visitors.select("rep", "members", "home", deal(F.col("copies")).alias("copy"), F.lit(1).alias("visit"), F.lit(True).alias("asks"))
    n = F.coalesce("copies", F.lit(1).cast("long"))
    own = grouped.join(copies, "home", "left").select("rep", "members", "home", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("copy"), deal(n).alias("at"))
    own = own.select("rep", "members", "home", "copy", F.lit(0).alias("visit"), (F.col("copy") == F.col("at")).alias("asks"))
    return copies, own.unionByName(visitors)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links."""
    sets = save(shingle_sets(docs, id_col, text_col, width, percent), "sets")
    known = sets.where("doc_id is not null and n_shingles > 0")
    classes = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"), F.max("n_shingles").alias("n"))
    classes = save(classes, "classes")

    # parts that two classes share; a class's parts are those of its smallest doc_id
    reps = classes.select("h1", "h2", "rep")
    heads = known.where(F.size("parts") > 0).withColumnRenamed("doc_id", "rep").join(sent(reps), ["rep", "h1", "h2"], "left_semi")
    all_marks = heads.select("rep", F.posexplode("parts").alias("i", "part"), "cut").select("rep", (F.col("i") >= F.col("cut")).cast("tinyint").alias("scheme"), "part")
    shared = _shared(all_marks)
    # a class goes on only if it shares as many parts as a linked one must
    needs = heads.select("rep", F.lit(0).cast("tinyint").alias("scheme"), F.col("need0").alias("need")).unionByName(
        heads.where("need1 > 0").select("rep", F.lit(1).cast("tinyint").alias("scheme"), F.col("need1").alias("need"))
    )
    needs = needs.groupBy("rep", "scheme").agg(F.min("need").alias("need"))
    enough = shared.groupBy("rep", "scheme").agg(F.count(F.lit(1)).alias("met"), F.max(F.struct("columns", "part")).alias("most"))
    enough = save(enough.join(needs, ["rep", "scheme"]).where("met >= need").select("rep", "scheme", "need", "most"), "enough")
    needs = sent(enough.select("rep", "scheme", "need"))
    marks = save(shared.drop("columns").join(needs, ["rep", "scheme"]), "marks")
    drop(shared)

    # groups: at first by the most shared part of each class, then by the heaviest group
    # that each class would visit, which draws those of one neighbourhood together
    chosen = enough.groupBy("rep").agg(F.max("most")["part"].alias("key"))
    chosen = chosen.join(classes.groupBy("rep").agg(F.sum("members").alias("members"), F.sum("n").alias("n")), "rep")
    chosen = save(chosen, "chosen")
    grouped = _grouped(chosen, 1 << 62)
    drop(chosen)
    for turn in range(REGROUPINGS):
        keyed = save(grouped.join(_drawn(marks, grouped, turn), "rep", "left").select("rep", "members", "n", F.coalesce("drawn", "home").alias("key")), "drawn")
        drop(grouped)
        grouped = _grouped(keyed, 1 << 62)
        drop(keyed)
    whole, grouped = grouped, _grouped(grouped.select("rep", "members", "n", F.col("home").alias("key")), GROUP_TOKENS)
    # matrix cells: part x group
    visits = save(_visits(marks, grouped, needs), "visits")
    drop(whole, marks, enough)

    # each class goes to its own group and as a query to the groups that it visits
    copies, trips = _trips(grouped, visits)
    trips = save(trips, "trips")
    drop(grouped, visits, copies)
    texts = docs.select(F.col(quoted(id_col)).cast("long").alias("rep"), F.col(quoted(text_col)).alias("text")).where("rep is not null")
    rows = texts.join(sent(trips), "rep").select("home", "copy", "visit", "asks", "rep", "members", "text").repartition("home", "copy").sortWithinPartitions("home", "copy", "visit")
    found = save(rows.mapInArrow(tidy(_open_groups(percent, width)), FOUND), "found")
    drop(trips)

    labels = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    of_class = classes.join(labels, F.col("rep") == F.col("node"), "left").join(links, F.col("rep") == F.col("a"), "left")
    of_class = of_class.select("h1", "h2", "members", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    out = sets.select("doc_id", "n_shingles", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(linked, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linked, F.col("members") - 1 + F.col("links")).otherwise(F.lit(0)).alias("n_links"),
    )
