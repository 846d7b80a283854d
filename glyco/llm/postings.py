"""Nearest neighbours by inner product over balanced posting lists.

Vectors get one more component that makes their lengths equal, so that the largest inner product is the
smallest distance. A balanced tree of median cuts over a bounded sample gives the centroids. Every row goes to its
nearest list, and as a boundary vector to further lists that are nearly as near. A graph over the centroids, held in
memory, is searched for both; a query reads the lists whose distance is within a ratio of its nearest
list's. The ratio is measured on a few queries against all rows so that the recall is reached.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyco.llm.ranks import sample_candidates
from glyco.session import write_through

SAMPLE_ROWS = 32_768  # rows that the lists are fitted on
LIST_ROWS = 256  # rows per list while there are fewer than MAX_LISTS
MAX_LISTS = 2_048
COPIES = 4  # lists that a boundary vector is in at most
BOUNDARY = 1.03  # distance of a further list, as a ratio of the nearest list's
FIRST_LISTS = 8  # nearest lists that a query reads whatever the ratio
DEGREE = 12
TRIAL_QUERIES = 128
RECALL = 0.98
BUNDLE_ROWS = 8_192  # rows of neighbouring lists that are scored together
QUERY_ROWS = 2_048
SEED = 17
FOUND = "query_row long, row long, vec_id long, score double"


@dataclass(frozen=True)
class Index:
    """Centroids (with the added component), their graph, the largest length and the search ratio."""

    centroids: np.ndarray
    graph: np.ndarray
    length: float
    ratio: float = 1.0

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """Rows with the component that brings each to the largest length."""
        rest = np.sqrt(np.maximum(self.length**2 - (vectors**2).sum(1), 0.0))
        return np.hstack([vectors, rest[:, None]])

    def flat(self, queries: np.ndarray) -> np.ndarray:
        """Queries at the common length; the added component is 0, so that only the inner product counts."""
        norms = np.sqrt((queries**2).sum(1, keepdims=True))
        return np.hstack([queries / norms * self.length, np.zeros((len(queries), 1))])


def usable(vector: Column) -> Column:
    """True for vectors that are present, not zero and finite throughout."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def balanced_leaves(points: np.ndarray, leaves: int) -> list[np.ndarray]:
    """Row numbers of ``leaves`` (a power of two) groups of equal size, cut at medians; neighbours follow each other."""
    groups = [np.arange(len(points))]
    while len(groups) < leaves:
        cut = []
        for rows in groups:
            here = points[rows]
            spread = here - here.mean(0)
            # The main direction, by power iteration from the farthest point.
            axis = spread[(spread**2).sum(1).argmax()]
            for _ in range(8):
                axis = spread.T @ (spread @ axis)
                axis = axis / (np.linalg.norm(axis) or 1.0)
            order = np.argsort(spread @ axis, kind="stable")
            cut += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        groups = cut
    return groups


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2.0 * (a @ b.T), 0.0)


def centroid_graph(centroids: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Neighbours of each centroid: its nearest ones, those it is among the nearest of, and a ring that connects all.

    Rows are filled up with the centroid itself; links back to a centroid stop at twice the degree.
    """
    count = len(centroids)
    near = min(degree, count - 1)
    nearest_ones = np.empty((count, near), np.int64)
    for a in range(0, count, 256):
        dist = squared(centroids[a : a + 256], centroids)
        dist[np.arange(len(dist)), np.arange(a, a + len(dist))] = np.inf
        nearest_ones[a : a + 256] = np.argsort(dist, axis=1)[:, :near]
    links = np.tile(np.arange(count)[:, None], (1, 3 * near + 2))
    links[:, :near] = nearest_ones
    links[:, -2], links[:, -1] = (np.arange(count) + 1) % count, (np.arange(count) - 1) % count
    used = np.full(count, near)
    for rank in range(near):  # nearest first
        for node, to in enumerate(nearest_ones[:, rank].tolist()):
            if used[to] < 3 * near and node not in nearest_ones[to]:
                links[to, used[to]] = node
                used[to] += 1
    return links


def graph_search(index: Index, points: np.ndarray, ratio: float, least: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to the centroids met (others infinite) and which of them lie within ``ratio``.

    All points of a block walk the graph together: in each step every point opens its nearest unopened
    centroids until none is left within the ratio of its nearest and among its ``least`` nearest.
    """
    count = len(index.centroids)
    dists, inside = np.full((len(points), count), np.inf), np.zeros((len(points), count), bool)
    entry = np.unique(np.linspace(0, count - 1, min(count, 16)).astype(int))
    step = 4
    for a in range(0, len(points), block):
        part = points[a : a + block]
        dist = np.full((len(part), count), np.inf)
        opened = np.zeros((len(part), count), bool)
        dist[:, entry] = squared(part, index.centroids[entry])
        active = np.arange(len(part))
        while len(active):
            here = dist[active]
            best = here.min(1)
            wide = np.maximum(best * ratio**2, np.partition(here, min(least, count) - 1, axis=1)[:, min(least, count) - 1])
            here = np.where(opened[active] | (here > wide[:, None]), np.inf, here)
            pick = np.argpartition(here, min(step, count) - 1, axis=1)[:, :step] if count > step else np.tile(np.arange(count), (len(active), 1))
            live = np.take_along_axis(here, pick, 1) < np.inf
            rows = np.repeat(active, pick.shape[1])[live.ravel()]
            nodes = pick[live]
            opened[rows, nodes] = True
            to = index.graph[nodes]
            rows = np.repeat(rows, to.shape[1])
            to = to.ravel()
            new = np.isinf(dist[rows, to])
            rows, to = rows[new], to[new]
            dist[rows, to] = ((part[rows] - index.centroids[to]) ** 2).sum(1)
            active = active[live.any(1)]
        dists[a : a + block] = dist
        inside[a : a + block] = dist <= dist.min(1, keepdims=True) * ratio**2
    return dists, inside


def selected(index: Index, points: np.ndarray) -> np.ndarray:
    """Lists that each query reads: those within the ratio, and its ``FIRST_LISTS`` nearest."""
    dists, inside = graph_search(index, points, index.ratio, 2 * FIRST_LISTS)
    first = np.argsort(dists, axis=1, kind="stable")[:, :FIRST_LISTS]
    np.put_along_axis(inside, first, True, axis=1)
    return inside


def assigned(index: Index, vectors: np.ndarray, copies: int = COPIES, boundary: float = BOUNDARY) -> list[list[int]]:
    """Lists of each vector: its nearest, and the next nearest within the ratio, ``copies`` in all."""
    dists, inside = graph_search(index, index.lifted(vectors), boundary, copies)
    some = min(copies, dists.shape[1])
    near = np.argsort(np.where(inside, dists, np.inf), axis=1, kind="stable")[:, :some]
    return [lists[:n].tolist() for lists, n in zip(near, np.minimum(inside.sum(1), some))]


def kind(rows: DataFrame) -> str:
    return rows.schema["v"].dataType.simpleString()


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column, all of one length, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def inner_products(queries: np.ndarray, vectors: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Inner products of chosen pairs, each summed in the same order, so that equal vectors tie."""
    out = np.empty(len(at[0]))
    for a in range(0, len(out), 65_536):
        out[a : a + 65_536] = (queries[at[0][a : a + 65_536]] * vectors[at[1][a : a + 65_536]]).sum(1)
    return out


def nearest(queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """(query row, row, place of the row, score) of the ``k`` best candidates of each query, ties to smaller ids."""
    parts = []
    for a in range(0, len(queries), 256):
        q = queries[a : a + 256]
        rough = q @ vectors.T
        rough[query_rows[a : a + 256, None] == rows[None, :]] = -np.inf
        if len(rows) > k:
            # Everything that rounding could lift among the k best is scored again in one fixed order.
            slack = 1e-9 * np.abs(np.where(np.isinf(rough), 0.0, rough)).max(1)
            bound = np.partition(rough, len(rows) - k, axis=1)[:, len(rows) - k] - slack
        else:
            bound = np.full(len(q), -np.inf)
        at = np.nonzero((rough >= bound[:, None]) & (rough > -np.inf))
        score = inner_products(q, vectors, at)
        order = np.lexsort((rows[at[1]], ids[at[1]], -score, at[0]))
        qs, vs, score = at[0][order], at[1][order], score[order]
        place = np.arange(len(qs)) - np.searchsorted(qs, qs, "left")
        keep = place < k
        parts.append([query_rows[a + qs[keep]], rows[vs[keep]], vs[keep], score[keep]])
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * 3 + [np.empty(0)]


ID_LAST = np.iinfo(np.int64).max  # stands for a null id: behind all others in ties


def rows_of(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = table["vec_id"].fill_null(ID_LAST) if isinstance(table, pa.RecordBatch) else table["vec_id"].combine_chunks().fill_null(ID_LAST)
    return table["row"].to_numpy(), ids.to_numpy(zero_copy_only=False), matrix(table["v"])


def found_table(query_row, row, vec_id, score) -> dict:
    return {"query_row": pa.array(query_row, pa.int64()), "row": pa.array(row, pa.int64()), "vec_id": pa.array(vec_id, pa.int64(), mask=np.asarray(vec_id) == ID_LAST), "score": pa.array(score, pa.float64())}


def exact_top(rows: DataFrame, queries: list, k: int) -> DataFrame:
    """The ``k`` nearest rows of a few queries (row, vector), in one pass over all rows."""
    q_rows = np.array([r for r, _ in queries], np.int64)
    q = np.array([v for _, v in queries], np.float64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ids, v = rows_of(batch)
            if len(row):
                qr, r, at, score = nearest(q, q_rows, v, row, ids, k)
                yield pa.RecordBatch.from_pydict(found_table(qr, r, ids[at], score))

    return top(rows.select("row", "vec_id", "v").mapInArrow(scan, FOUND), k)


def top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows per query; a row that several lists gave counts once."""
    once = found.groupBy("query_row", "row").agg(F.first("vec_id").alias("vec_id"), F.max("score").alias("score"))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fit(rows: DataFrame, count: int) -> Index:
    """Lists fitted on at most ``SAMPLE_ROWS`` rows of lowest seeded hash; the largest length is over all rows."""
    length = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0] ** 0.5
    sample = sample_candidates(rows, ["row"], SAMPLE_ROWS, SEED).orderBy("place", "row").limit(SAMPLE_ROWS).select("v").toArrow()
    wanted = min(MAX_LISTS, max(1, count // LIST_ROWS), max(1, sample.num_rows // 16))
    lists = 1 << (wanted.bit_length() - 1)
    index = Index(np.empty((0, 0)), np.empty((0, 0)), length)
    points = index.lifted(matrix(sample["v"]))
    centroids = np.array([points[g].mean(0) for g in balanced_leaves(points, lists)])
    return Index(centroids, centroid_graph(centroids), length)


def assign(rows: DataFrame, index: Index) -> DataFrame:
    """``row, vec_id, v, list``: each row once per list that it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = assigned(index, matrix(batch["v"]))
                at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
                part = batch.select(["row", "vec_id", "v"]).take(at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c for x in lists for c in x], pa.int32())], ["row", "vec_id", "v", "list"])

    return rows.select("row", "vec_id", "v").mapInArrow(run, f"row long, vec_id long, v {kind(rows)}, list int")


def measured_ratio(rows: DataFrame, posted: DataFrame, index: Index, count: int, k: int, recall: float) -> float:
    """The smallest ratio whose lists hold the wanted share of the true neighbours of ``TRIAL_QUERIES`` rows.

    The driver gets ``k`` rows per trial query, whatever the size of the table.
    """
    asked = [(r["row"], r["v"]) for r in sample_candidates(rows, ["row"], TRIAL_QUERIES, SEED + 1).orderBy("place", "row").limit(TRIAL_QUERIES).collect()]
    truth = exact_top(rows, asked, k).select("query_row", "row")
    held = posted.select("row", "list").join(truth, "row").groupBy("query_row", "row").agg(F.collect_set("list").alias("lists")).collect()
    points = index.flat(np.array([v for _, v in asked], np.float64))
    near = np.sqrt(squared(points, index.centroids))
    near = near / np.maximum(near.min(1, keepdims=True), 1e-12)
    np.put_along_axis(near, np.argsort(near, axis=1, kind="stable")[:, :FIRST_LISTS], 1.0, axis=1)
    place = {row: i for i, (row, _) in enumerate(asked)}
    needed = sorted(min(near[place[h["query_row"]]][c] for c in h["lists"]) for h in held)
    return float(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1e-9 if needed else 1.0


def probes(queries: DataFrame, index: Index, per_bundle: int) -> DataFrame:
    """``query_row, q, bundle, lists``: the lists that each query reads, by bundle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            inside = selected(index, index.flat(matrix(batch["v"])))
            at, bundles, lists = [], [], []
            for i, ok in enumerate(inside):
                near = np.flatnonzero(ok)
                for bundle in np.unique(near // per_bundle).tolist():
                    at.append(i)
                    bundles.append(bundle)
                    lists.append(near[near // per_bundle == bundle].tolist())
            part = batch.select(["row", "v"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bundles, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], ["query_row", "q", "bundle", "lists"])

    return queries.select("row", "v").mapInArrow(run, f"query_row long, q {kind(queries)}, bundle int, lists array<int>")


def score_cell(asked: pa.Table, posted: pa.Table, k: int) -> pa.Table:
    """The ``k`` best rows that each query finds in its lists of one bundle."""
    row, ids, v = rows_of(posted)
    q_row, q = asked["query_row"].to_numpy(), matrix(asked["q"])
    wants = asked["lists"].to_pylist()
    lists = posted["list"].to_numpy()
    by_list: dict[int, list[int]] = {}
    for i, some in enumerate(wants):
        for c in some:
            by_list.setdefault(c, []).append(i)
    parts = []
    for c, who in by_list.items():
        here = np.flatnonzero(lists == c)
        if len(here):
            qr, r, at, score = nearest(q[who], q_row[who], v[here], row[here], ids[here], k)
            parts.append((qr, r, ids[here[at]], score))
    if not parts:
        return pa.table(found_table([], [], np.array([], np.int64), []))
    qr, r, i, score = [np.concatenate(c) for c in zip(*parts)]
    order = np.lexsort((r, i, -score, qr))
    qr, r, i, score = qr[order], r[order], i[order], score[order]
    # A boundary vector stands in several lists of the bundle; its copies are neighbours now.
    new = np.ones(len(qr), bool)
    new[1:] = (qr[1:] != qr[:-1]) | (r[1:] != r[:-1])
    qr, r, i, score = qr[new], r[new], i[new], score[new]
    keep = np.arange(len(qr)) - np.searchsorted(qr, qr, "left") < k
    return pa.table(found_table(qr[keep], r[keep], i[keep], score[keep]))


def search(rows: DataFrame, queries: Column, k: int = 20, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for every row that meets ``queries``.

    ``rows`` has ``vec_id`` and ``embedding``; other columns are ignored. Vectors that are null, zero or hold null
    or non-finite components take no part, as queries or candidates. Rows that repeat an id are rows of their
    own: a query skips only itself, and each such query is answered. Rows without an id are candidates, last
    in ties, and no queries of the id rule. Vectors must have one length; an empty table gives no rows.

    The lists are fitted on a bounded sample, all rows are listed. A list grows with the table once there are
    ``MAX_LISTS``: bundles are then cut into pieces, so no task holds a list. Equal vectors share a list and are cut
    likewise. Queries of a bundle are cut the same way, and each cell keeps ``k`` rows per query.
    """
    # Vectors keep the type they are stored in until they are scored.
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).filter(usable(F.col("v")))
    plain = write_through(plain.withColumn("row", F.monotonically_increasing_id()))
    count = plain.count()
    out = "query_id long, rank int, vec_id long, score double"
    if not count:
        return rows.sparkSession.createDataFrame([], out)
    index = fit(plain, count)
    posted = write_through(assign(plain, index))
    index = Index(index.centroids, index.graph, index.length, measured_ratio(plain, posted, index, count, k, recall))
    per_bundle = max(1, BUNDLE_ROWS // max(1, posted.count() // len(index.centroids)))
    asked = plain.filter(F.coalesce(queries, F.lit(False)))
    probed = write_through(probes(asked, index, per_bundle))
    posted = posted.withColumn("bundle", F.floor(F.col("list") / per_bundle).cast("int"))
    # Pieces of a bundle on either side: every query piece meets every row piece once.
    sizes = posted.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / (2 * BUNDLE_ROWS)).cast("int").alias("pieces"))
    sizes = write_through(sizes.join(probed.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("turns")), "bundle"))

    def dealt(side: DataFrame, row: str, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(F.lit(SEED), row), F.col(own)).cast("int").alias(f"{own}_at")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_at")
        return side.join(sizes, "bundle").select(*side.columns, mine, every)

    cell = ["bundle", "pieces_at", "turns_at"]
    left = dealt(probed, "query_row", "turns", "pieces").groupBy(*cell)
    right = dealt(posted, "row", "pieces", "turns").groupBy(*cell)
    found = top(left.cogroup(right).applyInArrow(lambda a, b: score_cell(a, b, k), FOUND), k)
    names = asked.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return found.join(names, "query_row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
