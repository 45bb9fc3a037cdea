"""Approximate nearest neighbours by learned partitions.

On a bounded sample the graph of nearest neighbours is cut into balanced parts,
and a small softmax classifier learns to tell a vector's part and those of its
neighbours. Parts and classifier are refined in turn, and offsets keep the
parts balanced. The classifier then places every vector of the table in its
most probable part; a query visits its several most probable
parts, whose vectors are ranked by their exact cosine. How many parts are
visited is measured on the sample: the least number that finds the wanted share
of true neighbours there.

The number of parts grows with the square root of the table, and the sample with
the parts, up to ``MOST_PARTS``: finer parts are left out more exactly, so the
share of the table that a query meets falls as the table grows.

Vectors and queries meet in blocks of bounded size: a part with many vectors is
dealt over many blocks, and a block with many queries likewise.

Defined cases: vectors that are null, zero, of another length than the sample's
most common one, or hold a null or non-finite component take no part, neither
as queries nor as candidates; equal cosines go to the smaller id; a query that
finds fewer than k candidates visits further parts until there are k or no
more; rows that repeat an id are separate candidates, all but those with the
query's own id; rows with a null id take no part; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fraudlens.llm.storage import cut

#: The sample has at least so many vectors (expected), and so many for each part.
SAMPLE_ROWS, SAMPLE_ROWS_A_PART = 3000, 24
#: Parts for each square root of the table's rows, and at most: the sample is bounded by 24 x 512 vectors.
PARTS_A_ROOT, MOST_PARTS = 2.0, 512
#: Neighbours of a node of the graph.
GRAPH_NEIGHBOURS = 20
#: Share of the true neighbours in the sample that the visited parts must hold.
WANTED_RECALL = 0.93
BLOCK_ROWS, BLOCK_QUERIES = 8192, 1024


@dataclass
class Router:
    """A linear classifier from unit vectors to parts, and how many parts a query visits."""

    weights: np.ndarray
    offsets: np.ndarray
    visits: int

    def scores(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.weights + self.offsets

    @property
    def parts(self) -> int:
        return len(self.offsets)

    @property
    def length(self) -> int:
        return len(self.weights)


def balanced_parts(near: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1, seed: int = 7) -> np.ndarray:
    """Cut a neighbour graph (row i: the neighbours of i) into parts of nearly
    equal size. Parts grow from far-apart nodes, then nodes move, most gain
    first, to the part that most of their neighbours are in while it has room."""
    n = len(near)
    room = int(np.ceil(slack * n / parts))
    both = [set(x) for x in near.tolist()]
    for i, row in enumerate(near.tolist()):
        for j in row:
            both[j].add(i)
    rng = np.random.default_rng(seed)
    at = np.full(n, -1)
    free = iter(rng.permutation(n).tolist())
    for part in range(parts):  # breadth-first growth to the mean size
        goal, size, waiting = -(-n * (part + 1) // parts) - -(-n * part // parts), 0, deque()
        while size < goal:
            while waiting and at[waiting[0]] >= 0:
                waiting.popleft()
            node = waiting.popleft() if waiting else next(i for i in free if at[i] < 0)
            at[node], size = part, size + 1
            waiting.extend(j for j in both[node] if at[j] < 0)
    sizes = np.bincount(at, minlength=parts)
    for _ in range(rounds):
        moved = 0
        votes = np.zeros((n, parts), np.int32)
        for i, others in enumerate(both):
            np.add.at(votes[i], at[list(others)], 1)
        gain = votes.max(axis=1) - votes[np.arange(n), at]
        for i in np.argsort(-gain, kind="stable").tolist():
            if gain[i] <= 0:
                break
            to = int(votes[i].argmax())
            if to != at[i] and sizes[to] < room:
                sizes[at[i]] -= 1
                sizes[to] += 1
                at[i] = to
                moved += 1
        if not moved:
            break
    return at


def train_router(unit: np.ndarray, near: np.ndarray, parts: int, turns: int = 5, epochs: int = 2, sharpness: float = 12.0, rate: float = 0.02, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(weights, offsets) of a softmax classifier. It begins with the parts'
    mean vectors and learns, by Adam in small batches, each vector's part and
    the parts of its neighbours; then its own parts take the place of the old."""
    rng = np.random.default_rng(seed)
    at, n = balanced_parts(near, parts), len(unit)
    for _ in range(turns):
        sums = np.zeros((parts, unit.shape[1]))
        np.add.at(sums, at, unit)
        weights = sharpness * (sums / np.maximum(1e-9, np.linalg.norm(sums, axis=1, keepdims=True))).T
        first, second, step = np.zeros_like(weights), np.zeros_like(weights), 0
        for _ in range(epochs):
            order = rng.permutation(n)
            for i in np.array_split(order, -(-n // 256)):
                z = unit[i] @ weights
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(i)), at[i]] -= 0.5
                for others in near[i].T:
                    p[np.arange(len(i)), at[others]] -= 0.5 / near.shape[1]
                gradient = unit[i].T @ p / len(i) + 1e-4 * weights
                step += 1
                first = 0.9 * first + 0.1 * gradient
                second = 0.999 * second + 0.001 * gradient * gradient
                weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        scores, offsets = unit @ weights, np.zeros(parts)
        for _ in range(60):
            sizes = np.bincount((scores + offsets).argmax(axis=1), minlength=parts)
            offsets -= 0.15 * np.log((sizes + 1) / (n / parts + 1))
        at = (scores + offsets).argmax(axis=1)
    return weights, offsets


def _usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _similar(unit: np.ndarray, count: int, rows: np.ndarray) -> np.ndarray:
    """The ``count`` nearest others of the given rows, by blocks of rows."""
    out = []
    for at in range(0, len(rows), 256):
        some = rows[at : at + 256]
        cosine = (unit[some] @ unit.T).astype(np.float32)
        cosine[np.arange(len(some)), some] = -2
        out.append(np.argpartition(-cosine, count - 1, axis=1)[:, :count].copy())  # not a view that keeps the whole block
    return np.concatenate(out)


def parts_for(rows: int) -> int:
    return max(1, min(MOST_PARTS, int(PARTS_A_ROOT * rows**0.5)))


def fit_router(vectors: DataFrame, k: int, sample_rows: int = SAMPLE_ROWS, parts: int | None = None, wanted: float = WANTED_RECALL) -> Router | None:
    """Learn from a sample of usable vectors (_id, _v), taken by hash. ``parts``
    follows the number of rows if it is not given."""
    lengths = vectors.groupBy(F.size("_v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if lengths is None:
        return None
    parts = parts or parts_for(lengths["count"])
    share = min(1.0, max(sample_rows, SAMPLE_ROWS_A_PART * parts) / lengths["count"])
    picked = vectors.filter((F.size("_v") == lengths["size"]) & (F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < share * (1 << 30)))
    table = picked.select("_id", "_v").toArrow().sort_by("_id")
    parts = min(parts, len(table) // 8)
    if parts < 2 or len(table) <= GRAPH_NEIGHBOURS:  # a few vectors: one part is all of them
        return Router(np.zeros((lengths["size"], 1)), np.zeros(1), 1)
    unit = _units(np.array(table["_v"].to_pylist(), dtype=np.float64))
    every = np.arange(len(unit))
    router = Router(*train_router(unit, _similar(unit, GRAPH_NEIGHBOURS, every), parts), parts)
    asked = every[::5]
    order = np.argsort(-router.scores(unit), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :], axis=1)
    needed = np.take_along_axis(rank[asked], order[:, 0][_similar(unit, min(k, len(unit) - 1), asked)], axis=1)
    wanted = min(1.0, wanted + 0.5 / needed.size**0.5)  # the share is itself measured on few rows
    router.visits = next(m for m in range(1, parts + 1) if (needed < m).mean() >= wanted)
    return router


def _placed(router: Router):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = router.scores(_units(np.array(batch["_v"].to_pylist(), dtype=np.float64))).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch["_id"], batch["_v"], batch["_query"], pa.array(part.astype(np.int32))], names=["_id", "_v", "_query", "_part"])

    return run


def _routed(router: Router, held: np.ndarray, k: int):
    """The parts that each query visits: the router's number of them, and
    further ones until they hold more than k vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = np.argsort(-router.scores(_units(np.array(batch["_v"].to_pylist(), dtype=np.float64))), axis=1, kind="stable")
                enough = (np.cumsum(held[order], axis=1) <= k).sum(axis=1) + 1
                visits = [x[:m] for x, m in zip(order.tolist(), np.maximum(enough, router.visits).tolist())]
                yield pa.RecordBatch.from_arrays([batch["_id"], batch["_v"], pa.array(visits, pa.list_(pa.int32()))], names=["_id", "_v", "_visits"])

    return run


def _nearest(k: int):
    """The k nearest of a block to each of its queries, by (cosine, id)."""

    def run(_key, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = [[], [], []]
        if len(vectors) and len(queries):
            ids = vectors["_id"].to_numpy()
            rows = np.array(vectors["_v"].to_pylist(), dtype=np.float64)
            norms = np.sqrt((rows * rows).sum(axis=1))
            asked = np.array(queries["_v"].to_pylist(), dtype=np.float64)
            asked_norms = np.sqrt((asked * asked).sum(axis=1))
            for at in range(0, len(asked), 256):
                rough = (asked[at : at + 256] @ rows.T) / norms / asked_norms[at : at + 256, None]
                for i, query in enumerate(queries["_id"][at : at + 256].to_pylist()):
                    r = rough[i]
                    r[ids == query] = -np.inf
                    most = min(k, len(r))
                    least = np.partition(r, len(r) - most)[len(r) - most]
                    near = np.flatnonzero((r >= least - 1e-9) & (r > -np.inf))
                    # sums row by row: equal vectors get equal cosines wherever they stand
                    exact = (rows[near] * asked[at + i]).sum(axis=1) / (norms[near] * asked_norms[at + i])
                    best = np.lexsort((ids[near], -exact))[:k]
                    out[0].extend([query] * len(best))
                    out[1].extend(ids[near[best]].tolist())
                    out[2].extend(exact[best].tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", router: Router | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` with
    ``is_query`` its k nearest other rows among those in the visited parts."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_query")).filter(F.col("_id").isNotNull() & _usable(F.col("_v")))
    router = router or fit_router(rows.select("_id", "_v"), k)
    if router is None:
        return spark.createDataFrame([], schema)
    kind = dict(rows.dtypes)["_v"]
    placed = cut(rows.filter(F.size("_v") == router.length).mapInArrow(_placed(router), f"_id long, _v {kind}, _query boolean, _part int"), "placed")

    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each part
    held = np.array([counts.get(p, 0) for p in range(router.parts)])
    queries = placed.filter("_query").select("_id", "_v").mapInArrow(_routed(router, held, k), f"_id long, _v {kind}, _visits array<int>")
    queries = cut(queries.select("_id", "_v", F.explode("_visits").alias("_part")), "routed")
    asked = {r["_part"]: r["n"] for r in queries.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    grid = [(p, -(-counts[p] // BLOCK_ROWS), -(-asked.get(p, 0) // BLOCK_QUERIES)) for p in sorted(counts) if asked.get(p)]
    if not grid:
        return spark.createDataFrame([], schema)
    blocks = F.create_map(*[F.lit(x) for p, rows_in, queries_in in grid for x in (p, F.struct(F.lit(rows_in).alias("r"), F.lit(queries_in).alias("q")))])
    at = blocks[F.col("_part")]
    dealt = lambda n: F.pmod(F.xxhash64("_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    visited = placed.filter(F.col("_part").isin([p for p, *_ in grid]))
    left = visited.select("_id", "_v", "_part", dealt(at["r"]).alias("_r"), every(at["q"]).alias("_q"))
    right = queries.select("_id", "_v", "_part", dealt(at["q"]).alias("_q"), every(at["r"]).alias("_r"))
    keys = ["_part", "_r", "_q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_nearest(k), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
