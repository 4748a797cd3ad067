"""Approximate nearest neighbours by inner product: an HNSW graph per shard, shard results merged.

Distinct vectors are spread over shards by hash. Each shard's graph is one row of flat arrays: per
layer the nodes, a fixed number of neighbour slots for each (-1: none), and the vectors. A node is
linked, as it would be on insertion in order, to a spread-out choice among the nearest nodes that
came before it, and they link back. A shard is bounded, so nearest nodes come from blocked matrix
products instead of searches on the growing graph. Inner products become distances by one further
component that brings every vector of the shard to the same norm.

Queries go to the shards in blocks of tens of thousands, so a graph moves once for that many; shards
grow with the square root of the table up to what a task's memory holds, so that they are fewer. A
search walks down the layers and keeps a beam of ``ef`` in the lowest; ``STEP`` queries step together.
Scores of what is found are computed from the original vectors in double precision before results merge.

Rows with equal vectors are one node that lists its smallest ids, one more than are asked for: no
further id can be among the nearest. Vectors of other lengths are searched apart.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no
part, neither do null ids; fewer candidates than ``k`` are all returned; ties go to the smaller id;
a repeated row repeats a candidate, and a query id that repeats is searched once, by its least
vector; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import stored

#: Rows of a shard: the least, the most, and between them this many times the square root of all rows.
LEAST_ROWS, MOST_ROWS, ROOT_ROWS = 4096, 65536, 32
#: Bytes of the vectors of a shard as doubles; with the graph it stays far below the 2 GB that one value may have.
MOST_BYTES = 1 << 29
LINKS = 16
NEAREST = 96
BEAM = 128
#: Queries that meet a shard in one row, and those of them that are searched together.
BLOCK, STEP = 16384, 256


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, dim, v`` of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where("vec_id is not null").select("vec_id", F.size(v).alias("dim"), v.alias("v")).where(F.col("v").isNotNull() & sound)


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``dim, v, ids``: each vector once with its ``k + 1`` smallest ids."""
    first = F.row_number().over(Window.partitionBy("dim", "v").orderBy("vec_id"))
    few = rows.withColumn("n", first).where(F.col("n") <= k + 1)
    return few.groupBy("dim", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


# -- a shard's graph -----------------------------------------------------------------------------


def _lifted(x: np.ndarray) -> np.ndarray:
    norms = (x * x).sum(1)
    return np.hstack([x, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]]).astype(np.float32)


def spread_choice(i: int, near: np.ndarray, x: np.ndarray, d: np.ndarray, most: int) -> list[int]:
    """Of ``near`` (nearest first) those that are nearer to ``i`` than to any chosen before; then the nearest left out."""
    between = 2 - 2 * (x[near] @ x[near].T)
    chosen: list[int] = []
    free = np.ones(len(near), bool)
    for j in range(len(near)):
        if free[j]:
            chosen.append(j)
            if len(chosen) == most:
                break
            free &= between[j] > d
    if len(chosen) < most:
        chosen += [j for j in range(len(near)) if j not in set(chosen)][: most - len(chosen)]
    return [int(near[j]) for j in chosen]


def linked(x: np.ndarray, links: int, nearest: int) -> np.ndarray:
    """Neighbour slots of each row of ``x`` (unit vectors); row by row, as if inserted in order."""
    n, most = len(x), 2 * links
    slots: list[list[int]] = [[] for _ in range(n)]
    for low in range(0, n, 512):
        high = min(n, low + 512)
        inner = x[low:high] @ x[:high].T
        for i in range(low, high):
            before = inner[i - low, :i]
            if not i:
                continue
            near = np.argpartition(-before, nearest)[:nearest] if i > nearest else np.arange(i)
            near = near[np.argsort(-before[near], kind="stable")]
            slots[i] = spread_choice(i, near, x, 2 - 2 * before[near], links)
            for j in slots[i]:
                slots[j].append(i)
                if len(slots[j]) > most:
                    own = np.array(slots[j])
                    d = 2 - 2 * (x[own] @ x[j])
                    order = np.argsort(d, kind="stable")
                    slots[j] = spread_choice(j, own[order], x, d[order], most)
    flat = np.full((n, most), -1, np.int32)
    for i, s in enumerate(slots):
        flat[i, : len(s)] = s
    return flat


def build(x: np.ndarray, links: int = LINKS, nearest: int = NEAREST) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Unit vectors, and the nodes and neighbour slots of each layer, lowest first."""
    y = _lifted(x)
    y /= np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-30)
    draw = np.random.default_rng(len(x)).random(len(x))
    level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(links)).astype(int)
    nodes, slots = [], []
    for layer in range(int(level.max(initial=0)) + 1):
        here = np.flatnonzero(level >= layer)
        nodes.append(here.astype(np.int32))
        slots.append(linked(y[here], links, nearest))
    return y, nodes, slots


def search(y: np.ndarray, nodes: list[np.ndarray], slots: list[np.ndarray], q: np.ndarray, k: int, beam: int) -> np.ndarray:
    """For each row of ``q`` the positions of ``k`` near nodes (-1: none), nearest first."""
    m = len(q)
    at = np.zeros(m, np.int64)  # a position in the layer
    for layer in range(len(nodes) - 1, 0, -1):
        here = y[nodes[layer]]
        score = (here[at] * q).sum(1)
        while True:
            near = slots[layer][at]
            met = np.where(near >= 0, np.einsum("mld,md->ml", here[np.maximum(near, 0)], q), -np.inf)
            best = met.argmax(1)
            top = met[np.arange(m), best]
            better = top > score
            if not better.any():
                break
            at = np.where(better, near[np.arange(m), best], at)
            score = np.where(better, top, score)
        below = np.searchsorted(nodes[layer - 1], nodes[layer][at])
        at = below
    n, width = len(y), min(max(beam, k), len(y))
    seen = np.zeros((m, n), bool)
    rows = np.arange(m)
    seen[rows, at] = True
    ids = np.full((m, width), -1, np.int64)
    score = np.full((m, width), -np.inf, np.float32)
    done = np.ones((m, width), bool)
    ids[:, 0], score[:, 0], done[:, 0] = at, (y[at] * q).sum(1), False
    live = rows
    while len(live):
        open_score = np.where(done[live], -np.inf, score[live])
        pick = open_score.argmax(1)
        some = open_score[np.arange(len(live)), pick] > -np.inf
        live, pick = live[some], pick[some]
        if not len(live):
            break
        done[live, pick] = True
        near = slots[0][ids[live, pick]].astype(np.int64)
        new = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        seen[np.repeat(live, new.sum(1)), near[new]] = True
        met = np.where(new, np.einsum("mld,md->ml", y[np.maximum(near, 0)], q[live]), -np.inf)
        all_score = np.hstack([score[live], met])
        order = np.argpartition(-all_score, width - 1, axis=1)[:, :width]
        score[live] = np.take_along_axis(all_score, order, 1)
        ids[live] = np.take_along_axis(np.hstack([ids[live], np.where(new, near, -1)]), order, 1)
        done[live] = np.take_along_axis(np.hstack([done[live], ~new]), order, 1)
    order = np.argsort(-score, axis=1, kind="stable")[:, :k]
    return np.where(np.take_along_axis(score, order, 1) > -np.inf, np.take_along_axis(ids, order, 1), -1)


# -- as tables -----------------------------------------------------------------------------------

_INDEX = "shard long, dim int, layers array<int>, nodes binary, slots binary, unit binary, vectors binary, ids array<array<long>>"


def build_index(vectors: DataFrame, shards: int) -> DataFrame:
    """One row per shard of ``dim, v, ids``: the graph as flat arrays."""

    def make(part: pa.Table) -> pa.Table:
        dim = part["dim"][0].as_py()
        x = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        order = np.lexsort(x.T)  # the same graph however rows arrive
        order = order[np.random.default_rng(dim).permutation(len(order))]
        x = np.ascontiguousarray(x[order])
        y, nodes, slots = build(x)
        row = {"shard": part["shard"][0].as_py(), "dim": dim, "layers": [len(a) for a in nodes], "nodes": np.concatenate(nodes).tobytes(), "slots": np.concatenate(slots).tobytes(), "unit": y.tobytes(), "vectors": x.tobytes(), "ids": part["ids"].take(pa.array(order)).to_pylist()}
        return pa.Table.from_pylist([row], schema)

    schema = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("layers", pa.list_(pa.int32())), *((n, pa.binary()) for n in ("nodes", "slots", "unit", "vectors")), ("ids", pa.list_(pa.list_(pa.int64())))])
    spread = vectors.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("long"))
    return spread.groupBy("dim", "shard").applyInArrow(make, _INDEX)


def search_index(index: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all shards for each row ``query_id, dim, v`` of ``queries``."""

    def look(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # one at a time, as each holds a whole shard
                [row] = batch.slice(i, 1).to_pylist()
                dim, sizes = row["dim"], row["layers"]
                cut = np.cumsum(sizes)[:-1]
                nodes = np.split(np.frombuffer(row["nodes"], np.int32), cut)
                slots = np.split(np.frombuffer(row["slots"], np.int32).reshape(-1, 2 * LINKS), cut)
                y = np.frombuffer(row["unit"], np.float32).reshape(-1, dim + 1)
                x = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
                asked = np.array([x["v"] for x in row["queries"]], np.float64)
                q = np.hstack([asked, np.zeros((len(asked), 1))]).astype(np.float32)
                found = (hits for at in range(0, len(q), STEP) for hits in search(y, nodes, slots, q[at : at + STEP], k + 1, beam))
                out: list[list] = [[], [], []]
                for query, v, hits in zip((x["query_id"] for x in row["queries"]), asked, found):
                    hits = hits[hits >= 0]
                    exact = (x[hits] * v).sum(1)
                    for h, s in zip(hits.tolist(), exact.tolist()):
                        mine = [i for i in row["ids"][h] if i != query]
                        out[0] += [query] * len(mine)
                        out[1] += mine
                        out[2] += [s] * len(mine)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    blocks = -(-queries.count() // block) or 1
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    held = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "v")).alias("queries"))
    # each side is dealt by shard and block, so that no key has more than one shard and one block of queries
    there = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = held.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    met = there.join(asked, ["dim", "shard", "block"]).mapInArrow(look, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, shard_rows: int | None = None, beam: int = BEAM) -> DataFrame:
    """The ``k`` nearest of each row whose id is divisible by ``every``, among all other rows."""
    rows = usable(vectors)
    distinct = stored(distinct_vectors(rows, k), "ann-vectors")
    n = distinct.count()
    widest = distinct.agg(F.max("dim")).first()[0] or 1
    most = max(1, min(MOST_ROWS, MOST_BYTES // (8 * widest)))
    shards = max(1, -(-n // (shard_rows or min(most, max(LEAST_ROWS, int(ROOT_ROWS * n**0.5))))))
    index = stored(build_index(distinct, shards), "ann-index")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("dim", "v")).alias("q"))
    return search_index(index, stored(queries.select("query_id", "q.dim", "q.v"), "ann-queries"), k, beam)
