"""Approximate nearest neighbours: one navigable small-world graph per shard, results of the shards merged.

Vectors are dealt to shards of about SHARD_ROWS by a hash of their id, whatever their values. Each shard's graph has
layers: every vector is in the lowest one, a share 1/LINKS of them in the next, and so on; a layer links each vector to
near ones that lie in different directions. Graphs are stored as flat arrays, one row per shard, in the shared folder: a
shard is built once and searched by any number of query blocks. A search walks down the layers and widens to BREADTH
candidates in the lowest; the distances of what it returns are exact, in double precision on the stored vectors. Inside a graph vectors are centred and scaled, so neither their offset nor their size matters.

Every query visits every shard, in blocks of QUERY_BLOCK queries, and brings back its few nearest per shard.

Equal vectors are one node with their smallest ids (no more than can be among the nearest), so that thousands of equal
vectors neither cut the graph into cliques nor land in one task. Vectors that are null, empty, zero, or hold a null or
non-finite component take no part, neither do rows with a null id; vectors of different length are not compared.
Repeated rows count once. With fewer candidates than `k` all are returned; an empty table gives no row.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colforge.llm.common import materialize, prepare

LINKS = 12
LINKS_BELOW = 24
BUILD_BREADTH = 64
BREADTH = 256
SHARD_ROWS = 16384
QUERY_BLOCK = 2048
FAR = 1e15


class Graph:
    """Layers of links as arrays of LINKS (lowest layer: LINKS_BELOW) columns, -1 where there is none."""

    def __init__(self, x: np.ndarray):
        # Centred and scaled in double precision, so that float32 keeps what tells vectors far from the origin apart.
        self.size = float(np.abs(x).max()) if x.size else 1.0
        scaled = x.astype(np.float64) / self.size
        self.middle = scaled.mean(0) if len(x) else 0.0
        scaled -= self.middle
        self.spread = float(np.abs(scaled).max()) if x.size else 1.0
        self.spread = self.spread or 1.0
        self.x = (scaled / self.spread).astype(np.float32)
        self.layers: list[np.ndarray] = []
        self.entry = -1
        self._seen = np.zeros(len(x), np.int64)
        self._stamp = 0

    def place(self, v: np.ndarray) -> np.ndarray:
        """A vector in the coordinates of the graph; from farther than FAR of them only its direction tells."""
        with np.errstate(over="ignore"):
            return np.clip((v / self.size - self.middle) / self.spread, -FAR, FAR).astype(np.float32)

    def _distance(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances, from differences: nothing cancels, however far apart the clusters are."""
        apart = self.x[at] - q
        return np.einsum("ij,ij->i", apart, apart)

    def _descend(self, q: np.ndarray, at: int, layer: int) -> int:
        """The nearest vector that greedy steps reach."""
        links, here = self.layers[layer], float(self._distance(q, np.array([at]))[0])
        while True:
            near = links[at]
            near = near[near >= 0]
            if not len(near):
                return at
            d = self._distance(q, near)
            k = int(d.argmin())
            if d[k] >= here:
                return at
            at, here = int(near[k]), float(d[k])

    def _around(self, q: np.ndarray, at: int, layer: int, breadth: int) -> list[tuple[float, int]]:
        """Up to `breadth` near vectors, nearest first."""
        self._stamp += 1
        links, seen, stamp = self.layers[layer], self._seen, self._stamp
        d = float(self._distance(q, np.array([at]))[0])
        seen[at] = stamp
        ahead, found = [(d, at)], [(-d, at)]
        while ahead:
            d, at = heapq.heappop(ahead)
            if len(found) >= breadth and d > -found[0][0]:
                break
            near = links[at]
            near = near[near >= 0]
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            dist = self._distance(q, near)
            if len(found) >= breadth:
                closer = dist < -found[0][0]
                near, dist = near[closer], dist[closer]
            for e, n in zip(dist.tolist(), near.tolist()):
                if len(found) < breadth:
                    heapq.heappush(found, (-e, n))
                elif e < -found[0][0]:
                    heapq.heapreplace(found, (-e, n))
                else:
                    continue
                heapq.heappush(ahead, (e, n))
        return sorted((-d, n) for d, n in found)

    def _choose(self, distances: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
        """Of vectors sorted by distance, those nearer to the centre than to any chosen one; then the nearest others."""
        if len(at) <= most:
            return at
        x = self.x[at]
        nearest, chosen, rest = np.full(len(at), np.inf, np.float32), [], []
        for k in range(len(at)):
            if distances[k] < nearest[k]:
                chosen.append(k)
                if len(chosen) == most:
                    break
                apart = x - x[k]
                np.minimum(nearest, np.einsum("ij,ij->i", apart, apart), out=nearest)
            else:
                rest.append(k)
        return at[chosen + rest[: most - len(chosen)]]

    def build(self, levels: np.ndarray) -> Graph:
        self.layers = [np.full((len(self.x), LINKS_BELOW if k == 0 else LINKS), -1, np.int32) for k in range(int(levels.max()) + 1 if len(levels) else 0)]
        top = -1
        for node, level in enumerate(levels.tolist()):
            q, at = self.x[node], self.entry
            for layer in range(top, level, -1):
                at = self._descend(q, at, layer)
            for layer in range(min(top, level), -1, -1):
                found = self._around(q, at, layer, BUILD_BREADTH)
                at = found[0][1]
                near = np.array([n for _, n in found])
                chosen = self._choose(np.array([d for d, _ in found]), near, LINKS)
                links = self.layers[layer]
                links[node, : len(chosen)] = chosen
                for other in chosen.tolist():
                    row = links[other]
                    free = np.flatnonzero(row < 0)
                    if len(free):
                        row[free[0]] = node
                        continue
                    rivals = np.append(row, node)
                    d = self._distance(self.x[other], rivals)
                    order = np.argsort(d, kind="stable")
                    row[:] = self._choose(d[order], rivals[order], len(row))
            if level > top:
                top, self.entry = level, node
        return self

    def search(self, q: np.ndarray, k: int, breadth: int) -> np.ndarray:
        at = self.entry
        for layer in range(len(self.layers) - 1, 0, -1):
            at = self._descend(q, at, layer)
        return np.array([n for _, n in self._around(q, at, 0, max(breadth, k))[: 2 * k + 8]])


def _euclid(apart: np.ndarray) -> np.ndarray:
    """Lengths in double precision; where squares leave its range, of the scaled differences."""
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.sqrt((apart**2).sum(1))
        most = np.abs(apart).max(1)
        beyond = np.isinf(length) & np.isfinite(most)
        length[beyond] = most[beyond] * np.sqrt(((apart[beyond] / most[beyond, None]) ** 2).sum(1))
    return length


def _levels(ids: np.ndarray) -> np.ndarray:
    """Layer of each vector, from a hash of its id: the same graph on every retry."""
    chance = np.array([(xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True)) + 1) / 2.0**64 for i in ids])
    return np.floor(-np.log(chance) / np.log(LINKS)).astype(int)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v of the rows that take part, each once."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).distinct()


def build_index(rows: DataFrame, members: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: dim, shard, entry, ids, x and the layers' links as flat arrays. `members` names the classes."""
    classes = members.where("vec_id = class_id").join(rows, "vec_id").select("class_id", "v")
    classes = materialize(classes)
    shards = max(1, -(-classes.count() // shard_rows))
    dealt = classes.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("class_id"), F.lit(shards)).cast("int").alias("shard"), "class_id", "v")
    double = "double" in dict(rows.dtypes)["v"]

    def build(part: pa.Table) -> pa.Table:
        part = part.sort_by("class_id")
        ids = part["class_id"].to_numpy()
        x = part["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        graph = Graph(x).build(_levels(ids))
        links = [layer.astype("<i4").tobytes() for layer in graph.layers]
        return pa.table(
            {
                "dim": pa.array([part["dim"][0].as_py()], pa.int32()),
                "shard": pa.array([part["shard"][0].as_py()], pa.int32()),
                "shards": pa.array([shards], pa.int32()),
                "entry": pa.array([graph.entry], pa.int32()),
                "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                "x": pa.array([x.astype("<f8" if double else "<f4").tobytes()], pa.binary()),
                "links": pa.array([links], pa.list_(pa.binary())),
            }
        )

    return materialize(dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, shards int, entry int, ids binary, x binary, links array<binary>"))


def search(index: DataFrame, queries: DataFrame, k: int, breadth: int = BREADTH) -> DataFrame:
    """(query_id, class_id, score): the k nearest classes per query and shard. `queries`: query_id, v."""
    total = queries.count()
    shards = index.agg(F.max("shards")).first()[0] or 0
    blocks = max(1, -(-total // QUERY_BLOCK))
    asked = queries.select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(max(shards, 1) - 1))).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "v")
    spread = index.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "entry", "ids", "x", "links")
    double = "double" in dict(queries.dtypes)["v"]

    def walk(_key, stored: pa.Table, asked: pa.Table) -> pa.Table:
        out = ([], [], [])
        if stored.num_rows and asked.num_rows:
            row = stored.slice(0, 1).to_pylist()[0]
            ids = np.frombuffer(row["ids"], "<i8")
            x = np.frombuffer(row["x"], "<f8" if double else "<f4").reshape(len(ids), -1)
            graph = Graph(x)
            graph.entry = row["entry"]
            graph.layers = [np.frombuffer(b, "<i4").reshape(len(ids), -1) for b in row["links"]]
            for query, v in zip(asked["query_id"].to_pylist(), asked["v"].to_pylist()):
                q = np.array(v, np.float64)
                at = graph.search(graph.place(q), k, breadth)
                score = _euclid(x[at].astype(np.float64) - q)
                best = np.lexsort((ids[at], score))[:k]
                out[0].extend([query] * len(best))
                out[1].extend(ids[at][best].tolist())
                out[2].extend(score[best].tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "class_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    keys = ["dim", "shard", "block"]
    return spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(walk, "query_id long, class_id long, score double")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, breadth: int = BREADTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row whose vec_id is divisible by `every`, among all other rows."""
    prepare(vectors.sparkSession)
    rows = materialize(usable(vectors))
    # Of equal vectors the k + 1 smallest ids: the query itself may be one. The limit works within tasks before rows move.
    alike = Window.partitionBy("v").orderBy("vec_id")
    members = rows.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1)
    members = materialize(members.withColumn("class_id", F.min("vec_id").over(Window.partitionBy("v"))).select("vec_id", "class_id"))
    index = build_index(rows, members, shard_rows)
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    found = search(index, queries, k + 1, breadth)
    found = found.join(members, "class_id").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
