"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Tiles travel as int8 codes with a scale and an error bound for each vector.
Products of codes settle almost every pair; only vectors of pairs that the
bounds leave open travel in full and are compared in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_batches, stage
from .links import Forest, components

THRESHOLD = 0.95
TILE_ROWS = 8192
#: Rows of a tile that are multiplied at once, and pairs recomputed at once.
CHUNK_ROWS = 512
CHUNK_PAIRS = 65_536
#: Float32 rounding of the scaled integer products, far above its true size.
SLACK = 1e-5


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and norm of the quantisation error of each row of unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes, scale, error


class Codes:
    """Codes of a tile's unit vectors: q, and in single precision scale s and a bound t of what the error adds to a product.

    With x = s q + e, a.b differs from s_a s_b (q_a.q_b) by at most
    |e_a| + |e_b| + |e_a||e_b|, hence by at most t_a + t_b where
    t = |e| + |e|^2 / 2. What a pair is found to be depends on its own two
    rows only, whatever tile they are in.
    """

    def __init__(self, q: np.ndarray, s: np.ndarray, t: np.ndarray):
        self.q, self.s, self.t = q, s.astype(np.float32), t.astype(np.float32)

    @classmethod
    def of(cls, x: np.ndarray) -> Codes:
        q, s, e = quantise(x)
        return cls(q, s, e + e * e / 2)


def pairs(a: Codes, b: Codes, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Positions (i, j) of pairs that surely reach the threshold, and (k, l) of those that may, chunk by chunk.

    Codes are multiplied as float32, which is exact while dimensions x 127^2
    < 2^24, and as float64 beyond.
    """
    exact = np.float32 if a.q.shape[1] * 127**2 < 2**24 else np.float64
    qb = np.ascontiguousarray(b.q.T).astype(exact)
    for at in range(0, len(a.q), CHUNK_ROWS):
        rows = slice(at, at + CHUNK_ROWS)
        product = (a.q[rows].astype(exact) @ qb).astype(np.float32, copy=False)
        product *= b.s
        product *= a.s[rows, None]
        product += b.t
        i, j = np.nonzero(product >= (threshold - SLACK - a.t[rows]).astype(np.float32)[:, None])
        sure = product[i, j] - 2 * b.t[j] - a.t[i + at] >= threshold + SLACK
        i = i + at
        yield i[sure], j[sure], i[~sure], j[~sure]


class Found:
    """Linked copies of each vector of a tile pair, and a spanning forest of the links."""

    def __init__(self, copies_a: np.ndarray, copies_b: np.ndarray | None):
        self.same = copies_b is None
        self.copies_a, self.copies_b = copies_a, copies_a if self.same else copies_b
        self.n_a, n_b = len(copies_a), 0 if self.same else len(copies_b)
        self.degree, self.forest = np.zeros(self.n_a + n_b), Forest(self.n_a + n_b)

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        if self.same:
            p, q = p[p != q], q[p != q]
            self.degree += np.bincount(p, self.copies_b[q], len(self.degree))
        else:
            self.degree[: self.n_a] += np.bincount(p, self.copies_b[q], self.n_a)
            self.degree[self.n_a :] += np.bincount(q, self.copies_a[p], len(self.copies_b))
        self.forest.link(p, q if self.same else q + self.n_a)

    def rows(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(u, v, n): n links of u where u = v, else a link of the forest."""
        child, root = self.forest.edges()
        some = np.flatnonzero(self.degree)
        return np.concatenate([nodes[some], nodes[child]]), np.concatenate([nodes[some], nodes[root]]), np.concatenate([self.degree[some], np.zeros(len(child))]).astype(np.int64)


def _tile(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, Codes]:
    nodes, copies = (np.frombuffer(row[f"{side}_{k}"], np.int64) for k in ("nodes", "copies"))
    s, t = (np.frombuffer(row[f"{side}_{k}"], np.float32) for k in ("scale", "bound"))
    return nodes, copies, Codes(np.frombuffer(row[f"{side}_codes"], np.int8).reshape(len(nodes), -1), s, t)


LINKS = "i int, j int, dim int, u long, v long, n long"


def _settle(batch: pa.RecordBatch, threshold: float) -> pa.RecordBatch:
    """Per tile pair: what surely links; and with n = -1 vectors (u, of side v) of pairs that are still open."""
    out: list[tuple] = []
    for row in batch.to_pylist():
        nodes_a, copies_a, a = _tile(row, "a")
        same = row["i"] == row["j"]
        nodes_b, copies_b, b = (nodes_a, None, a) if same else _tile(row, "b")
        found, open_a, open_b = Found(copies_a, copies_b), np.zeros(len(nodes_a), bool), np.zeros(len(nodes_b), bool)
        for p, q, k, m in pairs(a, b, threshold):
            found.add(p, q)
            if same:
                k, m = k[k != m], m[k != m]
            open_a[k] = open_b[m] = True
        u, v, n = found.rows(nodes_a if same else np.concatenate([nodes_a, nodes_b]))
        for side, nodes in ((0, nodes_a[open_a]), (1, nodes_b[open_b])):
            if side == 0 or not same:
                u, v, n = np.append(u, nodes), np.append(v, np.full(len(nodes), side)), np.append(n, np.full(len(nodes), -1))
        out.append((np.full(len(u), row["i"]), np.full(len(u), row["j"]), np.full(len(u), row["dim"]), u, v, n))
    columns = [np.concatenate(c) if out else np.zeros(0) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 6
    kinds = (pa.int32(),) * 3 + (pa.int64(),) * 3
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64), k) for c, k in zip(columns, kinds, strict=True)], ["i", "j", "dim", "u", "v", "n"])


def _recompute(rows: pa.Table, threshold: float) -> pa.Table:
    """Links of a tile pair's open pairs, in double precision; what is sure was counted before."""
    side, node, copies = (rows[c].to_numpy().astype(np.int64) for c in ("side", "node", "copies"))
    x = unit(np.array(rows["embedding"].to_pylist(), np.float64))
    same = rows["i"][0].as_py() == rows["j"][0].as_py()
    order = np.lexsort((node, side))
    side, node, copies, x = side[order], node[order], copies[order], x[order]
    cut = len(node) if same else int((side == 0).sum())
    a, b = (x, x) if same else (x[:cut], x[cut:])
    found = Found(copies[:cut], None if same else copies[cut:])
    for _, _, k, m in pairs(Codes.of(a), Codes.of(b), threshold):
        for at in range(0, len(k), CHUNK_PAIRS):
            p, q = k[at : at + CHUNK_PAIRS], m[at : at + CHUNK_PAIRS]
            hit = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
            found.add(p[hit], q[hit])
    u, v, n = found.rows(node)
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})


def _pack(rows: pa.Table) -> pa.Table:
    """A tile's codes."""
    rows = rows.sort_by("node")
    codes = Codes.of(unit(np.array(rows["embedding"].to_pylist(), np.float64)))
    binary = lambda x: pa.array([x.tobytes()], pa.binary())
    whole = [rows["node"].to_numpy().astype(np.int64), rows["copies"].to_numpy().astype(np.int64), codes.q, codes.s, codes.t]
    return pa.table({"tile": rows["tile"][:1].cast(pa.int32()), "dim": rows["dim"][:1].cast(pa.int32()), **{k: binary(x) for k, x in zip(("nodes", "copies", "codes", "scale", "bound"), whole, strict=True)}})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links all vectors with cosine >= threshold: (vec_id, n_links, component_id, kept), one row per input row.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and vectors of other lengths, link with nothing; without a link a row's
    component_id is its own vec_id. Rows that repeat a vec_id are vectors of
    their own. Rows without a vec_id take part under no name: their
    component_id is that of what they link with, or null, and kept is false.
    Other columns are not read. An empty table gives an empty result.

    Exact copies are one representative with a multiplicity, so a group of
    copies costs no pairs. Representatives are hashed into tiles; every pair
    of tiles is compared once in a task of its own. A task returns link
    counts, a spanning forest and the vectors that open pairs need, never the
    pairs themselves, so what leaves it is bounded by the rows of its two
    tiles. The work is quadratic in distinct vectors.
    """
    rows = stage(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "vectors")
    usable = F.expr("embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    reps = rows.where(usable).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = stage(reps.withColumn("node", F.monotonically_increasing_id()), "representatives")
    g = max(1, math.ceil(reps.count() / tile_rows))

    tiled = reps.select("node", "copies", "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("node"), F.lit(g)).cast("int").alias("tile"))
    tiles = stage(tiled.groupBy("tile", "dim").applyInArrow(_pack, "tile int, dim int, nodes binary, copies binary, codes binary, scale binary, bound binary"), "tiles")
    side = lambda s, key: tiles.select(F.col("tile").alias(key), "dim", *(F.col(c).alias(f"{s}_{c}") for c in ("nodes", "copies", "codes", "scale", "bound")))
    # Every tile meets itself and the next half of the circle: each pair once, as many pairs for each tile.
    half = F.expr(f"explode(transform(sequence(0, case when {g} % 2 = 0 and i >= {g // 2} then {g // 2} - 1 else {g // 2} end), d -> cast((i + d) % {g} as int)))")
    left = side("a", "i").select("*", half.alias("j"))
    right = side("b", "j").withColumn("i", F.expr(f"explode(filter(transform(sequence(0, {g // 2}), d -> cast((j - d + {g}) % {g} as int)), (i, d) -> {g} % 2 = 1 or d < {g // 2} or i < {g // 2}))"))
    met = left.join(right, ["i", "j", "dim"])
    settled = stage(map_batches(met, lambda batch: _settle(batch, threshold), LINKS), "links")
    open_ = settled.where("n < 0").select("i", "j", "dim", F.col("u").alias("node"), F.col("v").alias("side")).join(reps.select("node", "copies", "embedding"), "node")
    again = open_.groupBy("i", "j", "dim").applyInArrow(lambda table: _recompute(table, threshold), "u long, v long, n long")
    found = stage(settled.where("n >= 0").select("u", "v", "n").unionByName(again), "links")

    degree = found.where("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("linked"))
    component = components(found.where("u <> v").select("u", "v"))
    known = reps.join(degree, "node", "left").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = stage(known.select("embedding", "rep", "component", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = stage(known.join(least, "component").select("embedding", "n_links", "component_id"), "known")
    linked = rows.where(usable).join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
), link as (
  select a.vec_id as u, b.vec_id as v from v a join v b
    on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95
), reach(u, v) as (
  select vec_id, vec_id from v
  union
  select r.u, l.v from reach r join link l on r.v = l.u
), n as (select u, count(*) as n_links from link group by u)
select v.vec_id, coalesce(n.n_links, 0)::bigint as n_links, c.component_id, v.vec_id = c.component_id as kept
from v join (select u, min(v) as component_id from reach group by u) c on c.u = v.vec_id
left join n on n.u = v.vec_id
"""
