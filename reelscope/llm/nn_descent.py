"""Approximate nearest neighbours: a neighbour graph by NN-descent, queries by greedy search on it.

Equal vectors are one node. Vectors of different lengths have no distance: each is searched among its own kind. The graph starts from small random-projection blocks, each compared
within. Then every round joins neighbours of neighbours: each node gathers its neighbours, and a sample of the nodes it
is a neighbour of (``sample`` of them on average, by a hash of the link), compares them with each other, and passes on
the pairs that are nearer than the farthest neighbour either has. Vectors travel whole and pairs are ranked by double
distances, so that near copies are told apart; equal distances are ranked by a hash of the pair, so that a group of
vectors all equally far from each other is linked at random and not to its smallest ids.

A query walks the graph: from its own node, or nodes drawn by hash, it expands its nearest unexpanded nodes in rounds of
joins, with exact double distances. Results list every id of the nodes found, nearest first, ties to smaller ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from reelscope.llm import hashing as H
from reelscope.llm.shared import dealt_join, small_batches, written

BLOCK = 256


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: v is double; null, zero and non-finite vectors and null ids are left out."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = "vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    return rows.where(finite)


def distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _formed(seeds: list[int], bits: int, narrow: bool):
    """node, its vector as bytes, and for each seed its length and the signs of ``bits`` random projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            length = whole.column(1).value_lengths().to_numpy()
            for n in np.unique(length):
                batch = whole.take(pa.array(np.flatnonzero(length == n)))
                v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                form = [x.tobytes() for x in v.astype("<f4" if narrow else "<f8")]
                unit = v / np.abs(v).max(axis=1, keepdims=True)
                marks = []
                for seed in seeds:
                    signs = unit @ np.random.default_rng(seed).normal(size=(n, bits)) > 0
                    marks.append((signs << np.arange(bits)).sum(axis=1).astype(np.int64) | int(n) << 32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(form, pa.binary()), pa.array(list(np.stack(marks, axis=1)), pa.list_(pa.int64()))], names=["node", "form", "marks"])

    return run


def _apart(w: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (w[i], w[j]), from their differences."""
    out = np.empty(len(i))
    for at in range(0, len(i), 8192):
        x = w[i[at : at + 8192]] - w[j[at : at + 8192]]
        out[at : at + 8192] = np.einsum("ij,ij->i", x, x)
    return out


def _compared(keep: int | None, narrow: bool):
    """Pairs within each group of (x, form, worst): those nearer than x's worst, or x's ``keep`` nearest, ties by hash.

    Products only sort out what is farther than ``worst`` whatever their rounding; the rest is measured.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, near = [], [], []
            column = batch.column(0)
            inner = column.flatten()
            ids, worst, form = inner.field(0).to_numpy(), inner.field(2).to_numpy(), inner.field(1)
            if not len(ids):
                continue
            raw = form.to_pylist()
            cut = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                x = ids[s:e]
                if len(x) < 2:
                    continue
                w = np.frombuffer(b"".join(raw[s:e]), dtype="<f4" if narrow else "<f8").reshape(len(x), -1).astype(np.float64)
                if keep is None:
                    q = (w * w).sum(axis=1)
                    both = q[:, None] + q[None, :]
                    close = both - 2 * w @ w.T - (len(w[0]) + 8) * 1e-15 * both < worst[s:e, None]
                    np.fill_diagonal(close, False)
                    i, j = np.nonzero(close)
                    d = _apart(w, i, j)
                    nearer = d < worst[s:e][i]
                    i, j, d = i[nearer], j[nearer], d[nearer]
                else:
                    i, j = (g.ravel() for g in np.indices((len(x), len(x))))
                    full = _apart(w, i, j).reshape(len(x), len(x))
                    np.fill_diagonal(full, np.inf)
                    tie = H.mix(H.mix(x.astype(np.uint64))[:, None] + x.astype(np.uint64)[None, :])
                    j = np.lexsort((tie, full), axis=1)[:, : min(keep, len(x) - 1)]
                    i = np.repeat(np.arange(len(x)), j.shape[1])
                    j = j.ravel()
                    d = full[i, j]
                a.append(x[i])
                b.append(x[j])
                near.append(d)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(near))], names=["a", "b", "d"])

    return run


_PAIRS = "a long, b long, d double"


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """node, near (its k nearest as (d, b)), worst (squared distance that a new neighbour must beat)."""
    one = pairs.groupBy("a", "b").agg(F.min("d").alias("d"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy("d", F.xxhash64("a", "b"), "b"))
    near = one.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("a").agg(F.array_sort(F.collect_list(F.struct("d", "b"))).alias("near"))
    return near.select(F.col("a").alias("node"), "near", F.when(F.size("near") < k, float("inf")).otherwise(F.element_at("near", -1)["d"]).alias("worst"))


def build(nodes: DataFrame, k: int = 24, sample: int = 24, rounds: int = 4, tables: int = 3, narrow: bool = False) -> DataFrame:
    """The graph over (node, v): node, near, worst. Every node is in it; one that stands alone has no neighbours.

    ``narrow`` says that all numbers of ``v`` are floats, so that they travel in four bytes.
    """
    n = nodes.count()
    bits = max(0, (max(n, 1) // BLOCK).bit_length())
    forms = written(nodes.select("node", "v").mapInArrow(_formed(list(range(1, tables + 1)), bits, narrow), "node long, form binary, marks array<bigint>"), "forms")
    marks = forms.select("node", "form", F.posexplode("marks").alias("table", "mark"))
    # A crowded block is dealt out by hash into blocks of about BLOCK nodes.
    counts = written(marks.groupBy("table", "mark").agg(F.count(F.lit(1)).alias("n")), "blocks").withColumn("parts", F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1)))
    dealt = dealt_join(marks, counts, ["table", "mark"], n * tables, by=["node"]).withColumn("part", F.pmod(F.xxhash64("node", "table"), F.col("parts")))
    member = lambda x: F.struct(F.col(x).alias("x"), "form", F.lit(float("inf")).alias("worst"))
    blocks = dealt.groupBy("table", "mark", "part").agg(F.collect_list(member("node")).alias("group")).select("group")
    graph = written(_nearest(blocks.mapInArrow(_compared(k, narrow), _PAIRS), k), "graph")
    for turn in range(rounds):
        links = graph.select(F.col("node").alias("u"), F.explode("near.b").alias("x"))
        degree = links.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        back = dealt_join(links, degree.withColumn("of", F.col("n")), ["x"], n * k).where(F.pmod(F.xxhash64("u", "x", F.lit(turn)), F.lit(1 << 30)) < F.lit(1 << 30) * (sample / F.col("of")))
        members = links.unionByName(back.select(F.col("x").alias("u"), F.col("u").alias("x"))).distinct()
        held = forms.select(F.col("node").alias("x"), "form").join(graph.select(F.col("node").alias("x"), "worst"), "x", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
        groups = members.join(held, "x").groupBy("u").agg(F.collect_list(F.struct("x", "form", "worst")).alias("group")).select("group")
        found = groups.mapInArrow(_compared(None, narrow), _PAIRS)
        old = graph.select(F.col("node").alias("a"), F.explode("near").alias("x")).select("a", F.col("x.b").alias("b"), F.col("x.d").alias("d"))
        graph = written(_nearest(found.unionByName(old), k), "graph")
    return graph


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, degree: int = 24, rounds: int = 4, breadth: int = 160, width: int = 64, steps: int = 6, starts: int = 32) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance): the ``k`` nearest rows found for each query.

    ``vectors`` has vec_id and embedding, ``queries`` the same columns; a query that is a row of ``vectors``, by id, does
    not find itself. Rows that ``usable`` leaves out take no part on either side. Repeated rows of a vec_id count once
    for each different vector. Fewer than ``k`` candidates are all listed. Each step expands, for each query, up to
    ``width`` of its ``breadth`` nearest nodes.
    """
    small_batches(vectors.sparkSession)
    rows = written(usable(vectors).distinct(), "vectors")
    asked = usable(queries).distinct()
    if not rows.take(1):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Equal vectors are one node, found by 128 bits of the vector and numbered in the order of their smallest ids.
    told = rows.select("vec_id", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), F.reverse("v")).alias("g"))
    nodes = rows.groupBy(F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), F.reverse("v")).alias("g")).agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    nodes = written(nodes.orderBy("low", "h", "g").withColumn("node", F.monotonically_increasing_id()), "nodes")
    of = dealt_join(told, nodes.select("h", "g", "n", "node"), ["h", "g"], rows.count()).select("vec_id", "node")
    graph = build(nodes, degree, degree, rounds, narrow=vectors.schema["embedding"].dataType.elementType == FloatType())
    asked = written(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "asked")
    own = asked.join(of.select(F.col("vec_id").alias("query_id"), "node"), "query_id").select("query_id", "node").distinct()
    # Every query also starts from nodes of its length drawn by hash, so that it need not be a row itself: at most ``starts``.
    drawn = nodes.groupBy(F.size("v").alias("length"), F.pmod(F.xxhash64("node"), F.lit(starts)).alias("place")).agg(F.min("node").alias("node")).drop("place")
    begin = own.unionByName(asked.select("query_id", F.size("q").alias("length")).distinct().join(drawn, "length").select("query_id", "node")).distinct()
    place = nodes.select("node", "v")

    def measured(pairs: DataFrame) -> DataFrame:
        both = pairs.join(place, "node").join(asked, "query_id").where("size(q) = size(v)")
        return both.groupBy("query_id", "node").agg(F.min(distance("q", "v")).alias("d")).withColumn("expanded", F.lit(False))

    seen = written(measured(begin), "seen")
    links = graph.select("node", F.col("near.b").alias("to"))
    for _ in range(steps):
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "node"))
        best = seen.withColumn("rank", rank).where(F.col("rank") <= breadth).where("not expanded")
        turn = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        front = written(best.withColumn("turn", turn).where(F.col("turn") <= width).select("query_id", "node"), "front")
        if not front.take(1):
            break
        new = front.join(links, "node").select("query_id", F.explode("to").alias("node")).distinct().join(seen, ["query_id", "node"], "left_anti")
        done = front.withColumn("now", F.lit(True))
        old = seen.join(done, ["query_id", "node"], "left").select("query_id", "node", "d", (F.col("expanded") | F.coalesce("now", F.lit(False))).alias("expanded"))
        seen = written(old.unionByName(measured(new)), "seen")
    # The k + 1 nearest nodes suffice, and the k + 1 smallest ids of each: a query may be among them.
    near = seen.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "node"))).where(F.col("at") <= k + 1)
    ids = of.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("at") <= k + 1).select("node", "vec_id")
    out = near.select("query_id", "node", "d").join(ids, "node").where("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", F.col("d").alias("score"))
