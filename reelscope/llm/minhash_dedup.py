"""Near-duplicate documents by b-bit MinHash.

1. Each text becomes its set of word shingles, ``bands * rows`` minima over random functions of them, a key for each band
   of ``rows`` minima, and a signature that packs the low four bits of each minimum. Texts with equal sets are one node.
2. Nodes that share a band key are candidates. A bucket proposes links to one of its members, never all its pairs: first
   to its smallest id, then, where it still holds several components, to a member drawn anew for each bucket.
3. A proposed pair is estimated from its signatures by counting equal bits, corrected for the 1 in 16 that agree by
   chance; those ``slack`` standard errors below the threshold go, all others are confirmed on their full sets.
4. What is left: nodes of buckets that still hold several components. Their shingles are ordered, the rarest among these
   nodes first; two sets of the wanted similarity must share one of the first few (``prefix``), so every pair across
   components that shares one is proposed. A passage that very many of them hold comes last in that order, and how
   far down the first shared shingle stands bounds what two sets can share, so it does not pair them all. Pairs within one component, which cannot change a result, are skipped: each proposed pair has a
   member outside the shingle's largest component.

Joins by a band key, by a shingle, by the centre of a star or by a set of very many copies deal its rows out over copies of
what they are joined with (``dealt_join``), so that no task holds a hot one; the text of a centre is fetched once for many
of its pairs.

With 30 bands of 5 rows a pair of similarity 0.8 shares no band once in 150,000 times, one of 0.85 once in ten million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.llm import hashing as H
from reelscope.llm.components import components
from reelscope.llm.shared import dealt_join, part_of, small_batches, written

_SKETCH = "doc_id long, part binary, n_shingles long, set_a long, set_b long, signature binary, bands array<bigint>"
#: Shingles that are hashed by all functions at once.
_PART = 2048


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = H.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return (r[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (r[n:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(batch: pa.RecordBatch, k: int, column: str = "text") -> Iterator[np.ndarray]:
    """For each row, the sorted distinct hashes of its ``k``-word shingles; of all its words if they are fewer."""
    buf, offsets = H.texts(batch.column(batch.schema.get_field_index(column)))
    start, _, h = H.words(buf, H.BLANK, H.LOWER)
    row = H.by_row(start, offsets)
    for a, b in zip(row[:-1].tolist(), row[1:].tolist(), strict=True):
        if a == b:
            yield np.zeros(0, dtype=np.uint64)
        else:
            yield np.unique(H.ngrams(h[a:b], min(k, b - a)) + np.uint64(min(k, b - a)))


def _minima(s: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    low = np.full(len(mul), 0xFFFFFFFF, dtype=np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    for at in range(0, len(x), _PART):
        np.minimum(low, (mul[:, None] * x[None, at : at + _PART] + add[:, None]).min(axis=1), out=low)
    return low


def _sketch(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = _functions(bands * rows)
        name = np.arange(1, bands + 1, dtype=np.uint64)
        for whole in batches:
            for batch in H.blocks(whole):
                n, a, b, packed, keys = [], [], [], [], []
                for s in shingle_sets(batch, k):
                    n.append(len(s))
                    a.append(int(H.mix(s).sum(dtype=np.uint64).view(np.int64)))
                    b.append(int(H.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                    if len(s):
                        low = _minima(s, mul, add)
                        bits = (low & np.uint32(15)).astype(np.uint8)
                        packed.append((bits[0::2] | (bits[1::2] << 4)).tobytes())
                        grid = low.astype(np.uint64).reshape(bands, rows)
                        key = H.mix(name)
                        for j in range(rows):
                            key = H.mix(key ^ grid[:, j])
                        keys.append(key.view(np.int64))
                    else:
                        packed.append(b"")
                        keys.append(np.zeros(0, dtype=np.int64))
                size = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("part")), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(packed, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))),
                    ],
                    names=["doc_id", "part", "n_shingles", "set_a", "set_b", "signature", "bands"],
                )

    return run


def _listed(k: int):
    """node, component, number of shingles, and each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in H.blocks(whole):
                sets = list(shingle_sets(batch, k))
                n = np.array([len(x) for x in sets], dtype=np.int64)
                of = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(of), batch.column(1).take(of), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))],
                    names=["node", "component", "n", "shingle"],
                )

    return run


_BITS = np.array([(i & 15 == 0) + (i >> 4 == 0) for i in range(256)], dtype=np.uint8)


def _estimated(hashes: int, least: float):
    """Pairs whose corrected share of equal four-bit values reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(batch.column(i).cast(pa.binary()).buffers()[2], dtype=np.uint8, count=batch.num_rows * hashes // 2, offset=batch.column(i).buffers() and batch.column(i).offset * hashes // 2).reshape(batch.num_rows, -1) for i in (2, 3))
            share = _BITS[a ^ b].sum(axis=1) / hashes
            keep = (share - 1 / 16) / (1 - 1 / 16) >= least
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])

    return run


def _confirmed(k: int, percent: int):
    """Pairs whose full sets reach the similarity: 100 * shared >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray | None] = (None, None)
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                text = one.column(2)[0].as_py()
                if text != last[0]:
                    last = (text, next(shingle_sets(one, k, "text_b")))
                t, s = last[1], next(shingle_sets(one, k, "text_a"))
                shared = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(shared > 0 and 100 * shared >= percent * (len(s) + len(t) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(mask) for i in (0, 1)], names=["a", "b"])

    return run


def minhash_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 30, rows: int = 5, slack: float = 5.0, exact: bool = False) -> DataFrame:
    """Near-duplicate components: doc_id, part (128 bits of the text), n_shingles (set size), group (a number of the
    component, null without shingles), component_id (smallest doc_id reachable), kept.

    ``docs`` needs doc_id and text; other columns are ignored. Words part at space and controls 9 to 13, A-Z count as
    lower case. Two documents link if 100 * shared shingles >= percent * all shingles of both, confirmed on full sets.

    One row for each input row. Null, empty and blank texts have no shingles and link with nothing: component_id is
    their own doc_id and they are kept. A row without doc_id takes no part: component_id null, kept. Rows that repeat a
    doc_id are judged by their own texts, and told apart by ``part``. An empty table gives an empty result.

    A pair just at the threshold shares no band, or falls under the estimate's slack, once in some 100,000 times. With
    ``exact`` the prefix join starts from the sets of all documents, not those of unsettled buckets, and finds every one.
    """
    hashes = bands * rows
    if hashes % 2:
        raise ValueError("bands * rows must be even, as two values share a byte")
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part_of(text).alias("part"), text.alias("text"))
    seen = written(docs.mapInArrow(_sketch(shingle, bands, rows), _SKETCH), "sketches")
    sets = seen.where("n_shingles > 0 and doc_id is not null")
    # A node for each distinct set, with its smallest document. A doc_id may have several sets, so nodes have numbers of
    # their own, in the order of their documents: the smallest node of a bucket is then its first document.
    of_set = ["set_a", "set_b", "n_shingles"]
    nodes = sets.groupBy(*of_set).agg(F.min(F.struct("doc_id", "part", "signature", "bands")).alias("x"), F.count(F.lit(1)).alias("copies"))
    nodes = nodes.select(*of_set, "copies", F.col("x.doc_id").alias("low"), F.col("x.part").alias("part"), "x.signature", "x.bands")
    nodes = written(nodes.orderBy("low", *of_set).withColumn("node", F.monotonically_increasing_id()), "nodes")
    spread = nodes.select("node", F.explode("bands").alias("key"))
    crowded = written(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "n"), "crowded")
    entries = crowded.agg(F.sum("n")).first()[0] or 0
    # ``size`` goes with each entry of a bucket, so that later joins by key know the hot ones.
    buckets = written(dealt_join(spread, crowded.withColumn("size", F.col("n")), ["key"], entries).distinct(), "buckets")
    entries = buckets.count()
    signatures = nodes.select("node", "signature")
    of = nodes.select("node", F.col("low").alias("doc_id"), "part")
    if not exact:
        of = of.join(buckets.select("node").distinct(), "node", "left_semi")
    texts = written(docs.join(of, ["doc_id", "part"]).dropDuplicates(["node"]).select("node", "text"), "texts")
    least = percent / 100 - slack * (percent / 100 * (1 - percent / 100) / hashes) ** 0.5

    def beside(pairs: DataFrame, end: str, table: DataFrame, column: str, total: int) -> DataFrame:
        """``pairs`` with a column of the node at one end. The centre of a star is fetched once for many of its pairs."""
        often = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n"))
        ones = table.withColumnRenamed("node", end).withColumnRenamed(column, f"{column}_{end}").join(often, end)
        return dealt_join(pairs, ones, [end], total, by=["a", "b"])

    def test(pairs: DataFrame) -> DataFrame:
        total = pairs.count()
        sides = beside(beside(pairs, "a", signatures, "signature", total), "b", signatures, "signature", total)
        likely = written(sides.select("a", "b", "signature_a", "signature_b").mapInArrow(_estimated(hashes, least), "a long, b long"), "likely")
        total = likely.count()
        sides = beside(beside(likely, "a", texts, "text", total), "b", texts, "text", total)
        return sides.select("a", "b", "text_b", "text_a").mapInArrow(_confirmed(shingle, percent), "a long, b long")

    def proposed(members: DataFrame, centre) -> DataFrame:
        """Each member of a bucket with the bucket's centre, unless both are in one component already."""
        centres = members.groupBy("key").agg(F.min(centre).alias("c"), F.count(F.lit(1)).alias("n")).select("key", F.col("c.node").alias("b"), F.col("c.component").alias("its"), "n")
        pairs = dealt_join(members, centres, ["key"], entries).where("node <> b and component <> its")
        return pairs.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()

    def labelled(named: DataFrame | None) -> DataFrame:
        if named is None:
            return buckets.drop("size").withColumn("component", F.col("node"))
        found = written(buckets.join(named, "node", "left").select("key", "size", "node", F.coalesce("component", "node").alias("component")), "found")
        mixed = found.groupBy("key").agg((F.min("component") < F.max("component")).alias("mixed"), F.max("size").alias("n")).where("mixed").select("key", "n")
        return written(dealt_join(found.drop("size"), mixed, ["key"], entries), "mixed")

    def remaining(members: DataFrame) -> DataFrame:
        """Every pair across components that the rarest shingles of two sets propose."""
        unsettled = texts.join(members, "node").select("node", "component", "text")
        rows = written(unsettled.mapInArrow(_listed(shingle), "node long, component long, n long, shingle long"), "shingles")
        many = written(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequencies")
        # A shingle that stands in one set alone joins nothing: it keeps its place in the order and is dropped.
        ranked = dealt_join(rows, many.withColumn("n_of", F.col("df")), ["shingle"], rows.count(), "n_of", "left", ["node"])
        ranked = ranked.groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "shingle"))).alias("x"))
        prefix = F.expr(f"CAST(n - ceil({percent} * n / 100.0) + 1 AS int)")
        heads = ranked.select("node", "component", "n", F.posexplode(F.slice("x", F.lit(1), prefix)).alias("pos", "y"))
        heads = written(heads.where("y.df > 1").select("node", "component", "n", "pos", F.col("y.shingle").alias("shingle")), "heads")
        each = heads.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n"))
        most = each.groupBy("shingle").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("components"), F.sum("n").alias("n")).where("components > 1").drop("components")
        most = written(most, "most")
        told = dealt_join(heads.withColumnRenamed("n", "size"), most, ["shingle"], heads.count(), by=["node"]).withColumnRenamed("size", "n")
        outside = told.where("component <> most").select("shingle", F.col("node").alias("x"), F.col("component").alias("its"), F.col("n").alias("nx"), F.col("pos").alias("px"), "most")
        # The first shingle that two sets share bounds what they can share from there on.
        room = f"{100 + percent} * (1 + least(n - 1 - pos, nx - 1 - px)) >= {percent} * (n + nx)"
        pairs = outside.join(heads, "shingle").where(f"component <> its and (component = most or x > node) and {room}")
        return pairs.select(F.greatest("x", "node").alias("a"), F.least("x", "node").alias("b")).distinct()

    tested = links = named = None
    for centre in (F.struct("node", "component"), F.struct(F.xxhash64("key", "node"), "node", "component"), None):
        if centre is None and exact:
            every = nodes.select("node")
            members = every.withColumn("component", F.col("node")) if named is None else every.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        else:
            members = labelled(named)
            if named is not None and not members.take(1):
                if exact:
                    continue
                break
        pairs = remaining(members.select("node", "component").distinct()) if centre is None else proposed(members, centre)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        if not pairs.take(1):  # every bucket drew a centre it had before
            continue
        found = written(test(pairs), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        named = components(links)
    of = nodes.select(*of_set, "copies", "node", "low")
    if named is None:
        of = of.withColumn("group", F.col("node")).withColumn("component", F.col("low"))
    else:
        of = of.join(named, "node", "left").withColumn("group", F.coalesce("component", "node"))
        least_doc = of.where("component is not null").groupBy("component").agg(F.min("low").alias("least_doc"), F.count(F.lit(1)).alias("n"))
        of = dealt_join(of, written(least_doc, "least"), ["component"], nodes.count(), how="left", by=["node"]).withColumn("component", F.coalesce("least_doc", "low"))
    of = written(of.select(*of_set, "copies", "group", "component"), "named")
    mine = F.col("n_shingles") > 0
    out = seen.select("doc_id", "part", "n_shingles", *[F.when(mine & F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("set_a", "set_b")])
    out = dealt_join(out, of, of_set, seen.count(), "copies", "left", ["doc_id", "part"])
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "part", "n_shingles", "group", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
