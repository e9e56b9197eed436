"""Line dedup by winnowing over line hashes, in DataFrame operations alone.

A run is ``run`` consecutive lines that are not blank. Of each run the first smallest line hash is a fingerprint, so equal
runs have equal fingerprints. Fingerprints are counted over all documents; around each that occurs again, the runs it is
the minimum of are joined by their content, and all but the first occurrence of a run (by doc_id, then place) are later
ones. Overlapping later runs merge, which extends each match as far as it goes both ways; their lines are deleted.

Only hashes are shuffled until the last step, nothing is paired within a group, and the first occurrence is a grouped
minimum joined back many-to-one, with the rows of a very common line or run dealt out (``dealt_join``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.llm.shared import dealt_join, let, part_of, written


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _filled(lines: Column) -> Column:
    """Indices of the lines that are not blank."""
    return F.filter(F.transform(lines, lambda line, i: F.when(F.trim(line) != "", i)), lambda i: i.isNotNull())


def _long(words: int) -> Column:
    """``long``: which of the lines that are not blank have at least ``words`` words."""
    filled = let(_lines(F.col("text")), lambda lines: F.transform(_filled(lines), lambda i: F.trim(F.get(lines, i))))
    found = let(filled, lambda lines: F.filter(F.transform(lines, lambda x, i: F.when(F.size(F.split(x, " +")) >= words, i)), lambda i: i.isNotNull()))
    return found.alias("long")


def _runs(run: int, body: str, kind: str) -> Column:
    """``body`` for each start ``s`` of a run; none where the document is shorter."""
    return F.expr(f"CASE WHEN size(lines) >= {run} THEN transform(sequence(0, size(lines) - {run}), s -> {body}) ELSE CAST(array() AS array<{kind}>) END")


def _sum(counted: DataFrame) -> int:
    return counted.agg(F.sum("n")).first()[0] or 0


def line_dedup(docs: DataFrame, run: int = 2, long: int | None = None) -> DataFrame:
    """Delete later repetitions of any ``run`` consecutive lines: doc_id, part, text, n_lines, n_deleted.

    ``docs`` needs doc_id and text; other columns are ignored. Lines part at \\n and compare without the spaces at their
    ends; blank lines belong to no run, are never deleted, and do not part a run. One row for each input row; a text
    that loses nothing comes back as it is, null included. A null doc_id comes before all others. Rows alike in doc_id
    and text are one document and keep what either keeps; rows that share a doc_id only are told apart by ``part``, 128
    bits of the text, which also orders them. With ``long``, a line of at least that many words (parted at spaces) is
    deleted as a later repetition by itself too, whatever stands around it. A repetition within one text counts. An empty table gives an empty result.
    """
    if run < 1:
        raise ValueError("run must be positive")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part_of("text").alias("part"), F.col("text").cast("string").alias("text"))
    keys = ["doc_id", "part"]
    hashes = let(_lines(F.col("text")), lambda lines: F.transform(_filled(lines), lambda i: F.xxhash64(F.trim(F.get(lines, i)))))
    hashed = docs.select(*keys, hashes.alias("lines"), *([] if long is None else [_long(long)]))
    hashed = written(hashed.where(F.size("lines") >= (run if long is None else 1)), "lines")
    place = f"CAST(s + array_position(slice(lines, s + 1, {run}), array_min(slice(lines, s + 1, {run}))) - 1 AS int)"
    prints = hashed.select(*keys, "lines", F.explode(F.array_distinct(_runs(run, place, "int"))).alias("p")).select(*keys, "p", F.expr("lines[p]").alias("h"))
    shared = written(prints.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    wanted = dealt_join(prints, shared, ["h"], _sum(shared)).groupBy(*keys).agg(F.collect_set("p").alias("places")).withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.expr("doc_id <=> _doc_id and part = _part")
    each = f"struct(s AS s, {place} AS p, xxhash64(slice(lines, s + 1, {run})) AS content)"
    runs = hashed.join(wanted, on).select(*keys, "lines", "places", F.explode(_runs(run, each, "struct<s: int, p: int, content: bigint>")).alias("x"))
    runs = runs.where(F.array_contains("places", F.col("x.p"))).select(*keys, F.expr("lines[x.p]").alias("h"), "x.content", "x.s")
    runs = written(runs, "runs")
    here = F.struct(*keys, "s")
    first = runs.groupBy("h", "content").agg(F.min(here).alias("first"), F.max(here).alias("last"), F.count(F.lit(1)).alias("n")).where("first <> last or first is null").select("h", "content", "first", "n")
    first = written(first, "first")
    later = dealt_join(runs, first, ["h", "content"], _sum(first)).where(~here.eqNullSafe(F.col("first"))).select(*keys, "s", F.lit(run).alias("width"))
    if long is not None:
        alone = hashed.select(*keys, "lines", F.explode("long").alias("s")).select(*keys, "s", F.expr("lines[s]").alias("h"))
        first = alone.groupBy("h").agg(F.min(here).alias("first"), F.max(here).alias("last"), F.count(F.lit(1)).alias("n")).where("not first <=> last").select("h", "first", "n")
        first = written(first, "alone")
        later = later.unionByName(dealt_join(alone, first, ["h"], _sum(first)).where(~here.eqNullSafe(F.col("first"))).select(*keys, "s", F.lit(1).alias("width")))
    later = later.groupBy(*keys).agg(F.collect_set(F.struct("s", "width")).alias("later"))
    rows = docs.join(later.withColumnsRenamed({k: f"_{k}" for k in keys}), on, "left")

    def edited(lines: Column) -> Column:
        def without(gone: Column) -> Column:
            left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
            return F.struct(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n").alias("text"), F.size(lines).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_deleted"))

        gone = let(_filled(lines), lambda at: F.array_distinct(F.flatten(F.transform("later", lambda x: F.slice(at, x["s"] + 1, x["width"])))))
        return let(gone, without)

    n = F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)).cast("long")
    out = F.when(F.col("later").isNull(), F.struct("text", n.alias("n_lines"), F.lit(0).cast("long").alias("n_deleted"))).otherwise(let(_lines(F.col("text")), edited))
    return rows.select(*keys, out.alias("x")).select(*keys, "x.text", F.greatest("x.n_lines", F.lit(0)).alias("n_lines"), "x.n_deleted")
