"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

One permutation of a 2^32 universe scatters the shingles, a second one is
shifted circularly by k to give signature coordinate k, so two permutations
yield every coordinate.  Coordinates are banded; documents that share a band
are candidates; every link is confirmed on the full shingle sets.

Groups of copies of any size stay cheap:

* documents with the same shingle set are one *node* from the start;
* in each band bucket all members are compared with one hub, not in pairs;
* only buckets that still hold several components afterwards are compared
  further: their members outside the largest component against the rest, in
  tiles of bounded size, on count sketches whose bound on the intersection is
  never too small.  What the bound lets through is confirmed on full sets.

Defined cases.  Null or empty text, or no word: an empty set, linked with
nothing, a component of its own.  Fewer words than a shingle: the whole
sequence is the one shingle.  Repeated rows and copies share a component.  A
null doc_id never becomes a component id unless all ids of the component are
null; a row is kept if its doc_id is the component id, null being equal to null
only.  Empty tables give empty results.  Only the id and text columns are read,
so other columns may have any name.

A pair at the threshold itself shares no band with probability
(1 - 0.8^rows)^bands, about 5e-6 for the defaults, and less above it.  Nodes
are 64-bit set hashes; n different sets meet by chance about n^2 / 2^65 times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, hot_keys, spread_join, stored
from .text_arrays import U64, fold, mix64, slices, text_buffer, word_hashes, words

ROWS, BANDS = 6, 40
TILE = 1000
BLOCK_BYTES = 1 << 21
U32 = np.uint32


def mix32(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers."""
    x = x ^ (x >> U32(16))
    x *= U32(0x7FEB352D)
    x ^= x >> U32(15)
    x *= U32(0x846CA68B)
    x ^= x >> U32(16)
    return x


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    start, end, first = words(buf, offsets)
    h = word_hashes(buf, start, end)
    grams = h
    for k in range(1, width):
        grams = fold(grams[:-1], h[k:]) if len(grams) > 1 else grams[:0]
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                whole = fold(whole, h[k : k + 1])
            out.append(whole)
        else:
            out.append(h[:0])
    return out


def set_hash(values: np.ndarray) -> int:
    """An order-free 64-bit hash of a set, as a signed integer."""
    with np.errstate(over="ignore"):
        total = mix64(values * U64(0x8EBC6AF09C88C6E3) + U64(0x589965CC75374CC3)).sum(dtype=np.uint64, keepdims=True)
        return int(mix64(total + U64(len(values))).view(np.int64)[0])


def minhash(sets: list[np.ndarray], rows: int, bands: int) -> np.ndarray:
    """Band keys (one row per set, ``bands`` columns); sets must not be empty."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    placed = mix32((np.concatenate(sets) >> U64(32)).astype(np.uint32))
    out = np.empty((len(sets), bands), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(bands):
            key = np.full(len(sets), band, np.uint64)
            for k in range(band * rows, (band + 1) * rows):
                key = fold(key, np.minimum.reduceat(mix32(placed + U32(k)), starts).astype(np.uint64))
            out[:, band] = key
    return out


def sketch(values: np.ndarray) -> bytes:
    """Counts of the set's hashes in about as many cells as it has members."""
    cells = 16
    while cells < len(values):
        cells *= 2
    return np.minimum(np.bincount((values >> U64(16)).astype(np.int64) & (cells - 1), minlength=cells), 255).astype(np.uint8).tobytes()


def folded(counts: np.ndarray, cells: int) -> np.ndarray:
    while counts.shape[-1] > cells:
        half = counts.shape[-1] // 2
        counts = counts[..., :half].astype(np.uint16) + counts[..., half:]
    return counts


def may_link(x: bytes, nx: int, y: bytes, ny: int, percent: int) -> bool:
    """False only if the sets cannot reach the threshold."""
    if 100 * min(nx, ny) < percent * max(nx, ny):
        return False
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if (a == 255).any() or (b == 255).any():
        return True
    cells = min(len(a), len(b))
    most = int(np.minimum(folded(a, cells), folded(b, cells)).sum(dtype=np.int64))
    return (100 + percent) * most >= percent * (nx + ny)


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("row_key"), F.col(text_col).cast("string").alias("text"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, row_key, n_shingles, node, bands, sketch) of every row; node, bands and sketch are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column("text"))
            for i, j in slices(offsets, BLOCK_BYTES):
                sets = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                full = [s for s in sets if len(s)]
                keys = iter(minhash(full, rows, bands).view(np.int64)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        batch.column("row_key").slice(i, j - i),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                        pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "row_key", "n_shingles", "node", "bands", "sketch"],
                )

    return _source(docs, id_col, text_col).mapInArrow(run, "doc_id long, row_key long, n_shingles long, node long, bands array<long>, sketch binary")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, members): the shingle hashes of the nodes in ``wanted`` (node, row_key), from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column("text"))
            nodes = batch.column("node").to_pylist()
            for i, j in slices(offsets, BLOCK_BYTES):
                sets = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                keep = [(node, s.tobytes()) for node, s in zip(nodes[i:j], sets) if len(s) and set_hash(s) == node]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keep], pa.int64()), pa.array([v for _, v in keep], pa.binary())], names=["node", "members"])

    rows = _source(docs, id_col, text_col).join(wanted.hint("merge"), "row_key").select("node", "text")
    return rows.mapInArrow(run, "node long, members binary").dropDuplicates(["node"])


def sketched(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_link(*row, percent) for row in zip(*(batch.column(c).to_pylist() for c in ("sa", "na", "sb", "nb")))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = nodes.select("node", "n", "sketch")
    joined = pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return joined.select("a", "b", "sa", "na", "sb", "nb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [links(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def tiled(members: DataFrame, percent: int) -> DataFrame:
    """Pairs across components of unresolved buckets that sketches do not rule out.

    ``members``: (bucket, node, comp, main, n, sketch, codes).  Members outside
    the bucket's main component meet the bucket's other members in tiles of
    about TILE x TILE, so a task's memory does not follow the size of a bucket.
    ``codes`` are the node's band keys, shortened: a pair is looked at only in
    the first band that it shares.  (Any bucket with both is unresolved, so none
    is passed over.)
    """
    columns = ("node", "comp", "n", "sketch", "codes")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("all"), F.count_if(F.expr("comp <> main")).alias("out"))
    sizes = sizes.select("bucket", F.ceil(F.col("all") / TILE).cast("int").alias("cols"), F.ceil(F.col("out") / TILE).cast("int").alias("lines"))
    sized = members.join(sizes, "bucket").withColumn("spot", F.pmod(F.xxhash64("node"), F.lit(1 << 30)))
    left = sized.where("comp <> main").select("bucket", F.pmod("spot", "lines").alias("line"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"), F.lit(True).alias("outer"), *columns)
    right = sized.select("bucket", F.explode(F.sequence(F.lit(0), F.col("lines") - 1)).alias("line"), F.pmod("spot", "cols").alias("col"), F.lit(False).alias("outer"), *columns)
    rows = left.select("bucket", F.col("line").cast("int"), F.col("col").cast("int"), "outer", *columns).union(
        right.select("bucket", F.col("line").cast("int"), F.col("col").cast("int"), "outer", *columns)
    )

    def run(table: pa.Table) -> pa.Table:
        node, comp, n = (table.column(c).to_numpy() for c in ("node", "comp", "n"))
        outer, raw = table.column("outer").to_numpy(), table.column("sketch").to_pylist()
        codes = np.array(table.column("codes").to_pylist(), np.int32)
        bucket = np.int64(table.column("bucket")[0].as_py())
        found: list[tuple[int, int]] = []
        inner = np.flatnonzero(~outer)
        by_cells = {c: np.array([i for i in inner if len(raw[i]) == c]) for c in {len(raw[i]) for i in inner}}
        stacks = {c: np.stack([np.frombuffer(raw[i], np.uint8) for i in rows]) for c, rows in by_cells.items()}
        for i in np.flatnonzero(outer):
            own = np.frombuffer(raw[i], np.uint8)
            for c, rows in by_cells.items():
                ok = (comp[rows] != comp[i]) & (100 * np.minimum(n[rows], n[i]) >= percent * np.maximum(n[rows], n[i]))
                shared = codes[rows] == codes[i]
                ok &= codes[i][shared.argmax(axis=1)] == bucket >> 32
                if not ok.any():
                    continue
                cells = min(c, len(own))
                other = folded(stacks[c][ok], cells)
                most = np.minimum(other, folded(own, cells)).sum(axis=1, dtype=np.int64)
                full = (stacks[c][ok] == 255).any(axis=1) | bool((own == 255).any())
                pick = rows[ok][full | ((100 + percent) * most >= percent * (n[rows[ok]] + n[i]))]
                found += [(min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j]))) for j in pick]
        found = list(set(found))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return rows.groupBy("bucket", "line", "col").applyInArrow(run, "a long, b long").distinct()


def placed_rows(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, row_key, n_shingles, node, comp) for every row of ``docs``; comp is null for empty sets."""
    signed = stored(signatures(docs, id_col, text_col, width, rows, bands), "signatures")
    classes = signed.where("node is not null").groupBy("node").agg(F.min("row_key").alias("row_key"))
    spread = signed.where("node is not null").select("node", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("far")).where("hub <> far").select("bucket", "hub")
    members = stored(spread.join(shared, "bucket").select("bucket", "node", "hub").distinct(), "members")
    codes = F.transform("bands", lambda b: F.shiftright(b, 32).cast("int"))
    nodes = signed.where("node is not null").select("node", F.col("n_shingles").alias("n"), "sketch", codes.alias("codes"))
    nodes = stored(nodes.dropDuplicates(["node"]).join(members.select("node").distinct(), "node", "left_semi"), "nodes")

    sets = stored(full_sets(docs, nodes.select("node").join(classes, "node"), id_col, text_col, width), "sets")

    def verify(candidates: DataFrame) -> DataFrame:
        return stored(confirmed(candidates, sets, percent), "confirmed")

    stars = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    found = verify(sketched(stars, nodes, percent))
    label = components(found)

    placed = members.join(label, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    counts = placed.groupBy("bucket", "comp").count()
    mains = counts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by("comp", F.struct("count", "comp")).alias("main")).where("parts > 1")
    left = placed.join(mains.select("bucket", "main"), "bucket").join(nodes, "node").select("bucket", "node", "comp", "main", "n", "sketch", "codes")
    rest = stored(tiled(left, percent), "rest")
    if rest.limit(1).count():
        found = found.union(verify(rest))
        label = components(found)

    rows = signed.select("doc_id", "row_key", "n_shingles", "node")
    copies = hot_keys(rows.where("node is not null").groupBy("node").count(), "node")
    linked = spread_join(rows.where("node is not null"), label, "node", copies, "row_key", "left").withColumn("comp", F.coalesce("comp", "node"))
    return linked.select(*rows.columns, "comp").union(rows.where("node is null").withColumn("comp", F.lit(None).cast("long")))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(row_key): one row of each component, by doc_id with nulls last and then row_key; rows of empty sets are components of their own."""
    own = placed_rows(docs, id_col, text_col, width, percent, rows, bands)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key"))["row_key"]
    best = own.where("node is not null").groupBy("comp").agg(first.alias("row_key")).select("row_key")
    return best.union(own.where("node is null").select("row_key").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 2, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, row_key) for every row of ``docs``."""
    own = stored(placed_rows(docs, id_col, text_col, width, percent, rows, bands), "placed")
    lowest = own.where("node is not null").groupBy("comp").agg(F.min("doc_id").alias("low"), F.count("*").alias("count"))
    large = hot_keys(lowest, "comp")
    full = spread_join(own.where("node is not null"), lowest.select("comp", "low"), "comp", large, "row_key")
    out = full.select(*own.columns, F.col("low").alias("component_id")).union(own.where("node is null").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "row_key")
