"""Benchmark decontamination: edit-tolerant search for benchmark items in documents.

Texts and items are word sequences (ASCII lower case; punctuation separates).
A document holds an item if some passage of it is within edit distance
``floor((1 - similarity) * words)`` of the item.

1. Windows.  An item is its own piece up to WIDEST words, longer ones are cut
   into equal pieces; some piece has no more than its share of the edits.  Every
   window of a text that is as long as some piece counts if enough of its words
   and word pairs are in the benchmark at all (a piece of w words within e edits
   keeps w - e words and w - 1 - 2e pairs, so this loses nothing).  The words and
   pairs are bit tables of fixed size.
2. CGK embedding.  Random walks copy the words of windows and pieces into longer
   strings, so that a small edit distance becomes a small Hamming distance.
3. Bit sampling.  Each walk has several samplings of a few positions; a sampling
   is one key.  Windows and pieces meet by an equi-join on these keys.
4. Exact verification of the joined pairs by bit-parallel semi-global edit
   distance against the whole item.

Step 3 alone may lose a match: at the largest number of edits a window at the
passage's start meets its piece with probability 0.97 or more, and windows next
to it and other pieces are further chances (tests measure 0.98 and more against
exhaustive search).

The benchmark is a table like any other: one pass over the documents whatever
its size, and no more of it on the driver than bit tables and one row for each
piece width.  Keys and items that very many windows share are dealt in pieces.

Defined cases.  Null or empty texts and items: no match.  Items under five
words: matched exactly.  Items that repeat with id and text count once; rows
that repeat are each reported.  Empty tables give empty results (or all
documents back).  Only the id and text columns are read; other columns may have
any name.  Texts are told apart by 64-bit hashes when rows are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, hot_keys, keep_rows, spread_join, stored
from .text_arrays import PUNCTUATION, U64, fold, mix64, slices, text_buffer, word_hashes, words

SIMILARITY = 0.8
WIDEST = 32
WALKS, SAMPLINGS, POSITIONS = 4, 12, 3
#: Symbols of an embedded string to each word; a walk passes a word in two steps on average.
STRETCH = 2
TABLE_BITS = 23
BLOCK_BYTES = 1 << 21
WINDOWS = 4096
#: First words of one run of windows lie within so many words.
RUN_WORDS = 1024
ITEM = "item_no long, item_id long, item_words int, most int, item binary, pieces array<struct<shift:int,width:int,budget:int,keys:array<long>>>"
RUN = "row long, doc_id long, text_key long, run long, region binary, keys array<long>"
PIECE = pa.struct([("shift", pa.int32()), ("width", pa.int32()), ("budget", pa.int32()), ("keys", pa.list_(pa.int64()))])


def edits(m: int, similarity: float) -> int:
    return int((1 - similarity) * m + 1e-9)


def cut(m: int, most: int) -> list[tuple[int, int, int]]:
    """(shift, width, edits) of an item's pieces; a match has some piece within its edits."""
    n = -(-m // WIDEST)
    return [(i * m // n, (i + 1) * m // n - i * m // n, most // n) for i in range(n)]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each text)."""
    buf, offsets = text_buffer(texts)
    start, end, first = words(buf, offsets, PUNCTUATION)
    return word_hashes(buf, start, end), first


def embed(rows: np.ndarray, lengths: np.ndarray, walk: int) -> np.ndarray:
    """CGK strings of padded word rows: STRETCH * width symbols each; 0 stands past the end."""
    n, width = rows.shape
    at = np.zeros(n, np.int64)
    out = np.zeros((n, STRETCH * width), np.uint64)
    every = np.arange(n)
    with np.errstate(over="ignore"):
        for j in range(STRETCH * width):
            live = at < lengths
            symbol = np.where(live, rows[every, np.minimum(at, width - 1)], U64(0))
            out[:, j] = symbol
            coin = mix64(symbol + U64((walk * 1_000_003 + j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & U64(1)
            at += coin.astype(np.int64) & live
    return out


def sampled_keys(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One key for each walk and sampling of word rows of one width."""
    width = rows.shape[1]
    out = np.empty((len(rows), WALKS * SAMPLINGS), np.uint64)
    for walk in range(WALKS):
        strings = embed(rows, lengths, walk)
        places = np.random.default_rng([walk, width]).integers(0, STRETCH * width, (SAMPLINGS, POSITIONS))
        for k, spots in enumerate(places):
            key = np.full(len(rows), (width * WALKS + walk) * SAMPLINGS + k, np.uint64)
            for spot in spots:
                key = fold(key, strings[:, spot])
            out[:, walk * SAMPLINGS + k] = key
    return out


def distance(item: list[int], region: list[int]) -> int:
    """Least edit distance of the item to any passage of the region."""
    m = len(item)
    masks: dict[int, int] = {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for word in region:
        eq = masks.get(word, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        best = min(best, score)
    return best


def prepared(benchmark: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """Every item with its words and the sampled keys of its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            _, offsets = text_buffer(text)
            for i, j in slices(offsets, BLOCK_BYTES):
                h, first = tokens(text.slice(i, j - i))
                rows = []
                for at, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist()), i):
                    if a == b:
                        continue
                    most = edits(b - a, similarity)
                    pieces = []
                    for shift, width, budget in cut(b - a, most):
                        keys = sampled_keys(h[None, a + shift : a + shift + width], np.full(1, width))
                        pieces.append({"shift": shift, "width": width, "budget": budget, "keys": keys[0].view(np.int64)})
                    rows.append((batch.column("item_no")[at].as_py(), batch.column("item_id")[at].as_py(), b - a, most, h[a:b].tobytes(), pieces))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(PIECE))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["item_no", "item_id", "item_words", "most", "item", "pieces"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    return stored(rows.withColumn("item_no", F.xxhash64("item_id", "text")).mapInArrow(run, ITEM), "items")


def bit_tables(items: DataFrame) -> np.ndarray:
    """Which hashes occur in the benchmark: words, word pairs and keys, 2^TABLE_BITS bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((3, 1 << TABLE_BITS), np.uint8)
        for batch in batches:
            for item, pieces in zip(batch.column("item"), batch.column("pieces")):
                h = np.frombuffer(item.as_buffer(), np.uint64)
                keys = np.array([k for p in pieces.as_py() for k in p["keys"]], np.int64).view(np.uint64)
                for kind, values in enumerate((h, fold(h[:-1], h[1:]), keys)):
                    seen[kind, spot(values)] = 1
        packed = np.packbits(seen.ravel()).view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(packed[at], pa.int64())], names=["at", "bits"])

    # At most 3 * 2^TABLE_BITS / 64 rows, whatever the benchmark.
    table = items.select("item", "pieces").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    packed = np.zeros(3 << (TABLE_BITS - 6), np.int64)
    packed[table.column("at").to_numpy()] = table.column("bits").to_numpy()
    return packed


def spot(values: np.ndarray) -> np.ndarray:
    return (values & U64((1 << TABLE_BITS) - 1)).astype(np.int64)


def matching_runs(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Runs of neighbouring windows that share a key with some piece: the words around them and those keys."""
    piece = items.select("item_words", "most", F.explode("pieces").alias("p")).select("item_words", "most", "p.*")
    spans = piece.groupBy("width").agg(F.max("budget"), F.max(F.expr("shift + 2 * most")), F.max(F.expr("item_words - shift - width + 2 * most")))
    # At most WIDEST rows.
    scope = sorted(tuple(r) for r in spans.collect())
    packed = bit_tables(items)
    need_words = min((w - e for w, e, _, _ in scope), default=1)
    need_pairs = min((max(0, w - 1 - 2 * e) for w, e, _, _ in scope), default=0)

    def windows(h: np.ndarray, first: np.ndarray, known: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(first word, width, shared keys) of the windows of a block that may match."""
        n = len(h)
        end = np.repeat(first[1:], np.diff(first))
        word = np.concatenate([[0], np.cumsum(known[0][spot(h)], dtype=np.int32)])
        pair = np.zeros(n + 1, np.int32)
        pair[1:-1] = np.cumsum(known[1][spot(fold(h[:-1], h[1:]))] & (end[:-1] == end[1:]), dtype=np.int32)
        pair[-1] = pair[-2]
        far = np.minimum(np.arange(n) + scope[-1][0], end)
        live = np.flatnonzero((word[far] - word[:-1] >= need_words) & (pair[far - 1] - pair[:-1] >= need_pairs))
        found = []
        for width, budget, _, _ in scope:
            stop = np.minimum(live + width, end[live])
            at = live[(word[stop] - word[live] >= width - budget) & (pair[stop - 1] - pair[live] >= width - 1 - 2 * budget)]
            for lo in range(0, len(at), WINDOWS):
                part = at[lo : lo + WINDOWS]
                keys = sampled_keys(h[np.minimum(part[:, None] + np.arange(width), n - 1)], np.minimum(width, end[part] - part))
                shared = known[2][spot(keys)]
                found += [(int(part[i]), width, keys[i][shared[i]]) for i in np.flatnonzero(shared.any(axis=1))]
        return sorted(found, key=lambda f: f[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(packed.view(np.uint8)).view(bool).reshape(3, -1)
        margin = {w: (left, right) for w, _, left, right in scope}
        row, made = TaskContext.get().partitionId() << 36, TaskContext.get().partitionId() << 36
        for batch in batches:
            text = batch.column("text")
            _, offsets = text_buffer(text)
            for i, j in slices(offsets, BLOCK_BYTES):
                h, first = tokens(text.slice(i, j - i))
                if not len(h) or not scope:
                    continue
                out = []
                group: list[tuple[int, int, np.ndarray]] = []
                doc = -1

                def close() -> None:
                    nonlocal made
                    lo = max(first[doc], min(a - margin[w][0] for a, w, _ in group))
                    hi = min(first[doc + 1], max(a + w + margin[w][1] for a, w, _ in group))
                    keys = np.unique(np.concatenate([k for _, _, k in group])).view(np.int64)
                    out.append((row + i + doc, batch.column("doc_id")[i + doc].as_py(), batch.column("text_key")[i + doc].as_py(), made, h[lo:hi].tobytes(), keys))
                    made += 1

                for hit in windows(h, first, known):
                    if group and (hit[0] >= first[doc + 1] or hit[0] > group[-1][0] + WIDEST or hit[0] >= group[0][0] + RUN_WORDS):
                        close()
                        group = []
                    if not group:
                        doc = int(np.searchsorted(first, hit[0], "right")) - 1
                    group.append(hit)
                if group:
                    close()
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[f.split()[0] for f in RUN.split(", ")])
            row += len(batch)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(run, RUN), "runs")


def verified(pairs: DataFrame) -> DataFrame:
    """The pairs (run, region, item, most) whose item is in the region, with its edits; pairs of a run that follow each other share their work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, region, present = None, [], set()
        for batch in batches:
            near = []
            for number, around, item, most in zip(*(batch.column(c) for c in ("run", "region", "item", "most"))):
                if number.as_py() != last:
                    last = number.as_py()
                    region = np.frombuffer(around.as_buffer(), np.uint64).tolist()
                    present = set(region)
                sought, d = np.frombuffer(item.as_buffer(), np.uint64).tolist(), most.as_py()
                # A word that is not there costs an edit.
                missing = sum(w not in present for w in sought)
                best = distance(sought, region) if missing <= d else d + 1
                near.append(best if best <= d else None)
            edits_ = pa.array(near, pa.int32())
            columns = [batch.column(c) for c in ("row", "doc_id", "text_key", "item_no", "item_id", "item_words")]
            yield pa.RecordBatch.from_arrays([*columns, edits_], names=["row", "doc_id", "text_key", "item_no", "item_id", "item_words", "edits"]).filter(edits_.is_valid())

    return pairs.mapInArrow(run, "row long, doc_id long, text_key long, item_no long, item_id long, item_words int, edits int")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str | None, text_col: str, item_col: str, item_text_col: str, similarity: float) -> DataFrame:
    """(row, doc_id, text_key, item_no, item_id, item_words, edits): every item in every row, maybe once for each run of windows."""
    items = prepared(benchmark, item_col, item_text_col, similarity)
    runs = matching_runs(docs, items, id_col, text_col)
    wanted = items.select("item_no", F.explode("pieces").alias("p")).select("item_no", F.explode("p.keys").alias("key")).distinct()
    offered = runs.select("run", F.explode("keys").alias("key"))
    common = hot_keys(offered.groupBy("key").count(), "key")
    pairs = stored(spread_join(offered, wanted, "key", common, "run").select("run", "item_no").distinct(), "pairs")
    popular = hot_keys(pairs.groupBy("item_no").count(), "item_no")
    full = spread_join(pairs, items.drop("pieces"), "item_no", popular, "run").join(runs.drop("keys"), "run")
    return verified(full.select("run", "region", "item", "most", "row", "doc_id", "text_key", "item_no", "item_id", "item_words"))


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, edits, item_words) for every item that a document row holds."""
    found = matches(docs, benchmark, id_col, text_col, item_col, item_text_col, similarity)
    return found.groupBy("row", "doc_id", "item_no", "item_id", "item_words").agg(F.min("edits").alias("edits")).select("doc_id", "item_id", "edits", "item_words")


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs``, all columns, without the rows that hold any item; repeated rows are each judged."""
    key = free_name(docs, "_text_key")
    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = matches(rows, benchmark, "doc_id", "text", item_col, item_text_col, similarity)
    gone = stored(found.select(F.col("text_key").alias(key)).distinct(), "contaminated")
    return keep_rows(docs.withColumn(key, F.xxhash64(text_col)), gone, key, "left_anti").select(docs.columns)
