"""Language-model scores by deleted interpolation.

A bigram model over words: maximum-likelihood estimates of order two and one and
the uniform distribution are mixed with weights that depend on how often the
context was seen.  The weights of each context-frequency bucket are learned by
expectation-maximisation on counts of a held-out share of the training texts.

Counts are exact and cover the whole corpus.  Tokens never travel one by one:

* texts are packed into chunks, a written table;
* each chunk sends its distinct n-grams, sorted and delta-coded, with its own
  counts, in FAN messages, one for each value of the hash's first byte;
* up to about FAN chunks form a batch: a task merges what they sent under one
  byte, so a hot n-gram goes on as one entry, and sends the sums in FAN messages
  by the next byte, until one batch holds all; the totals come back down the
  same way, each message answered for just its own n-grams;
* held-out texts are chunks of their own; a chunk, its texts and its totals meet
  once to learn the weights (held-out chunks only) and once to score.

There are FAN messages for a chunk or merged batch, and each level has about FAN
times fewer batches than the last and FAN times more bytes to part them by, so
messages grow in proportion to the corpus (times its number of levels, 1 up to
256 chunks, 2 up to 65 536, 3 up to 67 TB).  A task holds one batch's messages
under one prefix, which is no more than a chunk's n-grams, at every level.

Defined cases.  Null or empty text: the end token alone.  Repeated rows: scored
alike, each counted.  No training text: N = 0, V = 0, all weight on the uniform
estimate.  A context that was never seen has no order-two estimate, so its
weight is shared by the other two; probabilities sum to 1 after every context.
No held-out text: the starting weights.  Empty table: empty result.  Only the id and text columns
are read.  N-grams are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc_mod, forget, stored
from .text_arrays import U64, fold, slices, text_buffer, word_hashes, words

CHUNK_BYTES = 4 << 20
#: Messages of a chunk, and chunks of a batch: two to the power of the bits that a level parts by.
FAN_BITS = 8
#: Share of the training texts whose counts teach the mixture weights: one in DELETED.
DELETED = 10
#: Buckets of context counts: 0, 1, 2-3, 4-7, ... in powers of two.
BUCKETS = 24
#: Bins to the decade, and decades, of the log10 probabilities that the weights are learned on.
BIN, DECADES = 16, 10
END = np.array([0x5851F42D4C957F2D], np.uint64)
START = np.array([0x14057B7EF767814F], np.uint64)


@lru_cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(values: np.ndarray) -> bytes:
    return _zstd()[0].compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_zstd()[1].decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys as compressed byte planes of their differences."""
    return _pack(np.diff(keys, prepend=U64(0)))


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as compressed byte planes."""
    return _pack(counts)


def unpack_counts(raw: bytes) -> np.ndarray:
    return _unpack(raw).astype(np.int64)


def pack_texts(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({"text": column.cast(pa.large_string())})
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack_texts(raw: bytes) -> pa.Array:
    with pa.ipc.open_stream(raw) as reader:
        return reader.read_all().column("text").combine_chunks()


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unigram keys, bigram keys, first token of each text): each text's words and then one end token."""
    buf, offsets = text_buffer(column)
    sizes = np.zeros(len(offsets) - 1, np.int64)
    parts = [np.zeros(0, np.uint64)]
    for i, j in slices(offsets, 1 << 21):
        b, o = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, end, first = words(b, o)
        sizes[i:j] = np.diff(first) + 1
        parts.append(np.insert(word_hashes(b, start, end), first[1:], END[0]))
    one = np.concatenate(parts)
    first = np.concatenate([[0], np.cumsum(sizes)])
    before = np.empty_like(one)
    before[1:] = one[:-1]
    before[first[:-1]] = START[0]
    return one, fold(before ^ U64(0x2545F4914F6CDD1D), one), first


def chunked(docs: DataFrame, id_col: str, text_col: str, folds: int, test_fold: int) -> DataFrame:
    """Texts in compressed chunks of about CHUNK_BYTES; ``gone`` chunks hold the held-out texts.

    ``parts`` is 0 for test texts, 1 for training texts, 2 for held-out training texts.
    """
    schema = "chunk long, gone boolean, ids binary, no_id binary, parts binary, texts binary, bytes long, starts long"
    types = (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
        size = {False: 0, True: 0}

        def flush(gone: bool) -> pa.RecordBatch:
            nonlocal made
            table = pa.Table.from_batches(held[gone])
            ids, text = table.column("doc_id").combine_chunks(), table.column("text").combine_chunks()
            part = table.column("part").to_numpy().astype(np.uint8)
            blank = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            row = (base + made, gone, ids.fill_null(0).to_numpy().astype("<i8").tobytes(), blank.tobytes(), part.tobytes(), pack_texts(text), size[gone], int((part > 0).sum()))
            held[gone], size[gone], made = [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            for gone in (False, True):
                own = batch.filter(pc.equal(pc.equal(batch.column("part"), 2), gone))
                _, offsets = text_buffer(own.column("text"))
                for i, j in slices(offsets, CHUNK_BYTES // 4):
                    held[gone].append(own.slice(i, j - i))
                    size[gone] += int(offsets[j] - offsets[i])
                    if size[gone] >= CHUNK_BYTES:
                        yield flush(gone)
        for gone in (False, True):
            if held[gone]:
                yield flush(gone)

    test = crc_mod(id_col, folds) == test_fold
    gone = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)), F.lit(DELETED)) == 0
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.when(test, 0).when(gone, 2).otherwise(1).cast("int").alias("part"))
    return stored(rows.mapInArrow(run, schema), "chunks")


def grams(texts: bytes) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """(keys, place, n, first): the distinct n-grams of a chunk, where each of the n tokens and n bigrams is among them, and the first token of each text."""
    one, two, first = tokens(unpack_texts(texts))
    n = len(one)
    place = np.empty(2 * n, np.int32)
    parts = []
    for at, values in ((0, one), (n, two)):
        kinds, spot = np.unique(values, return_inverse=True)
        place[at : at + n] = spot
        parts.append(kinds)
    del one, two, values, spot
    keys = np.concatenate(parts)
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    for at, kinds in zip((0, n), parts):
        place[at : at + n] = np.searchsorted(keys, kinds).astype(np.int32)[place[at : at + n]]
    return keys, place, n, first


MESSAGE = "batch long, prefix long, child long, gone boolean, keys binary, counts binary, held binary, word binary"
REPLY = "child long, gone boolean, prefix long, digit int, seen binary, train binary, all_tokens long, train_tokens long, types long"
KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def rows_of(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], KINDS[kind]) for i, (name, kind) in enumerate(fields)})


def levels_of(chunks: int) -> int:
    """Levels until one batch holds all chunks."""
    levels = 1
    while chunks > 1 << (FAN_BITS * levels):
        levels += 1
    return levels


def messages(child: int, gone: bool | None, batch: int, prefix: int, level: int, keys: np.ndarray, counts: np.ndarray, held: np.ndarray | None, word: np.ndarray) -> list[tuple]:
    """A child's n-grams parted by the hash bits of ``level``; ``held`` are the counts in held-out texts, None for none."""
    digits = (keys >> U64(64 - FAN_BITS * level)) & U64((1 << FAN_BITS) - 1)
    edges = np.searchsorted(digits, np.arange((1 << FAN_BITS) + 1, dtype=np.uint64))
    return [
        (batch, (prefix << FAN_BITS) | d, child, gone, pack_keys(keys[lo:hi]), pack_counts(counts[lo:hi]), None if held is None else pack_counts(held[lo:hi]), np.packbits(word[lo:hi]).tobytes())
        for d, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist()))
        if hi > lo
    ]


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(keys, counts, held counts, which are words, where each message's keys are among them)."""
    parts = [unpack_keys(x) for x in table.column("keys").to_pylist()]
    sizes = [len(k) for k in parts]
    keys, place = np.unique(np.concatenate(parts), return_inverse=True)
    del parts
    add = lambda values: np.rint(np.bincount(place, weights=np.concatenate(values), minlength=len(keys))).astype(np.int64)
    counts = add([unpack_counts(x) for x in table.column("counts").to_pylist()])
    held = add([np.zeros(n, np.int64) if x is None else unpack_counts(x) for x, n in zip(table.column("held").to_pylist(), sizes)])
    flags = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("word").to_pylist(), sizes)])
    word = np.zeros(len(keys), bool)
    word[place[flags == 1]] = True
    return keys, counts, held, word, np.split(place, np.cumsum(sizes)[:-1])


def replies(table: pa.Table, places: list[np.ndarray], seen: np.ndarray, train: np.ndarray) -> list[tuple]:
    """The totals that each message asked for.  Chunks that are not held out need no training totals."""
    rows = zip(table.column("child").to_pylist(), table.column("gone").to_pylist(), table.column("prefix").to_pylist(), places)
    return [(child, gone, prefix >> FAN_BITS, prefix & ((1 << FAN_BITS) - 1), pack_counts(seen[p]), None if gone is False else pack_counts(train[p]), None, None, None) for child, gone, prefix, p in rows]


def exchange(chunks: DataFrame, size: int) -> DataFrame:
    """(child, gone, digit, seen, train): for each of ``size`` chunks the corpus counts of the n-grams it asked for, in order of their first hash byte.

    ``seen`` counts all training texts, ``train`` those that are not held out
    (for held-out chunks only).  Child -1 has sums over words.
    """
    levels = levels_of(size)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, gone, to, raw, parts in zip(*(batch.column(c) for c in ("chunk", "gone", "batch", "texts", "parts"))):
                keys, place, n, first = grams(raw.as_py())
                training = np.repeat(np.frombuffer(parts.as_py(), np.uint8) > 0, np.diff(first))
                counts = np.bincount(place[np.concatenate([training, training])], minlength=len(keys))
                word = np.zeros(len(keys), bool)
                word[place[:n]] = True
                yield from rows_of(MESSAGE, messages(chunk.as_py(), gone.as_py(), to.as_py(), 0, 1, keys, counts, counts if gone.as_py() else None, word)).to_batches()

    def lift(level: int):
        def run(table: pa.Table) -> pa.Table:
            keys, counts, held, word, _ = merged(table)
            batch, prefix = table.column("batch")[0].as_py(), table.column("prefix")[0].as_py()
            return rows_of(MESSAGE, messages(batch, None, batch >> FAN_BITS, prefix, level, keys, counts, held, word))

        return run

    def total(table: pa.Table) -> pa.Table:
        _, seen, held, word, places = merged(table)
        train = seen - held
        sums = (-1, None, 0, 0, None, None, int(seen[word].sum()), int(train[word].sum()), int((seen[word] > 0).sum()))
        return rows_of(REPLY, [*replies(table, places, seen, train), sums])

    def lower(asked: pa.Table, told: pa.Table) -> pa.Table:
        if not len(asked):
            return rows_of(REPLY, [])
        told = told.sort_by("digit")
        seen, train = (np.concatenate([unpack_counts(x) for x in told.column(c).to_pylist()]) for c in ("seen", "train"))
        return rows_of(REPLY, replies(asked, merged(asked)[4], seen, train))

    batches = -(-max(size, 1) // (1 << FAN_BITS))
    placed = chunks.select("chunk", "gone", F.pmod(F.xxhash64("chunk"), F.lit(batches)).alias("batch"), "texts", "parts")
    sent = [placed.mapInArrow(send, MESSAGE)]
    for level in range(2, levels + 1):
        sent[-1] = stored(sent[-1], "messages")
        sent.append(sent[-1].groupBy("batch", "prefix").applyInArrow(lift(level), MESSAGE))
    back = stored(sent[-1].groupBy("batch", "prefix").applyInArrow(total, REPLY), "totals")
    sums = back.where("child < 0")
    for asked in reversed(sent[:-1]):
        told = back.where("child >= 0").withColumnRenamed("child", "batch")
        back = stored(asked.groupBy("batch", "prefix").cogroup(told.groupBy("batch", "prefix")).applyInArrow(lower, REPLY), "totals")
        forget(asked)
    return back.where("child >= 0").union(sums) if levels > 1 else back


def joined(chunks: DataFrame, totals: DataFrame, name: str) -> DataFrame:
    """Each chunk with its counts, of which there are at most FAN parts."""
    back = totals.where("child >= 0").groupBy(F.col("child").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("digit", F.col(name).alias("counts")))).alias("back"))
    return chunks.select("chunk", "texts", "parts", "ids", "no_id").join(back, "chunk")


def opened(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(counts of every token, of every bigram, first token of each text, parts, ids, no_id) of each chunk."""
    for raw, parts, ids, no_id, back in zip(*(batch.column(c) for c in ("texts", "parts", "ids", "no_id", "back"))):
        _, place, n, first = grams(raw.as_py())
        counts = np.concatenate([unpack_counts(r["counts"]) for r in back.as_py()])
        yield counts[place[:n]], counts[place[n:]], first, np.frombuffer(parts.as_py(), np.uint8), ids.as_py(), no_id.as_py()


def estimates(one: np.ndarray, two: np.ndarray, first: np.ndarray, starts: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, bigram ML, unigram ML) of every token; a text's first context is its start."""
    context = np.empty(len(one), np.int64)
    context[1:] = one[:-1]
    context[first[:-1]] = starts
    bucket = np.minimum(np.ceil(np.log2(context + 1)).astype(np.int64), BUCKETS - 1)
    return bucket, two / np.maximum(context, 1), one / max(total, 1)


def log_bin(p: np.ndarray) -> np.ndarray:
    """0 for probability 0, else a bin of log10."""
    return np.where(p > 0, 1 + np.clip((-np.log10(np.maximum(p, 1e-300)) * BIN).astype(np.int64), 0, DECADES * BIN - 1), 0)


def learn(rows: list[tuple[int, int, int, int]], types: int, rounds: int = 100) -> np.ndarray:
    """Mixture weights (bucket, order) by expectation-maximisation on held-out counts (bucket, bigram bin, unigram bin, count).

    Bucket 0 has contexts that were never seen, which have no bigram estimate.
    Without any known type only the uniform estimate is left.
    """
    if not types:
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    start = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    start[0, 0] = 0.0
    weights = start / start.sum(axis=1, keepdims=True)
    if not rows:
        return weights
    bucket, two, one, n = np.array(sorted(rows), np.int64).T
    value = lambda b: np.where(b > 0, 10.0 ** (-(b - 0.5) / BIN), 0.0)
    p = np.stack([value(two), value(one), np.full(len(n), 1.0 / (types + 1))], axis=1)
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / share.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(bucket, weights=share[:, k], minlength=BUCKETS) for k in range(3)], axis=1) + start
        weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, test_fold: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    chunks = chunked(docs, id_col, text_col, folds, test_fold)
    whole = chunks.agg(F.count("*").alias("chunks"), F.sum("starts").alias("starts"), F.sum(F.when(~F.col("gone"), F.col("starts"))).alias("kept_starts")).first()
    starts, kept_starts = whole["starts"] or 0, whole["kept_starts"] or 0
    totals = exchange(chunks, whole["chunks"])
    sums = totals.where("child < 0").agg(F.sum("all_tokens").alias("n"), F.sum("train_tokens").alias("kept"), F.sum("types").alias("types")).first()
    known, kept, types = sums["n"] or 0, sums["kept"] or 0, sums["types"] or 0

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two, first, *_ in opened(batch):
                bucket, bigram, unigram = estimates(one, two, first, kept_starts, kept)
                codes, n = np.unique((bucket * 1000 + log_bin(bigram)) * 1000 + log_bin(unigram), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (codes // 1_000_000, codes // 1000 % 1000, codes % 1000, n)], names=["bucket", "two", "one", "n"])

    learned = joined(chunks.where("gone"), totals.where("gone"), "train").mapInArrow(teach, "bucket long, two long, one long, n long")
    # At most BUCKETS * (BIN * DECADES + 1)^2 rows, however large the corpus.
    weights = learn([tuple(r) for r in learned.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).collect()], types)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two, first, part, ids, no_id in opened(batch):
                bucket, bigram, unigram = estimates(one, two, first, starts, known)
                bigram *= weights[:, 0][bucket]
                unigram *= weights[:, 1][bucket]
                bigram += unigram
                bigram += (weights[:, 2] / (types + 1))[bucket]
                mixed = np.log10(bigram, out=bigram)
                plain = np.log10((one + 1) / (known + types + 1))
                at = first[:-1]
                doc = pa.array(np.frombuffer(ids, "<i8"), pa.int64(), mask=np.frombuffer(no_id, np.uint8).astype(bool))
                columns = [doc, pa.array(part == 0), pa.array(np.diff(first), pa.int64()), pa.array(np.add.reduceat((one > 0).astype(np.int64), at)), pa.array(np.full(len(part), known), pa.int64()), pa.array(np.add.reduceat(plain, at)), pa.array(np.add.reduceat(mixed, at))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return joined(chunks, totals, "seen").mapInArrow(rate, schema)
