"""Interleaved document sequences with media columns.

HTML is parsed into ordered structs of text and media references; a reference
names its payload by digest, and a digest join resolves it, position and caption
staying with it.  Payloads are stored losslessly as 8-bit greyscale PNG rows.
Facts about a payload are computed where the stored bytes are read, so the join
moves a few dozen bytes for each payload and never the payload.

Defined cases.  Null or empty text: an empty payload, which is one row of
padding.  Equal payloads share a digest; the store may hold one more than once,
and a reference finds one of them.  A reference without a stored payload keeps
its place with null facts.  Null HTML: an empty sequence; tags left open lose no
text (see ``sequence_of``).  Texts are stored in groups of bounded bytes, a
longer one alone.  Empty tables give
empty results.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hot_keys, spread_join, stored
from .text_arrays import slices, text_buffer

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEME = "sha256:"
#: Attributes that name a medium, by tag; the first with a value counts.
MEDIA_TAGS = {"img": ("src", "data-src", "srcset", "data-srcset"), "source": ("src", "srcset"), "video": ("src", "poster"), "audio": ("src",), "embed": ("src",), "object": ("data",)}
SILENT_TAGS = ("script", "style", "noscript", "template")
BLOCK_TAGS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "article", "section", "figure", "blockquote", "pre", "br", "table", "ul", "ol", "dl", "dt", "dd", "header", "footer", "main", "nav", "aside", "hr", "title")
CELL_TAGS = ("td", "th")
STORE_BYTES = 4 << 20
PART = "struct<position:int,kind:string,text:string,reference:string,caption:string>"
PART_TYPE = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("reference", pa.string()), ("caption", pa.string())])
FACTS = "digest binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"


def payload_of(text: bytes) -> bytes:
    """The text's bytes, padded with spaces to a positive multiple of the row width."""
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b" ")


def encode(payload: bytes) -> bytes:
    """An 8-bit greyscale PNG whose samples are the payload, row after row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    chunks = ((b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(lines.tobytes(), 6)), (b"IEND", b""))
    return SIGNATURE + b"".join(struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body)) for name, body in chunks)


def decode(media: bytes) -> bytes:
    """The samples of such a PNG; damaged bytes raise ValueError."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, size = 8, [], None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        name, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(name + body):
            raise ValueError("bad checksum")
        if name == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit greyscale")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("unknown row filter")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Rows, mean and spread of the samples, and a 64-bit hash of which of 64 vertical bands are brighter than their median."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    bands = grid.sum(axis=0, dtype=np.int64).reshape(64, -1).sum(axis=1)
    bits = np.packbits(bands > np.median(bands)).tobytes().hex()
    return f"rows={len(grid)} mean={grid.mean():.4f} spread={grid.std():.4f} bands={bits}"


class _Events(HTMLParser):
    """The page as a flat list of (event, tag or text, attributes)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str, dict]] = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("open", tag, dict(attrs)))

    def handle_endtag(self, tag):
        self.events.append(("close", tag, {}))

    def handle_data(self, data):
        self.events.append(("text", data, {}))


def hidden_events(events: list[tuple[str, str, dict]]) -> set[int]:
    """Events inside silent elements.  One that is never closed hides nothing, unless it is a script or style, which by HTML's rules go on to the end."""
    hidden, open_at = set(), []
    for i, (event, tag, _) in enumerate(events):
        if tag in SILENT_TAGS and event == "open":
            open_at.append((tag, i))
        elif tag in SILENT_TAGS and event == "close":
            while any(t == tag for t, _ in open_at):
                name, start = open_at.pop()
                if name == tag:
                    hidden.update(range(start, i + 1))
                    break
    for tag, start in open_at:
        if tag in ("script", "style"):
            hidden.update(range(start, len(events)))
    return hidden


def reference_of(tag: str, attrs: dict) -> str | None:
    """What a media tag refers to: the first named attribute with a value, of a source set its first entry."""
    for name in MEDIA_TAGS[tag]:
        value = (attrs.get(name) or "").strip()
        if value:
            return value.split(",")[0].split()[0] if name.endswith("srcset") and not value.startswith("data:") else value
    return None


def squeezed(pieces: list[str]) -> str:
    return " ".join("".join(pieces).split())


def sequence_of(html: str | None) -> list[dict]:
    """Ordered parts of a page: text runs and media references, captions with their media.

    A figure's caption belongs to all media of the figure, before or after it;
    without media, or outside a figure, it is text where it stands.  Figures
    may nest.  An unclosed caption ends with its figure, or at the next block or
    the page's end; unclosed figures end with the page.  Table cells are apart
    from each other by a space.
    """
    parser = _Events()
    parser.feed(html or "")
    parser.close()
    hidden = hidden_events(parser.events)
    parts: list[dict] = []
    text: list[str] = []
    figures: list[dict] = []
    caption: list[str] | None = None

    def add(kind: str, said: str | None, reference: str | None, note: str | None) -> dict:
        parts.append({"kind": kind, "text": said, "reference": reference, "caption": note})
        return parts[-1]

    def flush() -> None:
        if said := squeezed(text):
            add("text", said, None, None)
        text.clear()

    def end_caption() -> None:
        nonlocal caption
        if caption is None:
            return
        said, caption = squeezed(caption), None
        if not figures:
            text.extend([" ", said, " "])
        elif said:
            flush()
            figures[-1]["said"].append(said)
            figures[-1]["places"].append(add("caption", said, None, None))

    def end_figure() -> None:
        end_caption()
        flush()
        figure = figures.pop()
        for part in figure["media"]:
            part["caption"] = " ".join(figure["said"]) or part["caption"]
        for place in figure["places"]:
            place["kind"] = "spent" if figure["media"] else "text"

    for i, (event, tag, attrs) in enumerate(parser.events):
        if i in hidden:
            continue
        if event == "text":
            (text if caption is None else caption).append(tag)
        elif event == "open" and tag in MEDIA_TAGS:
            if reference := reference_of(tag, attrs):
                flush()
                part = add("media", None, reference, attrs.get("alt") or attrs.get("title") or None)
                if figures:
                    figures[-1]["media"].append(part)
        elif tag == "figcaption":
            end_caption()
            if event == "open":
                caption = []
        elif tag == "figure":
            if event == "open":
                end_caption()
                flush()
                figures.append({"media": [], "said": [], "places": []})
            elif figures:
                end_figure()
        elif tag in CELL_TAGS:
            (text if caption is None else caption).append(" ")
        elif tag in BLOCK_TAGS:
            if caption is None:
                flush()
            elif figures:
                caption.append(" ")
            else:
                end_caption()
                flush()
    while figures:
        end_figure()
    end_caption()
    flush()
    return [{"position": i, **part} for i, part in enumerate(p for p in parts if p["kind"] != "spent")]


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, parts): each page as an array of ordered parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = pa.array([sequence_of(h.as_py()) for h in batch.column("html")], pa.list_(PART_TYPE))
            yield pa.RecordBatch.from_arrays([batch.column("id"), parts], names=["id", "parts"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id long, parts array<{PART}>")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a page (id, html) that refers to its payload, and the payload's media (digest, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").cast(pa.binary())
            _, offsets = text_buffer(batch.column("text"))
            for i, j in slices(offsets, STORE_BYTES):
                texts = [x.as_py() or b"" for x in column.slice(i, j - i)]
                digests, media, pages = [], [], []
                for text in texts:
                    payload = payload_of(text)
                    digests.append(hashlib.sha256(payload).digest())
                    media.append(encode(payload))
                    pages.append(f'<article><p>Payload</p><figure><img src="{SCHEME}{digests[-1].hex()}"><figcaption>{len(text)} bytes</figcaption></figure></article>')
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(pages, pa.string()), pa.array(digests, pa.binary()), pa.array(media, pa.binary())], names=["doc_id", "html", "digest", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, html string, digest binary, media binary"), "media")


def media_facts(media: DataFrame) -> DataFrame:
    """Facts of every stored (digest, media), from the bytes as read back; one row for each digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column("digest"), batch.column("media")):
                raw = media.as_py()
                payload = decode(raw)
                rows.append((digest.as_py(), len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).digest(), feature_of(payload)))
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            names = [c.split()[0] for c in FACTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    facts = media.select("digest", "media").mapInArrow(run, FACTS)
    packed = facts.groupBy("digest").agg(F.max(F.struct("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")).alias("facts"))
    return packed.select("digest", "facts.*")


def resolve(sequences: DataFrame, facts: DataFrame, popular: DataFrame | None = None) -> DataFrame:
    """One row for each part of (id, parts), in its position, with the facts of the payload that it refers to.

    References to ``popular`` digests (see ``hot_keys``) are dealt in pieces.
    """
    parts = sequences.select("id", F.explode("parts").alias("part")).select("id", "part.*")
    parts = parts.withColumn("digest", F.when(F.col("reference").startswith(SCHEME), F.unhex(F.substring("reference", len(SCHEME) + 1, 64))))
    return spread_join(parts, facts, "digest", popular, "id", "left")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest columns of every text as stored media, through page, parts and digest join."""
    kept = store_texts(docs, id_col, text_col)
    found = resolve(interleave(kept, "doc_id", "html").withColumn("parts", F.filter("parts", lambda p: p["kind"] == "media")), media_facts(kept), hot_keys(kept.groupBy("digest").count(), "digest"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.regexp_extract("caption", r"^(\d+) bytes$", 1).cast("long").alias("n_bytes"),
        "payload_bytes",
        F.lower(F.hex("payload_sha256")).alias("payload_sha256"),
        "tail_crc32",
        "media_bytes",
        F.lower(F.hex("media_sha256")).alias("media_sha256"),
        "feature",
        "position",
    )


def page_parts(pages: DataFrame, store: DataFrame | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Every part of every page in its position, with the facts of its payload where ``store`` (digest, media) has it; other references keep null facts."""
    if store is None:
        store = pages.sparkSession.createDataFrame([], "digest binary, media binary")
    return resolve(interleave(pages, id_col, html_col), media_facts(store)).drop("digest").withColumnRenamed("id", id_col)
