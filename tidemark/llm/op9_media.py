"""Interleaved document sequences with media columns.

A page's HTML yields an ordered sequence of structs: runs of text, and references to media with their digest and caption.
Payloads are kept in a media table by digest; references are resolved by a join on the digest, so that a payload that many
documents share is stored and read once, and positions and captions stay with their reference.

Any bytes can be a medium: they are padded with zeros to a positive multiple of 64 and stored as a binary grey-scale image
(PGM, "P5") of 64 samples a row, one 8-bit sample a byte, which is lossless.

A document's text becomes a page with one reference, to the stored form of its bytes; the page's sequence is read from its
HTML and its reference resolved, by digest, to what is read back from the media table on disk. A stored form whose bytes don't
have the digest it is filed under is an error.

Defined cases: null html and null text count as empty; a reference whose payload is missing resolves to nulls; repeated rows
and keys give repeated rows; equal payloads have equal digests and are one medium, so ties can't arise; a digest that most
rows refer to is dealt over tasks; texts of any length are stored whole; an empty table gives an empty result. Extra columns
are not carried, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.markup import BLOCK, RAW, parse, walk
from tidemark.llm.shared import spread_join, written

UNIT = 64
SCHEME = "sha256:"
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(data: bytes) -> bytes:
    return data + bytes(max(UNIT, -len(data) % UNIT + len(data)) - len(data))


def to_image(payload: bytes) -> bytes:
    """The stored form of a payload of a multiple of 64 bytes."""
    return b"P5\n%d %d\n255\n" % (UNIT, len(payload) // UNIT) + payload


def from_image(media: bytes) -> bytes:
    """The samples of a stored image, read by its header."""
    magic, size, most, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or int(most) != 255 or len(samples) != width * height:
        raise ValueError("not a stored 8-bit image")
    return samples


def feature(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and their shares in eight bands."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, levels = len(samples), np.arange(256)
    mean = float(counts @ levels) / n
    spread = max(float(counts @ (levels * levels)) / n - mean * mean, 0.0) ** 0.5
    p = counts[counts > 0] / n
    bands = counts.reshape(8, 32).sum(axis=1) / n
    return f"mean={mean:.4f};std={spread:.4f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};bands=" + ",".join(f"{b:.4f}" for b in bands)


def _stored(batches):
    """key, bytes -> key, n_bytes, digest, media"""
    for batch in batches:
        data = [d or b"" for d in batch.column(1).cast(pa.large_binary()).to_pylist()]
        media = [to_image(padded(d)) for d in data]
        digest = [hashlib.sha256(m).hexdigest() for m in media]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array(digest, pa.string()), pa.array(media, pa.binary())], names=["k", "n_bytes", "digest", "media"])


def stored(rows: DataFrame, key: str, content: str) -> DataFrame:
    """k, n_bytes, digest and media (the stored form) of every row's content."""
    own = rows.select(F.col(key).alias("k"), F.col(content).cast("binary").alias("c"))
    return own.mapInArrow(_stored, f"k {own.schema['k'].dataType.simpleString()}, n_bytes long, digest string, media binary")


def _read_back(batches):
    for batch in batches:
        rest = [batch.column(i) for i in range(batch.num_columns - 1)]
        rows = []
        for digest, media in zip(batch.column("digest").to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            found = hashlib.sha256(media).hexdigest()
            if found != digest:
                raise ValueError(f"stored under {digest}, read back as {found}")
            samples = from_image(media)
            rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), found, feature(samples)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([*rest, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*batch.schema.names[:-1], "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def read_back(media: DataFrame) -> DataFrame:
    """The frame (with a column digest) with its last column, the stored form, read back and replaced by features of what was
    read."""
    front = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in media.schema.fields[:-1])
    return media.mapInArrow(_read_back, f"{front}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def sequence(source: str | None) -> list[tuple[int, str, str | None, str | None, str | None]]:
    """(position, kind, text, digest, caption) of a page's text runs and media references, in page order.

    A reference is an img, video, audio, source or embed whose src is sha256: and a digest. Its caption is the figcaption of
    the figure it stands in, else its alt or title.
    """
    items: list[list] = []
    line: list[str] = []
    open_figures: list[list[int]] = []
    caption: list[str] | None = None

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            items.append([len(items), "text", text, None, None])

    for node, begins in walk(parse(source)):
        if begins is None:
            if caption is not None:
                caption.append(node)
            else:
                line.append(node)
            continue
        if node.tag in RAW:
            if begins:
                node.children.clear()
            continue
        if node.tag in BLOCK:
            flush()
        if node.tag == "br" and begins:
            (line if caption is None else caption).append(" ")
        if node.tag == "figure":
            if begins:
                open_figures.append([])
            elif open_figures:
                open_figures.pop()
        elif node.tag == "figcaption":
            if begins:
                caption = []
            elif caption is not None:
                text, caption = " ".join("".join(caption).split()), None
                if open_figures and open_figures[-1]:
                    for i in open_figures[-1]:
                        items[i][4] = text or items[i][4]
                elif text:
                    line.append(text)
                    flush()
        elif begins and node.attributes.get("src", "").startswith(SCHEME):
            flush()
            if open_figures:
                open_figures[-1].append(len(items))
            items.append([len(items), "media", None, node.attributes["src"][len(SCHEME) :].lower(), " ".join((node.attributes.get("alt") or node.attributes.get("title") or "").split()) or None])
    flush()
    return [tuple(x) for x in items]


def _sequences(batches):
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
    names = ("position", "kind", "text", "digest", "caption")
    for batch in batches:
        rows = [[dict(zip(names, x, strict=True)) for x in sequence(s)] for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["k", "items"])


def sequences(pages: DataFrame, key: str, html: str) -> DataFrame:
    """k and items (the interleaved sequence) of every page."""
    own = pages.select(F.col(key).alias("k"), F.col(html).alias("h"))
    return own.mapInArrow(_sequences, f"k {own.schema['k'].dataType.simpleString()}, items array<{ITEM}>")


def resolve(items: DataFrame, media: DataFrame) -> DataFrame:
    """Rows (k, position, kind, text, digest, caption and the media table's columns), one for each item of each sequence.

    The media table has a row for each digest. Text items have no digest and aren't moved by the join.
    """
    flat = items.select("k", F.explode("items").alias("i")).select("k", "i.*")
    text = flat.filter("digest is null")
    found = spread_join(flat.filter("digest is not null"), media, "digest")
    return text.unionByName(found, allowMissingColumns=True)


def _shared_slots(refs: DataFrame) -> np.ndarray:
    """A bit for each of 2^24 slots of digests: set where one stands in several rows."""
    often = refs.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    slots = often.select(F.conv(F.substring("digest", 1, 6), 16, 10).cast("int").alias("s")).distinct().toArrow().column(0).to_numpy()
    bits = np.zeros(1 << 24, bool)
    bits[slots] = True
    return np.packbits(bits)


def _stored_where(bits: np.ndarray, shared: bool):
    def run(batches):
        for batch in _stored(batches):
            slots = np.array([int(d[:6], 16) for d in batch.column(2).to_pylist()], np.int64)
            yield batch.filter(pa.array((bits[slots >> 3] >> (7 - (slots & 7)) & 1).astype(bool) == shared)).select(["digest", "media"])

    return run


def media_table(rows: DataFrame, content: str, refs: DataFrame) -> DataFrame:
    """digest and media (the stored form), written once for each digest.

    Payloads whose digest stands in one row alone are written where they are read; only others are dealt out by digest.
    """
    own, bits = rows.select(F.lit(0).alias("k"), F.col(content).cast("binary").alias("c")), _shared_slots(refs)
    alone, several = (own.mapInArrow(_stored_where(bits, shared), "digest string, media binary") for shared in (False, True))
    return written(alone.unionByName(several.dropDuplicates(["digest"])), "media")


def reference_page(digest: str = "digest"):
    """HTML of a page that refers to one medium."""
    return F.concat(F.lit(f'<figure><img src="{SCHEME}'), F.col(digest), F.lit('"></figure>'))


def document_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document as a sequence of one reference to its stored text, resolved by digest to what is read back from the
    media table."""
    refs = written(stored(docs, key, text).drop("media"), "references")
    features = written(read_back(media_table(docs, text, refs)), "features")
    pages = refs.select(F.struct("k", "n_bytes").alias("k"), reference_page().alias("html"))
    found = resolve(written(sequences(pages, "k", "html"), "sequences"), features)
    return found.select("k.k", "k.n_bytes", *(c for c in found.columns if c != "k"))


def op9_media(spark, sf_dir: str) -> DataFrame:
    found = document_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("k").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
