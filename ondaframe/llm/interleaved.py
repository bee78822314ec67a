"""Interleaved documents: ordered text and media references, resolved by digest.

HTML is parsed to an ordered array of structs (pos, kind, text, ref, caption):
runs of text, and references to media in the place where they stand.  A media
store is a table keyed by the SHA-256 of the stored bytes.  References are
resolved by a join on the digest, and go back to their positions with their
captions.  Only what a reader asks for travels through the join; the payload
stays where it was stored unless it is asked for.

Stored form: a binary greymap (PGM, 8-bit samples, 576 to a line), lossless.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_out

WIDTH = 576
_ITEMS = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"
#: HTML elements (fixed values): those that end a run of text, those whose content is no text, those that refer to media.
_BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
_SILENT = {"head", "noscript", "script", "style", "template"}
_IN_HEAD = {"base", "basefont", "bgsound", "head", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
_MEDIA = {"audio", "embed", "iframe", "img", "source", "video"}
_BLANKS = re.compile(r"\s+")


class _Sequence(HTMLParser):
    """silences: the elements whose content is left out."""

    def __init__(self, silences: set[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.silences = silences
        self.items: list[dict] = []
        self.run: list[str] = []
        self.silent: list[str] = []
        self.figure: list[list[dict]] = []
        self.caption = 0

    def flush(self) -> None:
        text = _BLANKS.sub(" ", "".join(self.run)).strip()
        self.run.clear()
        if not text:
            return
        if self.caption and self.figure:
            for m in self.figure[-1]:
                m["caption"] = text
            self.figure[-1].append({"late": text})
        else:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.silent == ["head"] and tag not in _IN_HEAD:  # whatever cannot stand in a head ends it
            self.silent.clear()
        if tag in self.silences:
            self.silent.append(tag)
        if self.silent:
            return
        if tag in _BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure.append([])
        elif tag == "figcaption":
            self.caption += 1
        elif tag in _MEDIA:
            a = dict(attrs)
            if a.get("src"):
                self.flush()
                item = {"kind": "media", "text": None, "ref": a["src"], "caption": a.get("alt") or None}
                self.items.append(item)
                if self.figure:
                    for m in self.figure[-1]:
                        if "late" in m:  # the caption came first
                            item["caption"] = m["late"]
                    self.figure[-1].append(item)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in self.silent:
                del self.silent[self.silent.index(tag) :]
            return
        if tag in _BLOCKS:
            self.flush()
        if tag == "figcaption" and self.caption:
            self.caption -= 1
        if tag == "figure" and self.figure:
            self.figure.pop()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.run.append(data)


def parse(html: str | None) -> list[dict]:
    """Ordered items of a page; null and empty pages have none.

    A head ends where something stands that no head can hold.  A head, noscript
    or template that never ends is read as if its tag were not there; a script
    or style that never ends goes on to the end of the page, as in browsers.
    """
    silences = set(_SILENT)
    while True:
        p = _Sequence(silences)
        p.feed(html or "")
        p.close()
        p.flush()
        open_ = set(p.silent) - {"script", "style"}
        if not open_:
            break
        silences -= open_
    return [{"pos": k, "kind": i["kind"], "text": i["text"], "ref": i["ref"], "caption": i["caption"]} for k, i in enumerate(p.items)]


def parse_sequences(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key and items of every row.  Narrow; other columns are not read."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse(h) for h in batch.column(1).to_pylist()], pa.list_(item))], [key, "items"])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, items {_ITEMS}")


def resolve(sequences: DataFrame, media: DataFrame, key: str, digest: str, columns: list[str], prefix: str = "sha256:") -> DataFrame:
    """Sequences with media items resolved: a row per item, in pos order within its key by sorting.

    media is first brought to one row per digest, so that repeated payloads do
    not multiply items.  Items without a match keep null columns.  A digest
    that more items refer to than an even share of a partition is split: its
    items are dealt over as many salts as it has shares, and its payload is
    sent to each.  Such digests are at most a few per partition, and only they
    are broadcast.  Columns of media may not be named like the key or an item's
    fields (ValueError).
    """
    clash = {key.lower(), "pos", "kind", "text", "ref", "caption"} & {c.lower() for c in columns}
    if clash or key.lower() in ("pos", "kind", "text", "ref", "caption"):
        raise ValueError(f"names clash with those of items: {sorted(clash) or key}")
    spark = sequences.sparkSession
    ref = F.when(F.col("ref").startswith(prefix), F.substring("ref", len(prefix) + 1, 64))
    items = stage_out(sequences.select(key, F.explode_outer("items").alias("i")).select(key, "i.*").withColumn("_digest", ref), "items")
    refs = items.where(F.col("_digest").isNotNull()).groupBy("_digest").agg(F.count("*").alias("n"))
    shares = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, -(-items.count() // shares))
    hot = stage_out(refs.where(F.col("n") > share).select("_digest", F.ceil(F.col("n") / share).cast("int").alias("_salts")), "hot-digests")
    # fewer than `shares` rows, by the threshold
    salted = items.join(F.broadcast(hot), "_digest", "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(key, "pos"), F.col("_salts")).cast("int"), F.lit(0)))
    once = media.groupBy(F.col(digest).alias("_digest")).agg(*[F.first(c).alias(c) for c in columns])
    dealt = once.join(F.broadcast(hot), "_digest", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
    return salted.drop("_salts").join(dealt.drop("_salts"), ["_digest", "_salt"], "left").drop("_digest", "_salt")


def payload(text: Column) -> Column:
    """UTF-8 bytes (null: none), then bytes 255 up to a positive multiple of WIDTH."""
    b = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(b)
    full = F.greatest(F.ceil(n / WIDTH), F.lit(1)) * WIDTH
    return F.concat(b, F.unhex(F.repeat(F.lit("FF"), (full - n).cast("int"))))


def stored(samples: Column) -> Column:
    """The greymap of a payload."""
    head = F.concat(F.lit(f"P5\n{WIDTH} "), (F.octet_length(samples) / WIDTH).cast("bigint").cast("string"), F.lit("\n255\n"))
    return F.concat(F.encode(head, "UTF-8"), samples)


def read_stored(media: bytes) -> memoryview:
    """Samples of a stored greymap."""
    magic, size, depth = media[:64].split(b"\n", 3)[:3]
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255":
        raise ValueError("not an 8-bit greymap")
    at = len(magic) + len(size) + len(depth) + 3
    if len(media) - at != width * height:
        raise ValueError("a greymap of another size than its header says")
    return memoryview(media)[at:]


def feature(samples: memoryview) -> str:
    """Lines, mean and deviation of the samples, and a 64-bit difference hash of an 8 x 9 thumbnail."""
    x = np.frombuffer(samples, np.uint8)
    lines = x.reshape(-1, WIDTH)
    cols = lines.reshape(len(lines), 9, 64).sum(axis=2, dtype=np.int64)
    edge = (np.arange(9) * len(lines)) // 8
    sums = np.concatenate([np.zeros((1, 9), np.int64), np.cumsum(cols, axis=0)])
    rows = np.maximum(edge[1:], edge[:-1] + 1)
    thumb = (sums[rows] - sums[edge[:-1]]) * 840 // (rows - edge[:-1])[:, None]
    bits = np.packbits(thumb[:, 1:] > thumb[:, :-1]).tobytes().hex()
    count = np.bincount(x, minlength=256)
    value = np.arange(256)
    n, s1, s2 = len(x), int(count @ value), int(count @ (value * value))
    return f"{len(lines)}:{s1 / n:.4f}:{max(0.0, s2 / n - (s1 / n) ** 2) ** 0.5:.4f}:{bits}"


def read_media(media: DataFrame) -> DataFrame:
    """What the stored bytes, read back, say: digest, sizes, checks and features.  Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                b = m.as_py()
                p = read_stored(b)
                out.append((hashlib.sha256(b).hexdigest(), len(b), n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), feature(p)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["media_sha256", "media_bytes", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    return media.select("media", "n_bytes").mapInArrow(run, "media_sha256 string, media_bytes bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string")


def store_media(docs: DataFrame) -> DataFrame:
    """Write every text's greymap to the shared folder; media, n_bytes, reread."""
    text = F.coalesce("text", F.lit(""))
    return stage_out(docs.select(stored(payload(F.col("text"))).alias("media"), F.octet_length(text).cast("bigint").alias("n_bytes")), "media")


def as_page(docs: DataFrame) -> DataFrame:
    """doc_id and a page that shows the document's greymap between two lines of text, captioned by the text's size."""
    size = F.concat(F.octet_length(F.coalesce("text", F.lit(""))).cast("string"), F.lit(" bytes &amp; padding"))
    digest = F.sha2(stored(payload(F.col("text"))), 256)
    return docs.select("doc_id", F.concat(F.lit("<article><p>Stored text:</p><figure><img src=\"sha256:"), digest, F.lit('" alt="text"><figcaption>'), size, F.lit("</figcaption></figure><p>End of text.</p></article>")).alias("html"))


def document_media(docs: DataFrame) -> DataFrame:
    """A row per document: its stored form and features, by way of its interleaved page.

    Null and empty texts are one line of 255s.  Repeated rows stay; an empty
    table gives no rows; other columns are not read.
    """
    media = read_media(store_media(docs))
    columns = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"]
    known = media.select(F.col("media_sha256").alias("digest"), "media_sha256", *columns)
    sequences = parse_sequences(as_page(docs), "doc_id")
    return resolve(sequences, known, "doc_id", "digest", [*columns, "media_sha256"]).where(F.col("kind") == "media").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")
