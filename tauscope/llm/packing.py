"""Harmonic packing: token pieces in reciprocal-capacity classes, a fixed number of pieces to a bin."""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tauscope.llm.common import digest, stash

#: The special string of the vocabulary, and the pattern by which byte-level vocabularies cut a text before their merges.
SPECIAL = "<|endoftext|>"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space before anything but white space: the pattern always cuts there, whatever stands around it.
SURE = re.compile(r" (?=\S)")
DOUBTFUL = re.compile(r" (?!\S)")
#: Strings whose ids a worker remembers before it starts afresh.
REMEMBERED = 1_000_000


class _Known(dict):
    """Ids of strings that follow a space, as little-endian unsigned 32-bit bytes; looked up once."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, text: str) -> bytes:
        ids = self[text] = array("I", self.encode(" " + text)).tobytes()
        return ids


class Encoder:
    """Token ids of a text as bytes: it is cut where the vocabulary's pattern cuts for sure, and every part is encoded once."""

    def __init__(self, path: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = array("I", [len(ranks)]).tobytes()
        self.known = _Known(self.encode)

    def plain(self, text: str) -> bytes:
        head, *rest = SURE.split(text) if DOUBTFUL.search(text) else text.split(" ")
        return array("I", self.encode(head)).tobytes() + b"".join(map(self.known.__getitem__, rest))

    def __call__(self, text: str) -> bytes:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return self.special.join(map(self.plain, text.split(SPECIAL)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(tokens: int, capacity: int, tail: int = 16) -> list[int]:
    """Lengths into which a document of ``tokens`` ids is cut.

    Whole bins first. What is left is cut at the upper edge of its class, capacity // k, so that k
    pieces leave almost no room; what is left then is cut in the same way, until a piece is so
    short (class ``tail`` or more) that its own class wastes little.
    """
    whole, rest = divmod(tokens, capacity)
    out = [capacity] * whole
    while rest:
        k = -(-capacity // rest)
        edge = capacity // k
        if k >= tail or edge == rest:
            out.append(rest)
            break
        out.append(edge)
        rest -= edge
    return out


def pieces(docs: DataFrame, ranks: str, capacity: int, end: int = 1, with_ids: bool = False, rows: int = 256) -> DataFrame:
    """One row per piece of every document: ``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``).

    A null or empty text has the end id alone. Whole texts are encoded, ``rows`` at a time.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    stop = np.asarray([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                found: list[tuple[int, int, int, int, int]] = []
                ids: list[np.ndarray] = []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    data = encode(text or "") + stop
                    start = 0
                    for n in cuts(len(data) // 4, capacity):
                        piece = data[4 * start:4 * (start + n)]
                        found.append((i, start, n, zlib.crc32(piece), len(data) // 4))
                        if with_ids:
                            ids.append(np.frombuffer(piece, "<i4"))
                        start += n
                if found:
                    i, *rest = (pa.array(x, pa.int64()) for x in zip(*found, strict=True))
                    columns = [batch.column("doc_id").take(i), *rest] + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def _first_fit(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bins for the unfilled bins of the classes, longest first; at most one row per class."""
    frame = frame.sort_values(["used", "class"], ascending=[False, True])
    room: list[int] = []
    bins = []
    for used in frame["used"]:
        at = next((i for i, r in enumerate(room) if r >= used), len(room))
        if at == len(room):
            room.append(capacity)
        room[at] -= used
        bins.append(at)
    return pd.DataFrame({"class": frame["class"], "bin": bins})


def pack(docs: DataFrame, ranks: str, capacity: int = 2048, end: int = 1, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of ``capacity`` tokens; one row per piece.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).
    Pieces of length capacity/(k+1) < n <= capacity/k form class k, and every bin of the class
    takes k of them. Workers hold ranges of a hash; from the counts per class and range alone each
    knows which numbers its pieces have, so it fills bins without seeing another worker's pieces.
    The one unfilled bin of each class (fewer than ``2 sqrt(capacity)`` classes) shares sequences
    with others by first fit. ``ranks`` is the path, on every executor, of a byte-level vocabulary's rank file; its special
    string gets the next free id, as in the vocabulary's other form. Two rows with the same id and text are packed twice. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    cut = pieces(docs, ranks, capacity, end, with_ids)
    cut = cut.withColumn("_class", F.floor(capacity / F.col("length")).cast("int")).withColumn("_h", digest("doc_id", "start"))
    whole = stash(cut.withColumn("_piece", F.monotonically_increasing_id()))
    cut = whole.drop("ids")  # the ids stay where they are until every piece has its place
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.withColumn("_range", F.floor(F.col("_h") / (2**60 // ranges + 1)).cast("int"))
    counts = cut.groupBy("_class", "_range").agg(F.count("*").alias("_n"), F.sum("length").alias("_l"))
    before = Window.partitionBy("_class").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    order = ["_h", "doc_id", "start", "ids_crc32", "_piece"]
    place = Window.partitionBy("_class", "_range").orderBy(*order)
    cut = cut.withColumn("_row", F.row_number().over(place) - 1).join(counts.select("_class", "_range", "_before"), ["_class", "_range"])
    cut = stash(cut.withColumn("_rank", F.col("_before") + F.col("_row")).drop("_row", "_before", "_range"))
    # one row per class: at most 2 sqrt(capacity) rows
    classes = cut.groupBy("_class").agg(F.count("*").alias("_n"))
    classes = classes.withColumn("_full", F.floor(F.col("_n") / F.col("_class")).cast("long"))
    partial = cut.join(F.broadcast(classes), "_class").where(F.col("_rank") >= F.col("_full") * F.col("_class"))
    partial = partial.groupBy(F.col("_class").alias("class")).agg(F.sum("length").alias("used"))
    shared = partial.groupBy().applyInPandas(lambda frame: _first_fit(frame, capacity), "class int, bin long")
    running = Window.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("_base", F.coalesce(F.sum("_full").over(running), F.lit(0)))
    classes = classes.withColumn("_all", F.sum("_full").over(Window.partitionBy()))
    classes = classes.join(shared, F.col("_class") == F.col("class"), "left").drop("class", "_n")
    out = cut.join(F.broadcast(classes), "_class")
    bins = F.floor(F.col("_rank") / F.col("_class")).cast("long")
    out = out.withColumn("sequence_id", F.when(bins < F.col("_full"), F.col("_base") + bins).otherwise(F.col("_all") + F.col("bin")))
    inside = Window.partitionBy("sequence_id").orderBy("_class", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    if with_ids:
        out = out.join(whole.select("_piece", "ids"), "_piece")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))
