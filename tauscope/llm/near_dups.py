"""Near-duplicate documents: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import floor, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tauscope.llm.common import digest, stash
from tauscope.llm.components import components

#: Odd multipliers of the hash that joins the words of a shingle.
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


class _Words(dict):
    """64-bit hashes of words, computed once."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def shingles(text: str | None, width: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text; A-Z count as a-z.

    With fewer words the whole sequence is the one shingle; without words there is none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_WORDS) > 1_000_000:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        out = (out ^ h[j:len(h) - n + 1 + j]) * MIX[0]
        out ^= out >> np.uint64(29)
    out *= MIX[1]
    out ^= out >> np.uint64(32)
    out *= MIX[2]
    return np.unique(out ^ (out >> np.uint64(29)))


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """``doc_id, n_shingles, sig, sketch``: size and 128-bit digest of the set, and its k smallest hashes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sigs, smallest = [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py(), width)
                sizes.append(len(s))
                sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                smallest.append(s[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(smallest, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "sig", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(reduce, f"doc_id {kind}, n_shingles long, sig binary, sketch array<long>")


def needed(k: int, similarity: int) -> int:
    """Retained values that two sketches of k values share if their sets are similar: five standard deviations under the mean."""
    t = similarity / 100
    return floor(k * t - 5 * sqrt(k * t * (1 - t)))


def families(nodes: DataFrame, k: int, similarity: int) -> DataFrame:
    """``node, family``: nodes that may be similar to another one, with a number of the group in which to look.

    Inverted lists of the retained values give overlaps. A value in one list only can't; of a node's
    other values the rarest are taken, so many that two nodes with the needed overlap must meet at
    one of them (prefix filter, rare values first). So a passage that many documents share brings
    nobody together unless it makes up most of them. A list is joined to its first node, not to
    itself: rows grow with the lists' lengths. Groups are the components of these stars.
    """
    size = F.size("sketch")
    least = F.when(F.col("n") * 100 > similarity * k, F.lit(needed(k, similarity))).otherwise(F.ceil(F.col("n") * similarity / 100)).cast("int")
    posts = nodes.select("node", least.alias("least"), F.explode("sketch").alias("v"))
    lists = posts.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    posts = posts.join(lists, "v")
    own = Window.partitionBy("node")
    posts = posts.withColumn("shared", F.count("*").over(own)).where("shared >= least")
    posts = posts.withColumn("turn", F.row_number().over(own.orderBy("df", "v"))).where("turn <= shared - least + 1")
    posts = stash(posts.select("node", "v"))
    firsts = posts.groupBy("v").agg(F.min("node").alias("first"))
    edges = posts.join(firsts, "v").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return components(edges).withColumnRenamed("root", "family")


def _incidence(sets: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(values)), np.float32)
    if len(values):
        for i, s in enumerate(sets):
            at = np.searchsorted(values, s)
            at[at == len(values)] = 0
            out[i, at[values[at] == s]] = 1
    return out


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets; only values on both sides count."""
    a, b = np.unique(np.concatenate(left)), np.unique(np.concatenate(right))
    values = np.intersect1d(a, b, assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(values), width):
        part = values[at:at + width]
        out += _incidence(left, part) @ _incidence(right, part).T
    return out.astype(np.int64)


def _estimates(left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    """Jaccard estimates of rows of padded sketches: share of the k smallest values of the union that are in both."""
    both = np.sort(np.concatenate([left, right], axis=1), axis=1)
    top = np.uint64(2**64 - 1)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != top)
    rank = np.cumsum(~twice & (both != top), axis=1)
    union = np.minimum(rank[:, -1], k)
    return (twice & (rank <= k)).sum(axis=1) / np.maximum(union, 1)


def links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None, k: int, similarity: int) -> list[tuple[int, int]]:
    """Linked pairs of two blocks of (node, set) (or within one), thinned to a forest: no more rows than nodes."""
    other = right if right is not None else left
    if not left or not other:
        return []
    a, b = [s for _, s in left], [s for _, s in other]
    na, nb = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    fits = (100 * np.minimum.outer(na, nb) >= similarity * np.maximum.outer(na, nb))
    if right is None:
        fits = np.triu(fits, 1)
    top = np.uint64(2**64 - 1)
    pad = lambda sets: np.array([np.concatenate([s[:k], np.full(k - len(s[:k]), top)]) for s in sets])
    sa, sb = pad(a), pad(b)
    i, j = np.nonzero(fits)
    # a sketch of a whole set gives no estimate but the value itself
    slack = needed(k, similarity) / k
    keep = [np.zeros(0, np.int64)]
    for at in range(0, len(i), 8192):
        part = slice(at, at + 8192)
        keep.append(at + np.nonzero(_estimates(sa[i[part]], sb[j[part]], k) >= slack)[0])
    keep = np.concatenate(keep)
    i, j = i[keep], j[keep]
    if not len(i):
        return []
    rows, columns = np.unique(i), np.unique(j)
    shared = _overlaps([a[x] for x in rows], [b[x] for x in columns])[np.searchsorted(rows, i), np.searchsorted(columns, j)]
    sure = 100 * shared >= similarity * (na[i] + nb[j] - shared)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(i[sure].tolist(), j[sure].tolist(), strict=True):
        p, q = left[x][0], other[y][0]
        if (r := root(p)) != (s := root(q)):
            parent[r] = s
            out.append((p, q))
    return out


def verified(docs: DataFrame, members: DataFrame, width: int, k: int, similarity: int, block: int = 256) -> DataFrame:
    """Edges ``a, b`` that connect what is similar within each family, by exact comparison of whole sets.

    A family is dealt into blocks of about ``block`` nodes, and every pair of blocks is one unit of work: no family
    has to fit anywhere, its comparisons spread over tasks, and a unit returns a forest, not pairs.
    """
    sizes = members.groupBy("family").agg(F.count("*").alias("m"))
    members = members.join(sizes, "family").where("m > 1")
    blocks = F.ceil(F.col("m") / block).cast("int")
    # written, so that its size is known: the estimate of a join is the product of its sides, and would shuffle all texts
    members = stash(members.select("node", "family", blocks.alias("blocks"), (digest("node") % blocks).cast("int").alias("block")))
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(members, "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "family", "blocks", "block")], pa.array(found, pa.list_(pa.int64()))],
                                             ["node", "family", "blocks", "block", "values"])

    units = texts.mapInArrow(sets, "node long, family long, blocks int, block int, values array<long>")
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "values")
    units = units.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")

    def work(unit: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
        sides = [[(node, values) for block, node, values in rows if block == side] for side in unit[1:]]
        return links(sides[0], None if unit[1] == unit[2] else sides[1], k, similarity)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, rows = None, []
        for frame in frames:
            found = []
            for family, i, j, block, node, values in frame.itertuples(index=False, name=None):
                if (family, i, j) != unit:
                    if rows:
                        found += work(unit, rows)
                    unit, rows = (family, i, j), []
                rows.append((block, node, np.asarray(values, np.int64).view(np.uint64)))
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")
        if rows:
            yield pd.DataFrame(work(unit, rows), columns=["a", "b"]).astype("int64")

    return units.mapInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, k: int = 64, similarity: int = 80) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``similarity`` per cent or more.

    Returns ``doc_id, n_shingles, component_id, kept``, one row per document: the size of the set,
    the smallest id that links reach, and whether that is the document itself. Documents with equal
    sets become one node first, so a crowd of copies is one node. Candidates come from sketches of
    k values; a link is confirmed on the whole sets. A pair at the limit is missed only if its
    sketches differ from the sets by five standard deviations, and never if both sets have at most
    k shingles.

    Without words (or text) a document has no shingles, is linked with nothing and kept. Rows without
    an id have no component and are kept; rows with the same id count as one document. An empty
    table gives no rows.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    table = stash(sketches(docs, width, k))
    named = table.where("sig is not null and doc_id is not null")
    nodes = named.groupBy("sig").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = stash(nodes)
    members = stash(families(nodes, k, similarity))
    roots = components(verified(docs, members, width, k, similarity))
    classes = nodes.select("sig", "node").join(roots, "node", "left").select("sig", F.coalesce("root", "node").alias("_root"))
    out = table.select("doc_id", "n_shingles", "sig").join(classes, "sig", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their group, with the columns of ``docs``: one row of each group.

    A row is a document by itself, whatever its id: repeated rows, and copies without an id, are a group like any other. Rows whose id is null
    or stands in several rows are written with numbers above all ids, the others keep their id, and the smallest number of a
    group stays. So texts are only written where ids do not tell rows apart. Rows without words are no copies of each other and
    all stay. Ids up to 2^62.
    """
    key = F.col("doc_id").cast("long")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    counts = docs.groupBy(key.alias("_many")).agg(F.count("*").alias("_rows"))
    twice = stash(counts.where("_rows > 1 and _many is not null").select("_many"))
    top = counts.agg(F.max("_many")).first()[0] or 0

    def own(column: Column) -> DataFrame:
        return docs.where(key.isNotNull()).select(key.alias("_id"), column).join(twice, F.col("_id") == F.col("_many"), "left_anti")

    unclear = docs.where(key.isNull()).select(key.alias("_id"), whole).unionByName(
        docs.where(key.isNotNull()).select(key.alias("_id"), whole).join(twice, F.col("_id") == F.col("_many"), "left_semi"))
    unclear = stash(unclear.select((F.monotonically_increasing_id() + F.lit(top + 1)).alias("_id"), "_row"))
    texts = own(F.col("text").alias("text")).unionByName(unclear.select("_id", F.col("_row.text").alias("text")))
    gone = near_duplicates(texts.select(F.col("_id").alias("doc_id"), "text"), **options).where(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    return own(whole).unionByName(unclear).join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
