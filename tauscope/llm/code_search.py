"""Exact top-k search of binary codes by incremental multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a segment.
SEGMENT = 16


def sign_bits(vector: Column) -> Column:
    """Code of a vector as an array of 16-bit numbers, one per 16 dimensions: bit i is set if value i is 0 or more. Null for null or empty."""
    groups = F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / SEGMENT).cast("int"))
    bits = lambda g: F.transform(F.slice(vector, g * SEGMENT + 1, F.lit(SEGMENT)), lambda x, i: F.when(x >= 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("long"))
    return F.when(F.size(vector) > 0, F.transform(groups, lambda g: F.aggregate(bits(g), F.expr("0L"), lambda a, b: a + b).cast("int")))


class Index:
    """The rows of one block, by the value of every segment."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.codes, self.ids = codes[order], ids[order]
        self.lists = []
        for segment in self.codes.T:
            rows = np.argsort(segment, kind="stable")
            self.lists.append((rows, np.searchsorted(segment[rows], np.arange((1 << SEGMENT) + 1))))

    def search(self, code: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k nearest ``(distance, id)``, by distance and then id.

        Radius r of the segments finds every code within r in some segment, so every code whose
        distance is under ``segments * (r + 1)``: when k verified distances are, no other can be nearer or equal.
        """
        m = len(self.lists)
        seen = np.zeros(len(self.ids), bool)
        rows, far = np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = min(k, len(self.ids))
        for radius in range(SEGMENT + 1):
            found = []
            for (order, starts), value in zip(self.lists, code, strict=True):
                near = masks(radius) ^ value
                a, b = starts[near], starts[near + 1]
                n = b - a
                if total := int(n.sum()):
                    found.append(order[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)])
            if found:
                new = np.unique(np.concatenate(found))
                new = new[~seen[new]]
                seen[new] = True
                rows = np.concatenate([rows, new])
                far = np.concatenate([far, np.bitwise_count(self.codes[new] ^ code).sum(axis=1)])
            if len(rows) >= k and (np.partition(far, k - 1)[k - 1] < m * (radius + 1) if k else True):
                break
        best = np.lexsort((self.ids[rows], far))[:k]
        return list(zip(far[best].tolist(), self.ids[rows][best].tolist(), strict=True))


_MASKS: dict[int, np.ndarray] = {}


def masks(radius: int) -> np.ndarray:
    """All segment values with ``radius`` bits set."""
    if radius not in _MASKS:
        _MASKS[radius] = np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT), radius)], np.int64)
    return _MASKS[radius]


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, block: int = 16384, query_block: int = 1024) -> DataFrame:
    """The ``k`` nearest rows of every query by Hamming distance: ``query_id, neighbor_id, distance, rank``.

    ``rows`` and ``queries`` have ``id`` (long) and ``code`` (array of 16-bit numbers, see :func:`sign_bits`). Rows are dealt
    by a hash into blocks of about ``block``, queries into blocks of about ``query_block``; every pair of
    blocks is one unit of work with an index of its own, and the k best of the units are merged. So no
    task holds more than two blocks, and a crowd of equal codes spreads over all of them. Ties go to the smaller id; a
    query that is a row finds itself at distance 0. Without an id or a code a row is neither found nor
    asked for, nor is one of another length than its partner. With fewer than k rows all are returned. Empty tables give no rows.
    """
    rows, queries = (d.where("id is not null and code is not null").select("id", "code") for d in (rows, queries))
    n, m = rows.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))
    left = rows.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.withColumn("_q", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    units = left.withColumn("ask", F.lit(False)).unionByName(right.withColumn("ask", F.lit(True))).withColumn("_n", F.size("code"))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        asked = frame["ask"].to_numpy(bool)
        if asked.any() and not asked.all():
            codes, ids = np.array(frame["code"].tolist(), np.int64), frame["id"].to_numpy(np.int64)
            index = Index(codes[~asked], ids[~asked])
            for code, query in zip(codes[asked], ids[asked], strict=True):
                out += [(query, neighbor, distance) for distance, neighbor in index.search(code, k)]
        return pd.DataFrame(out, columns=["query_id", "neighbor_id", "distance"]).astype("int64")

    found = units.groupBy("_b", "_q", "_n").applyInPandas(search, "query_id long, neighbor_id long, distance long")
    best = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
