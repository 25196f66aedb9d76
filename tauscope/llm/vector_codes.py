"""Vector code compression: codes of parts by exact integer k-means, with distances pruned by fixed pivots (LAESA)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tauscope.llm.common import stash

#: A component is a whole number of 1/4096; beyond 2^62 it stays there. Up to 2^24 sums of squares fit 64 bits for any usual length.
UNIT, MOST, NARROW = 4096.0, float(1 << 62), 1 << 24
#: Copies of the table of label sums that the rows of one label are dealt to.
SALTS = 16

Books = list[np.ndarray]  # of every part: entries x components


def whole_numbers(vector: Column) -> Column:
    """floor(4096 x) of every component."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * UNIT), F.lit(1 << 62)), F.lit(-(1 << 62))).cast("long"))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, in Python's numbers where 64 bits could overflow."""
    return ((x - c) ** 2).sum(axis=1)


def roots(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def pivots_of(book: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` entries that lie far apart: the first, then always the one farthest from those picked."""
    picked = [0] if len(book) else []
    while 0 < len(picked) < min(n, len(book)):
        near = np.min([squares(book, book[i][None]) for i in picked], axis=0)
        if near.max() == 0:
            break
        picked.append(int(np.argmax(near)))
    return book[picked]


def nearest(x: np.ndarray, far: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of every row (ties: lower index), its exact squared distance, and the number of distances evaluated.

    ``far`` holds the distances of the rows from the pivots. By the triangle inequality an entry is no
    nearer than the largest difference of its and the row's pivot distances. Entries are visited in the order of that bound; a row is
    done as soon as the bound, less what rounding may add, is beyond the best exact distance.
    """
    n, k = len(x), len(book)
    bound = np.zeros((n, k))
    for j, pivot in enumerate(pivots):
        np.maximum(bound, np.abs(far[:, j, None] - roots(squares(book, pivot[None]))[None]), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    best_index = order[:, 0].copy()
    best = squares(x, book[best_index])
    evaluated, rows = n, np.arange(n)
    for visit in range(1, k):
        entry = order[rows, visit]
        low = bound[rows, entry]
        # square roots and differences of pivot distances err by some units in the last place of the larger one
        slack = 1e-14 * far[rows].max(axis=1, initial=0.0) + 1e-14 * low
        open_ = np.maximum(low - 4 * slack, 0.0) ** 2 * (1 - 1e-12) <= best[rows].astype(np.float64) * (1 + 1e-12)
        rows, entry = rows[open_], entry[open_]
        if not len(rows):
            break
        d = squares(x[rows], book[entry])
        evaluated += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (entry < best_index[rows]))
        best[rows[better]], best_index[rows[better]] = d[better], entry[better]
    return best_index, best, evaluated


def _block(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Rows x components of a batch, as 64-bit or, if large, as Python's numbers."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return x if not x.size or np.abs(x).max() <= NARROW else x.astype(object)


def _like(x: np.ndarray, books: Books) -> tuple[np.ndarray, Books]:
    """Rows and entries in one kind of number."""
    if x.dtype != object and all(b.dtype != object for b in books):
        return x, books
    return x.astype(object), [b.astype(object) for b in books]


def learn(rows: DataFrame, first: Books, pivots: Books, rounds: int) -> Books:
    """Codebooks after ``rounds`` rounds over ``x`` and ``far`` of ``rows``.

    A task adds its rows up to one sum per part and entry; Spark adds the tasks' sums. Only codebooks (parts x entries x
    components of a part, whatever the number of rows) go to the driver and back.
    """
    width, parts = sum(b.shape[1] for b in first), len(first)
    books = first
    for _ in range(rounds):

        def add(batches: Iterator[pa.RecordBatch], books: Books = books) -> Iterator[pa.RecordBatch]:
            count = [np.zeros(len(b), np.int64) for b in books]
            total = [np.zeros(b.shape, object) for b in books]
            for batch in batches:
                x, own = _like(_block(batch, width), books)
                far = batch.column("far").flatten().to_numpy(zero_copy_only=False).reshape(len(x), parts, -1)
                for p, part in enumerate(np.split(x, parts, axis=1)):
                    index = nearest(part, far[:, p, :len(pivots[p])], own[p], pivots[p])[0]
                    count[p] += np.bincount(index, minlength=len(own[p]))
                    for e in np.unique(index):
                        total[p][e] += part[index == e].sum(axis=0)
            keys = [(p, e) for p in range(parts) for e in np.flatnonzero(count[p])]
            yield pa.RecordBatch.from_arrays([
                pa.array([p for p, _ in keys], pa.int32()), pa.array([e for _, e in keys], pa.int32()), pa.array([count[p][e] for p, e in keys], pa.int64()),
                pa.array([[str(v) for v in total[p][e]] for p, e in keys], pa.list_(pa.string()))], ["p", "e", "n", "sums"])

        sums = rows.select("x", "far").mapInArrow(add, "p int, e int, n long, sums array<string>")
        sums = sums.select("p", "e", "n", F.posexplode("sums").alias("i", "v")).groupBy("p", "e", "i").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        books = [b.astype(object) for b in books]
        for r in sums.collect():
            books[r.p][r.e, r.i] = int(r.v) // r.n
        books = [b if any(abs(v) > NARROW for v in b.flat) else b.astype(np.int64) for b in books]
    return books


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, pivots: int = 4) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector without null or non-finite components.

    Components become floor(4096 x), vectors are cut into ``parts`` equal parts. A part's codebook starts as that part of the vectors with the
    ``entries`` smallest ids (equal ids by their components, null ids last), is moved ``rounds`` times, and codes the
    parts. All arithmetic is in whole numbers; pivots only decide which distances need not be computed. The
    distances of parts from pivots are written once, with the whole numbers, and reread in every round, so a lost
    executor costs one scan of its files.

    Fewer vectors than entries make smaller codebooks. Repeated rows are vectors of their own. A vector of another length than the
    first one, or of a length that ``parts`` does not divide, has no code: null code and error. An error beyond 64 bits is null and not in the label's sum. Null labels are one
    label. Other columns are ignored; an empty table gives no rows.
    """
    good = vectors.where(F.col("embedding").isNotNull()).where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    good = good.select("vec_id", "label", whole_numbers(F.col("embedding")).alias("x"))
    start = good.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    width = len(start[0].x) if start else 0
    usable = width > 0 and width % parts == 0
    start = [r.x for r in start if len(r.x) == width] if usable else []
    whole = [np.array([x[p * width // parts:(p + 1) * width // parts] for x in start], object) for p in range(parts)] if usable else []
    first = [b if any(abs(v) > NARROW for v in b.flat) else b.astype(np.int64) for b in whole]
    fixed = [pivots_of(b, pivots) for b in first]
    deep = max((len(f) for f in fixed), default=0)
    label, kind = vectors.schema["label"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = _like(_block(batch, width), fixed)
            far = np.zeros((len(x), parts, deep))
            for p, part in enumerate(np.split(x, parts, axis=1)):
                for j, pivot in enumerate(own[p]):
                    far[:, p, j] = roots(squares(part, pivot[None]))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * parts * deep, pa.int32()), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "x")), flat], ["vec_id", "label", "x", "far"])

    fit = F.size("x") == (width if usable else -2)
    rows = stash(good.where(fit).mapInArrow(measure, f"vec_id {kind}, label {label}, x array<long>, far array<double>"))
    books = learn(rows, first, fixed, rounds) if usable else []
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.flat).encode()).hexdigest()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, own = _like(_block(batch, width), books)
            far = batch.column("far").flatten().to_numpy(zero_copy_only=False).reshape(len(x), parts, -1)
            error, codes = np.zeros(len(x), object), []
            for p, part in enumerate(np.split(x, parts, axis=1)):
                index, d, _ = nearest(part, far[:, p, :len(fixed[p])], own[p], fixed[p])
                codes.append(index)
                error += d.astype(object)
            code = ["".join(f"{e:02x}" for e in c) for c in np.array(codes).T]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label")), pa.array(code, pa.string()),
                                              pa.array([e if e < 1 << 63 else None for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    coded = rows.mapInArrow(assign, f"vec_id {kind}, label {label}, code string, error long")
    other = good.where(~fit).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = stash(coded.unionByName(other))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn("_part", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    out = dealt.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_part") == F.col("_salt")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
