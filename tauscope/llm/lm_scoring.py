"""Cross-entropy difference: byte n-gram models of trusted texts and of the corpus score every document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tauscope.llm.common import digest, stash

#: Tokens that a model looks at, the predicted byte included. The vocabulary of both models is the 256 byte values.
ORDER = 5
#: Folds of the trusted texts: a trusted text is scored by a target model of the other fold.
FOLDS = 2
#: The most frequent n-grams that every worker holds (16 bytes each and 8 for every fold): a fixed amount. All others are joined.
HOT = 1 << 18


def codes(text: str | None) -> np.ndarray:
    """One number for every byte of the text: the byte with the ORDER - 1 before it; zeros stand before the first."""
    data = np.frombuffer(b"\0" * (ORDER - 1) + (text or "").encode(), np.uint8).astype(np.int64)
    n = len(data) - ORDER + 1
    out = np.zeros(n, np.int64)
    for i in range(ORDER):
        out = out << 8 | data[i:i + n]
    return out


def _marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, fold``: fold 0 for texts that are not trusted, else 1 to FOLDS by a hash of the id."""
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select("doc_id", "text").join(trusted.hint("shuffle_hash"), F.col("doc_id") == F.col("_id"), "left")
    fold = F.when(F.col("_id").isNotNull(), digest("doc_id") % FOLDS + 1).otherwise(0).cast("int")
    return rows.select("doc_id", "text", fold.alias("fold"))


def gram_counts(marked: DataFrame) -> DataFrame:
    """``gram, background, t1, t2``: how often every n-gram stands in all texts, and in the trusted texts of each fold."""
    names = ["gram", "background", *[f"t{f}" for f in range(1, FOLDS + 1)]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                folds = batch.column("fold").to_pylist()
                every = [codes(t) for t in batch.column("text").to_pylist()]
                grams, background = np.unique(np.concatenate(every), return_counts=True)
                sums = []
                for f in range(1, FOLDS + 1):
                    target = np.zeros(len(grams), np.int64)
                    if own := [c for c, g in zip(every, folds, strict=True) if g == f]:
                        some, n = np.unique(np.concatenate(own), return_counts=True)
                        target[np.searchsorted(grams, some)] = n
                    sums.append(pa.array(target))
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(background), *sums], names)

    rows = marked.select("text", "fold").mapInArrow(count, ", ".join(f"{n} long" for n in names))
    return rows.groupBy("gram").agg(*[F.sum(n).alias(n) for n in names[1:]])


def differences(counts: DataFrame, strength: float = 5.0) -> DataFrame:
    """``gram, n, diff``: loss of the last byte after the others under the target models less that under the background model.

    ``diff`` is an array: with the whole target, then with the target without fold 1, without fold 2. All models are the same:
    P(c | context) = (n(context c) + s P(c | shorter context)) / (n(context) + s), down to the uniform distribution. A background count is
    taken times target size / corpus size, so that evidence of both sides meets the smoothing at one size: a model
    is not sharper because its texts are more. Counts of shorter contexts are sums of the counted table.
    """
    folds = [f"t{f}" for f in range(1, FOLDS + 1)]
    total = F.sum(sum((F.col(f) for f in folds), F.lit(0)))
    ratios = stash(counts.agg(F.array(*[
        F.when(F.sum("background") > 0, kept / F.sum("background")).otherwise(0.0) for kept in (total, *[total - F.sum(f) for f in folds])]).alias("_ratio")))
    cases = range(FOLDS + 1)

    def target(case: int) -> Column:
        return sum((F.col(f) for i, f in enumerate(folds, 1) if i != case), F.lit(0)).cast("double")

    start = counts.select("gram", "background", F.array(*[target(c) for c in cases]).alias("t"))

    def add(array: str) -> Column:
        return F.array(*[F.sum(F.col(array)[c]) for c in cases])

    def level(table: DataFrame, n: int, lower: DataFrame) -> DataFrame:
        """``gram, background, t, pt, pb`` for the n last bytes, from the same of one byte less."""
        shorter = 1 << (8 * (n - 1))
        lower = lower.select(F.col("gram").alias("_low"), F.col("pt").alias("_pt"), F.col("pb").alias("_pb"))
        context = table.groupBy(F.shiftright("gram", 8).alias("_ctx")).agg(F.sum("background").alias("_b"), add("t").alias("_t"))
        out = table.withColumn("_low", F.col("gram") % shorter).withColumn("_ctx", F.shiftright("gram", 8)).join(context, "_ctx").join(lower, "_low").crossJoin(ratios)  # a single row
        pt = F.array(*[(F.col("t")[c] + strength * F.col("_pt")[c]) / (F.col("_t")[c] + strength) for c in cases])
        pb = F.array(*[(F.col("background") * F.col("_ratio")[c] + strength * F.col("_pb")[c]) / (F.col("_b") * F.col("_ratio")[c] + strength) for c in cases])
        return out.select("gram", "background", "t", pt.alias("pt"), pb.alias("pb"))

    # every level is written: it is read as itself, as contexts and by the level below, and one plan of all would repeat it each time
    tables = {ORDER: start}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = stash(tables[n + 1].groupBy((F.col("gram") % (1 << (8 * n))).alias("gram")).agg(F.sum("background").alias("background"), add("t").alias("t")))
    flat = F.array(*[F.lit(1 / 256) for _ in cases])
    lower = counts.sparkSession.range(1).select(F.lit(0).cast("long").alias("gram"), flat.alias("pt"), flat.alias("pb"))
    for n in range(1, ORDER):
        lower = stash(level(tables[n], n, lower))
    whole = level(start, ORDER, lower)
    return whole.select("gram", F.col("background").alias("n"), F.array(*[F.log(F.col("pb")[c]) - F.log(F.col("pt")[c]) for c in cases]).alias("diff"))


def most_frequent(model: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``hot`` most frequent n-grams in order, and their differences by case. Workers pack them: the driver sees bytes, not rows."""
    columns = [F.get("diff", F.lit(c)).alias(f"d{c}") for c in range(FOLDS + 1)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.asarray(batch.column(i).to_numpy(zero_copy_only=False), t).tobytes() for i, t in enumerate([np.int64] + [np.float64] * (FOLDS + 1))]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["gram", *[f"d{c}" for c in range(FOLDS + 1)]])

    schema = ", ".join(["gram binary", *[f"d{c} binary" for c in range(FOLDS + 1)]])
    rows = model.orderBy(F.col("n").desc(), "gram").limit(hot).select("gram", *columns).mapInArrow(pack, schema).collect()  # some ten thousand n-grams each
    grams = np.frombuffer(b"".join(bytes(r["gram"]) for r in rows), np.int64)
    table = np.stack([np.frombuffer(b"".join(bytes(r[f"d{c}"]) for r in rows), np.float64) for c in range(FOLDS + 1)])
    order = np.argsort(grams)
    return grams[order], table[:, order]


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id, n_tokens, ce_diff`` of every document: mean loss per byte under the target model less that under the corpus model.

    Lower means more like the trusted texts. Both models count whole texts of all documents they stand for, and grow with
    them; a trusted text is scored by a target model of the trusted texts of the other fold, so that it has not counted itself. The
    ``hot`` most frequent n-grams, a fixed number, lie with the workers and are added up in the pass over the texts; the others
    of a document are counted in the document, joined with the model in Spark and added to it by a row number. Where the
    line between them lies changes no result.

    A null or empty text has no tokens and the value 0; without labels all target models are uniform. Repeated rows are scored alike,
    once each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    marked = _marked(docs, labels)
    model = stash(differences(stash(gram_counts(marked))))
    shared = spark.sparkContext.broadcast(most_frequent(model, hot))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, diffs = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                sizes, sums, rest, times = [], [], [], []
                for text, fold in zip(batch.column("text"), batch.column("fold").to_pylist(), strict=True):
                    c = codes(text.as_py())
                    at = np.minimum(np.searchsorted(grams, c), max(len(grams) - 1, 0))
                    known = grams[at] == c if len(grams) else np.zeros(len(c), bool)
                    sizes.append(len(c))
                    sums.append(float(diffs[fold][at[known]].sum()) if len(grams) else 0.0)
                    others, n = np.unique(c[~known], return_counts=True)
                    rest.append(others)
                    times.append(n)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in rest])])
                listed = lambda parts, ends=ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), pa.array(sizes, pa.int64()), pa.array(sums), listed(rest), listed(times)],
                                                 ["doc_id", "fold", "n_tokens", "known", "rest", "times"])

    schema = f"doc_id {kind}, fold int, n_tokens long, known double, rest array<long>, times array<long>"
    rows = stash(marked.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()))
    cold = rows.select("_row", "fold", F.arrays_zip("rest", "times").alias("_z")).select("_row", "fold", F.inline("_z"))
    cold = cold.join(model.select(F.col("gram").alias("rest"), "diff"), "rest")
    added = cold.groupBy("_row").agg(F.sum(F.get("diff", F.col("fold")) * F.col("times")).alias("_more"))
    whole = F.col("known") + F.coalesce("_more", F.lit(0.0))
    out = rows.drop("rest", "times").join(added, "_row", "left")
    return out.select("doc_id", "n_tokens", F.when(F.col("n_tokens") > 0, whole / F.col("n_tokens")).otherwise(0.0).alias("ce_diff"))
