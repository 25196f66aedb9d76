"""Source divergence audit: how far the term use of two sources of a language lies apart, pair by pair."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tauscope.llm.common import stash

#: Prices are thousandths of millionths; a price is built three digits at a time.
SCALE = 1_000_000_000
#: A-Z become a-z, other ASCII characters that are no letters become spaces, all else stays.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame, flush: int = 400_000) -> DataFrame:
    """``lang, source, term, n, df``: occurrences of a term in a group's texts, and how many of the texts have it.

    A task adds up its texts and passes the sums on when it holds ``flush`` of them (twice as many at the utmost), so a hot group meets the
    shuffle as sums of its tasks.
    """
    one, most = 1 << 40, 1 << 22  # texts are counted in the upper bits, occurrences in the lower ones; neither overflows in so many texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in held.items():
                both = np.fromiter(own.values(), np.int64, len(own))
                same = [pa.repeat(pa.scalar(v, pa.string()), len(own)) for v in (lang, source)]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(both & (one - 1)), pa.array(both >> 40)], ["lang", "source", "term", "n", "df"])

        held: dict[tuple[str, str], dict[bytes, int]] = {}
        new = texts = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
                own = held.setdefault((lang.as_py(), source.as_py()), {})
                for term, n in Counter(text.as_py().encode().translate(LETTERS).split()).items():
                    own[term] = own.get(term, 0) + n + one
                    new += 1
                texts += 1
                full = new >= flush and sum(map(len, held.values())) >= flush
                new = 0 if new >= flush else new
                if full or texts == most:
                    yield from out()
                    held, texts = {}, 0
        yield from out()

    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return named.mapInArrow(run, "lang string, source string, term string, n long, df long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def price(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)) in whole numbers; exact while the denominator is below 9 * 10^15."""
    rest, found, base = count + 2, F.lit(0).cast("long"), total + 2 * kept
    for _ in range(3):
        found, rest = found * 1000 + F.call_function("div", rest * 1000, base), (rest * 1000) % base
    return found + 1


def prices(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """:func:`price` of an array."""
    rest, base = count.astype(np.int64) + 2, total + 2 * kept
    found = np.zeros_like(rest)
    for _ in range(3):
        found, rest = found * 1000 + rest * 1000 // base, rest * 1000 % base
    return found + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); squares stay below 2^63."""
    return (p - q) ** 2 // (p + q)


def merge_pair(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], terms: int, kept: int) -> int:
    """Sum of :func:`gaps` over ``terms`` terms of which the sorted ids in ``a`` and ``b`` (ids, counts, total) are the ones that occur.

    The ids of the shorter list gallop through the longer one (``searchsorted`` starts from where the id before ended).
    Terms of both sides are priced with both counts, those of one side against the other's price of an absent term, and all that
    no side has cost the same.
    """
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (few, few_n, few_total), (many, many_n, many_total) = a, b
    p, q = prices(few_n, few_total, kept), prices(many_n, many_total, kept)
    zero = np.zeros(1, np.int64)
    p0, q0 = prices(zero, few_total, kept), prices(zero, many_total, kept)
    at = np.searchsorted(many, few)
    both = np.zeros(len(few), bool)
    inside = at < len(many)
    both[inside] = many[at[inside]] == few[inside]
    alone = np.ones(len(many), bool)
    alone[at[both]] = False
    absent = terms - len(few) - int(alone.sum())
    return int(gaps(p[both], q[at[both]]).sum() + gaps(p[~both], q0).sum() + gaps(p0, q[alone]).sum()) + absent * int(gaps(p0, q0)[0])


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10, block: int = 1024) -> DataFrame:
    """``lang, source, part, item, value, rank``: the other sources of a language by distance, and the terms that set a source apart.

    A language keeps the terms that stand in at least ``min_docs`` of its documents. A group is a source in a language. Part
    ``pair`` has every other source of the language with the sum of :func:`gaps` between the two groups' prices
    over all kept terms; part ``term`` the ``top`` terms that the group uses more than its language, by the gap to the
    language's price. Both rank by value, then by item in byte order.

    The kept terms of a language are dealt by a hash into blocks of about ``block`` terms. A group's counts in a block are one
    sorted array, so a pair of groups in a block is one row, however large groups are, and the sums of
    a pair's blocks are added up. Texts are read once; terms are summed in the tasks before the shuffle.

    Null text, lang and source are empty ones. A group without terms has all prices at those of absent terms. Where no term is
    kept, values are 0. Repeated rows count as documents. A source alone in its language has no pairs. Other columns
    are ignored; an empty table gives no rows.
    """
    counts = stash(term_counts(docs))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")).where(F.col("df") >= min_docs).drop("df")
    held = stash(counts.drop("df").join(terms, ["lang", "term"]))
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = stash(groups.join(totals, ["lang", "source"], "left").join(langs, ["lang"], "left").select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "kept", "lang_total")]))

    # ids of terms count within a block of a language
    langs = groups.groupBy("lang").agg(F.first("kept").alias("kept"))
    langs = langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / block)).cast("int"))
    ids = terms.join(langs, ["lang"]).select("lang", "term", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))
    ids = ids.withColumn("id", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")))
    sizes = ids.groupBy("lang", "block").agg(F.count("*").alias("terms"))
    every = langs.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(sizes, ["lang", "block"], "left")
    lists = held.join(ids, ["lang", "term"]).groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("list"))
    lists = groups.join(every, ["lang"]).join(lists, ["lang", "source", "block"], "left").select(
        "lang", "source", "block", "total", "kept", F.coalesce("terms", zero).alias("terms"),
        F.coalesce(F.col("list.id"), F.array().cast("array<int>")).alias("ids"), F.coalesce(F.col("list.n"), F.array().cast("array<long>")).alias("counts"))
    lists = stash(lists)
    right = lists.select("lang", "block", *[F.col(c).alias(f"{c}_b") for c in ("source", "total", "ids", "counts")])
    pairs = lists.join(right, ["lang", "block"]).where(F.col("source") < F.col("source_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i] for c in ("total", "total_b", "kept", "terms", "ids", "ids_b", "counts", "counts_b")}
                a, b = ((r["ids" + s].values.to_numpy(), r["counts" + s].values.to_numpy(), r["total" + s].as_py()) for s in ("", "_b"))
                values.append(merge_pair(a, b, r["terms"].as_py(), r["kept"].as_py()) if r["kept"].as_py() else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "source", "source_b")), pa.array(values, pa.int64())], ["lang", "source", "item", "value"])

    summed = pairs.mapInArrow(run, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sides = F.array(F.struct(F.col("source"), F.col("item")), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    summed = summed.select("lang", F.explode(sides).alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    p, q = price(F.col("n"), F.col("total"), F.col("kept")), price(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    used = held.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    gap = F.expr("((p - q) * (p - q)) div (p + q)")
    used = used.select("lang", "source", F.lit("term").alias("part"), "item", gap.alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = used.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return summed.withColumn("rank", F.row_number().over(order)).unionByName(ranked)
