"""Quality rules: counts of a text, and a hashed n-gram likelihood ratio of trusted texts against the raw corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tauscope.llm.common import WORD, let, split_words, stash

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more; only texts with a repeat are sorted."""
    def marked(h: Column) -> Column:
        s = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(s, lambda s: let(
            F.sort_array(F.filter(
                F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())),
            lambda p: F.aggregate(F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(3), F.get(p, j + 1) - x), F.lit(3))), F.lit(0), lambda a, b: a + b)))

    windows = let(words, lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(marked(h)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(some).cast("long")


def grams(rows: DataFrame, buckets: int) -> DataFrame:
    """One row per word of the array ``words``, in place of it: the ``word`` and buckets ``one, two`` of it and of it with the next (the last with none)."""
    keep = [c for c in rows.columns if c != "words"]
    rows = rows.select(*keep, F.inline_outer(F.arrays_zip(F.col("words").alias("x"), F.slice("words", F.lit(2), F.size("words")).alias("y"))).alias("word", "_y"))
    one, two = F.xxhash64("word"), F.xxhash64("word", F.coalesce("_y", F.lit("")))
    return rows.select(*keep, "word", *[F.when(F.col("word").isNotNull(), F.pmod(h, F.lit(buckets))).cast("int").alias(n) for h, n in ((one, "one"), (two, "two"))])


def gram_counts(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """``bucket, t, c, st, sc`` for every bucket, its n-grams in trusted and in all texts and the sums of both; and ``_trusted``, the hashes of trusted texts.

    A text counts once, however many rows hold it, and is trusted if ``labels.quality`` marks one of these rows 1. Which
    row stands for a text is settled on ids and hashes, so texts are shuffled once; a row that is there n times
    counts 1/n each time. Counts are combined in every task before they are shuffled, so that shuffle and the
    table are bounded by ``buckets``. Join sides without texts are hashed, which needs no sort of texts.
    """
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    seen = rows.groupBy("doc_id", "_hash").agg(F.count("*").alias("n"))
    seen = seen.join(trusted.hint("shuffle_hash"), F.col("doc_id") == F.col("_id"), "left")
    texts = seen.groupBy("_hash").agg(F.min(F.struct("doc_id", "n")).alias("_first"), F.max(F.col("_id").isNotNull().cast("long")).alias("t"))
    texts = stash(texts.select(F.col("_hash").alias("_text"), F.col("_first")["doc_id"].alias("_doc"), (1 / F.col("_first")["n"]).alias("w"), "t"))
    rows = rows.join(texts.hint("shuffle_hash"), F.col("_hash").eqNullSafe(F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    rows = grams(rows.select(split_words(F.col("text")).alias("words"), "t", "w"), buckets)
    rows = rows.select(F.explode(F.array("one", "two")).alias("bucket"), "t", "w").where("bucket is not null")
    counts = rows.groupBy("bucket").agg(F.round(F.sum(F.col("t") * F.col("w"))).cast("long").alias("t"), F.round(F.sum("w")).cast("long").alias("c"))
    sums = counts.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("st"), F.coalesce(F.sum("c"), F.lit(0)).alias("sc"))
    whole = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0).crossJoin(sums)
    return stash(whole), texts.where("t = 1").select(F.col("_text").alias("_trusted"))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 16, prior: float = 1.0) -> DataFrame:
    """``bucket, ratio, own`` for every bucket: log P(bucket | trusted) - log P(bucket | corpus), smoothed multinomials of :func:`gram_counts`.

    Both are for one n-gram by itself, left out of the corpus it is scored with; ``own`` leaves it out of the trusted texts too.
    """
    less = lambda n: F.greatest(F.col(n) - 1, F.lit(0))
    corpus = F.log((less("c") + prior) / (F.col("sc") + prior * buckets))
    target = lambda n: F.log((n + prior) / (F.col("st") + prior * buckets))
    return gram_counts(docs, labels, buckets)[0].select("bucket", (target(F.col("t")) - corpus).alias("ratio"), (target(less("t")) - corpus).alias("own"))


def runs(values: Column) -> Column:
    """Distinct values of a sorted array and how often each is there: ``array<struct<bucket, n>>``."""
    starts = F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: (i == 0) | (F.get(values, i) != F.get(values, i - 1)))
    counted = let(starts, lambda s: F.transform(s, lambda x, i: F.struct(F.get(values, x).alias("bucket"), (F.coalesce(F.get(s, i + 1), F.size(values)) - x).alias("n"))))
    return F.when(F.size(values) > 0, counted)


def lower_limit(scored: DataFrame, lost: float) -> DataFrame:
    """One row, ``least``: the score, to a thousandth, below which at most the share ``lost`` of the trusted texts lie; no limit where none passes the base rules."""
    texts = scored.where("trusted and not base_failed").groupBy("text_hash").agg(F.min("llr").alias("llr"))
    counted = texts.groupBy(F.floor(F.col("llr") * 1000).alias("v")).agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    ranked = counted.select("v", F.coalesce(below, F.lit(0)).alias("below")).crossJoin(counted.agg(F.sum("n").alias("all")))
    return ranked.where(F.col("below") <= lost * F.col("all")).agg(F.coalesce(F.max("v") / 1000, F.lit(float("-inf"))).alias("least"))


def quality(docs: DataFrame, labels: DataFrame, lost: float = 0.01, buckets: int = 1 << 16, prior: float = 1.0) -> DataFrame:
    """Counts and verdict of every document.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, llr, text_hash``, one row per row of ``docs``. A text is kept if the base rules pass (50
    words or more, at most half of them in repeated three-word windows) and its log-likelihood ratio
    per n-gram is not below what all but the share ``lost`` of the trusted texts reach. The whole text
    is left out of the counts it is scored with, of the corpus and, where trusted, of the trusted texts, so
    trusted and other texts are scored alike and the limit holds at every size. Copies count as
    one text and get one verdict; no draw. The counts are broadcast: ``buckets`` rows, whatever the corpus.

    A null or empty text has no words and fails. Without labels the trusted model is flat, the
    ratios measure nothing and only base rules decide, as they do where no trusted text passes them. An empty table gives no rows.
    """
    counts, trusted = gram_counts(docs, labels, buckets)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("_lines", F.split("text", "\n")).withColumn("words", split_words(F.col("text")))
    filled = F.filter("_lines", lambda x: x.rlike(WORD))
    lines = F.when(F.size(F.array_distinct("_lines")) == F.size("_lines"), 0).otherwise(let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))))
    symbols = F.when(F.col("text").rlike(f"[{SYMBOLS}]"), F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).otherwise(0)
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    one = F.transform("words", lambda x: bucket(F.xxhash64(x)))
    two = F.transform("words", lambda x, i: bucket(F.xxhash64(x, F.coalesce(F.get("words", i + 1), F.lit("")))))
    rows = rows.select("_row", "doc_id", "text_hash", symbols.cast("long").alias("n_symbols"), lines.cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"),
                       F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.sort_array(F.concat(one, two)).alias("_grams"))
    own = [c for c in rows.columns if c != "_grams"]
    met = rows.select(*own, F.inline_outer(runs(F.col("_grams")))).join(F.broadcast(counts.select("bucket", "t", "c")), "bucket", "left")
    corpus = F.log(F.col("c") - F.col("n") + prior)
    part = lambda t: F.coalesce(F.sum(F.col("n") * (F.log(t + prior) - corpus)), F.lit(0.0))
    scored = met.groupBy(*own).agg(part(F.col("t")).alias("_other"), part(F.greatest(F.col("t") - F.col("n"), F.lit(0))).alias("_own"))
    scored = scored.join(trusted.hint("shuffle_hash"), F.col("text_hash") == F.col("_trusted"), "left").withColumn("trusted", F.col("_trusted").isNotNull())
    scored = scored.crossJoin(F.broadcast(counts.select("st", "sc").limit(1)))
    size, flat = 2 * F.col("n_words"), F.lit(prior * buckets)
    rest = F.log(F.col("sc") - size + flat) - F.log(F.col("st") - F.when(F.col("trusted"), size).otherwise(0) + flat)
    llr = F.when((size > 0) & (F.col("st") > 0), F.when(F.col("trusted"), F.col("_own")).otherwise(F.col("_other")) / size + rest).otherwise(0.0)
    scored = scored.withColumn("llr", llr).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    scored = stash(scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "text_hash", "trusted"))
    out = scored.crossJoin(F.broadcast(lower_limit(scored, lost))).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.col("least")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr", "text_hash")


def good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    kept = quality(docs, labels, **options).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(docs["text"]) == kept["_hash"]), "left_semi")
