"""Mixing sources to target weights: equal word blocks dealt out by highest quotients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tauscope.llm.common import WORD, digest, let, word_count

#: Multipliers that step through the blocks of a shard; the first that does not divide the number of blocks is used.
PRIMES = (7919, 104729, 1299709)
#: Rows of a shard at most, and blocks below which a line is cut into single words.
SHARD_ROWS, FEW = 1 << 16, 16
#: Parts into which the documents of a source are spread while its target is looked up.
SALTS = 64


def targets(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add ``target`` to ``source, source_size``: water-filling of ``share`` of all words by weight.

    Sources in code point order, null last, take the weights in turn. A target stops at ``most``
    times the source's size; what is left over goes to the others by weight until none is above.
    The sources are sorted by the level at which they fill up, and one running sum shows who does:
    no iteration. The table has one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    turn = (F.row_number().over(order) - 1) % n
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    level = Window.orderBy("_level", F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    named = sources.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size"))
    named = named.withColumn("_level", F.col("_cap") / F.col("_w")).withColumn("_all", share * F.sum("source_size").over(whole))
    named = named.withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    named = named.withColumn("_open", F.sum("_w").over(level.rowsBetween(0, Window.unboundedFollowing)))
    named = named.withColumn("_rate", F.col("_left") / F.col("_open")).withColumn("_full", F.col("_rate") > F.col("_level"))
    # the first source that is not filled up fixes the rate of all that follow
    rate = F.min(F.when(~F.col("_full"), F.struct("_level", "source", "_rate"))).over(whole)["_rate"]
    named = named.withColumn("_rate", rate)
    return named.select("source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.coalesce(F.col("_w") * F.col("_rate"), F.lit(0.0))).alias("target"))


def apportion(claims: DataFrame, by: list[str], key: str, claim: str, seats: Column) -> DataFrame:
    """Add ``quota`` to ``claims``: Sainte-Lague apportionment of ``seats`` among the rows of each ``by`` group.

    Seat j of a row has the quotient claim / (2j - 1); the seats with the highest quotients are
    given. Rounding claim x seats / sum gives all seats but a few: only that difference is dealt out
    (or taken back) by comparing quotients, and a row can be concerned by no more than
    ``(difference + rows) x its share + 1`` of them. So the listed seats grow with the rows, not
    with the seats. Ties go to the smaller ``key``. Rows without a claim get 0.
    """
    group = Window.partitionBy(*by)
    d = claims.withColumn("_seats", seats).withColumn("_sum", F.sum(claim).over(group)).withColumn("_rows", F.count("*").over(group))
    d = d.withColumn("_share", F.when(F.col("_sum") > 0, F.col(claim) / F.col("_sum")).otherwise(0.0))
    d = d.withColumn("_round", F.floor(F.col("_share") * F.col("_seats") + 0.5))
    d = d.withColumn("_short", F.when(F.col("_sum") > 0, F.col("_seats") - F.sum("_round").over(group)).otherwise(0))
    reach = (F.ceil((F.abs("_short") + F.col("_rows")) * F.col("_share")) + 1).cast("int")
    up = F.col("_short") > 0
    listed = d.where((F.col("_short") != 0) & (F.col(claim) > 0)).withColumn("_j", F.explode(F.sequence(F.lit(1), reach)))
    listed = listed.withColumn("_seat", F.when(up, F.col("_round") + F.col("_j")).otherwise(F.col("_round") - F.col("_j") + 1)).where("_seat >= 1")
    listed = listed.withColumn("_q", F.col(claim) / (2 * F.col("_seat") - 1))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.when(up, -F.col("_q")).otherwise(F.col("_q")), F.when(up, F.col(key)).otherwise(-F.col(key)), "_seat"))
    moved = listed.withColumn("_rank", rank).where(F.col("_rank") <= F.abs("_short"))
    moved = moved.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by], F.col(key).alias("_moved_key")).agg(F.sum(F.signum("_short")).cast("long").alias("_moved"))
    on = [d[c].eqNullSafe(moved[f"_by_{c}"]) for c in by] + [d[key] == moved["_moved_key"]]
    out = d.join(moved, on, "left").withColumn("quota", (F.col("_round") + F.coalesce("_moved", F.lit(0))).cast("long"))
    return out.select(*claims.columns, "quota")


def _layout(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, block: int, shard_words: int, seed: int) -> DataFrame:
    """Where every document lies on its source's line in a shard, and by what rule blocks of the line are taken.

    Equal rows (id, source and text) are one row with ``_copies``.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest("text").alias("_hash"))
    sized = sized.groupBy("doc_id", "source", "size", "_hash").agg(F.count("*").alias("_copies"))
    sized = sized.withColumn("_h", digest(F.lit(seed), "doc_id", "_hash")).withColumn("_words", F.col("size") * F.col("_copies"))
    by_source = targets(sized.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, share, most)
    by_source = by_source.withColumn("_s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    whole = sized.agg(F.greatest(F.lit(1), F.ceil(F.sum("_words") / shard_words), F.ceil(F.count("*") / SHARD_ROWS)).cast("long").alias("_shards"))
    # a hot source is spread over salts: its row of the small table is repeated, its documents are not
    by_source = by_source.crossJoin(whole).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # whole is a single row
    placed = sized.withColumnRenamed("source", "_source").withColumn("_part", F.pmod("_h", F.lit(SALTS)).cast("int"))
    placed = placed.join(by_source, F.col("_source").eqNullSafe(F.col("source")) & (F.col("_part") == F.col("_salt")))
    placed = placed.withColumn("_shard", F.call_function("div", F.col("_h"), F.lit(SALTS)) % F.col("_shards")).drop("_source", "_part", "_salt", "_shards")
    cells = placed.groupBy("_shard", "_s").agg(
        F.sum("_words").alias("_line"), F.round(F.first("target") * F.sum("_words") / F.greatest(F.first("source_size"), F.lit(1)), 6).alias("_claim")).where("_line > 0")
    cells = cells.withColumn("_unit", F.when(F.col("_line") < FEW * block, 1).otherwise(block).cast("long"))
    # a shard's seats go to its sources by the highest quotients of what they claim in it; rounded claims make ties the same in every run
    seats = F.round(F.round(F.sum("_claim").over(Window.partitionBy("_shard", "_unit")) / F.col("_unit"), 6)).cast("long")
    cells = cells.withColumn("_all", seats)
    cells = apportion(cells, ["_shard", "_unit"], "_s", "_claim", F.col("_all"))
    cells = cells.withColumn("_n", F.ceil(F.col("_line") / F.col("_unit")).cast("long"))
    cells = cells.select(F.col("_shard").alias("_in"), F.col("_s").alias("_of"), "_unit", "_n", F.least("quota", (most * F.col("_n")).cast("long")).alias("_quota"))
    line = Window.partitionBy("_s", "_shard").orderBy("_h", "doc_id", "_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_first", F.coalesce(F.sum("_words").over(line), F.lit(0)))
    placed = placed.join(cells, (F.col("_shard") == F.col("_in")) & (F.col("_s") == F.col("_of")), "left")
    every, more = F.floor(F.col("_quota") / F.col("_n")), F.col("_quota") % F.col("_n")
    a, b, c = PRIMES
    stride = F.when(F.col("_n") % a != 0, a).when(F.col("_n") % b != 0, b).otherwise(c).cast("long")
    return placed.select("doc_id", "size", "source", "source_size", "target", "_hash", "_copies", "_first", "_unit", "_n", every.cast("long").alias("_every"),
                         more.alias("_more"), stride.alias("_stride"), (digest(F.lit(seed), "_s", "_shard") % F.col("_n")).alias("_turn"))


def _copy(placed: DataFrame, number: Column) -> DataFrame:
    """Start, end and blocks of the copies of each row; ``number`` counts copies from 0."""
    one = placed.withColumn("_number", number).withColumn("_start", F.col("_first") + F.col("_number") * F.col("size")).withColumn("_end", F.col("_start") + F.col("size"))
    return one.withColumn("_blocks", F.when(F.col("size") > 0, F.sequence(F.floor(F.col("_start") / F.col("_unit")), F.floor((F.col("_end") - 1) / F.col("_unit")))))


def _inside(k: Column, end: bool) -> Column:
    """Where block k begins or ends inside the document's stretch."""
    return F.least(F.col("_end"), (k + 1) * F.col("_unit")) if end else F.greatest(F.col("_start"), k * F.col("_unit"))


def _times(k: Column) -> Column:
    """How often block k is taken."""
    turn = (k * F.col("_stride") + F.col("_turn")) % F.col("_n")
    return F.col("_every") + F.when(turn < F.col("_more"), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
        block: int = 64, shard_words: int = 1 << 20, seed: int = 17) -> DataFrame:
    """How many words of every document a mix of the sources takes.

    Returns ``doc_id, size, source, source_size, target, taken``, one row per document. Documents are dealt by a hash into shards of
    about ``shard_words`` words and at most some ten thousand rows, whatever their source; in a shard every source lays its documents
    end to end in a seeded order, and the line is cut into blocks of ``block`` words (the last may be shorter). What a source
    claims in a shard is its target's share of its line. The shard's seats, one per block, go to its sources by
    the highest quotients (Sainte-Lague). Lines shorter than a few blocks would lose their words to rounding: they have
    blocks of one word and seats of their own. A quota takes every block of its line as often as it can and
    then, in a seeded stride along the line, as many more as are left. So no block is taken more often than ``most``, reruns agree, and a
    source misses its target by less than a block for each of its long lines and by about a word for each of its short ones.

    Null or empty texts have size 0 and are never taken; a null source is a source of its own; repeated rows are documents of their
    own, laid side by side (they are counted before the shuffle, so a crowd of them is one row until the end); an empty table gives no rows.
    """
    placed = _copy(_layout(docs, weights, share, most, block, shard_words, seed), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))

    def words(acc: Column, k: Column) -> Column:
        return acc + (_inside(k, True) - _inside(k, False)) * _times(k)

    taken = F.coalesce(F.aggregate("_blocks", F.lit(0).cast("long"), words), F.lit(0))
    return placed.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
          block: int = 64, shard_words: int = 1 << 20, seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time that some of a document is taken.

    Its text is the blocks taken at least that often, with the white space that follows their words; a document that is
    taken whole keeps its text as it is. What :func:`mix` does not take is not in it. Equal rows are treated like the first of them.
    """
    placed = _copy(_layout(docs, weights, share, most, block, shard_words, seed).where("size > 0"), F.lit(0).cast("long"))
    placed = placed.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_every") + 1)))
    ranges = F.transform(F.filter("_blocks", lambda k: _times(k) >= F.col("_time")), lambda k: F.struct(
        (_inside(k, False) - F.col("_start")).cast("int").alias("from"), (_inside(k, True) - _inside(k, False)).cast("int").alias("n")))
    placed = placed.select(F.col("doc_id").alias("_id"), F.col("source").alias("_of"), "_hash", (F.size(ranges) == F.size("_blocks")).alias("_whole"), ranges.alias("_ranges")).where(F.size("_ranges") > 0)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), digest("text").alias("_text_hash"))
    rows = rows.join(placed, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & F.col("_row.source").eqNullSafe(F.col("_of")) & (F.col("_text_hash") == F.col("_hash")))
    text = F.col("_row.text")
    parts = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    some = let(parts, lambda w: F.array_join(F.transform("_ranges", lambda r: F.array_join(F.slice(w, r["from"] + 1, r["n"]), "")), ""))
    own = [F.when(F.col("_whole"), text).otherwise(some).alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return rows.select(*own)
