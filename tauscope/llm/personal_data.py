"""Personal data: patterns propose spans, boosted trees on format and context score them, a calibrated threshold selects."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tauscope.llm.common import let, stash

#: Kinds of personal data, in the order in which spans with the same start are listed.
KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive repeats, the look-behinds and \G change no match; they keep matching linear on long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: High-recall generators: anything that looks like an address at a host, and seven digits or more with what may stand between them.
NEAR_EMAIL = r"(?<![^\s<>(),;:])[^\s@<>(),;:]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[^\s@<>(),;:]{1,64}?(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z]{2,24}"
NEAR_NUMBER = r"(?<![0-9])[+(]{0,2}+[0-9](?:[().\x20/_-]{0,3}+[0-9]){6,}+"
#: Words before a number that tell what it is.
HINTS = (("phone", "tel|phone|call|mobile|fax|cell"), ("card", "card|visa|credit|amex|mastercard"), ("ip", "ip|host|server|addr|address"), ("email", "mail|email|contact"))
FEATURES = ("kind", "digits", "plus", "paren", "dots", "luhn", "octets", "hint", "before", "after")


def matches(text: Column, pattern: str, gate: Column) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<start, end, found>>`` in code points, end exclusive; none unless ``gate``."""
    def placed(found: Column) -> Column:
        def starts(pieces: Column) -> Column:
            return F.transform(found, lambda m, j: let(
                F.aggregate(F.slice(pieces, F.lit(1), j + 1), F.lit(0), lambda a, p: a + F.length(p)) + F.aggregate(F.slice(found, F.lit(1), j), F.lit(0), lambda a, p: a + F.length(p)),
                lambda s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("found"))))
        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), starts))

    empty = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.coalesce(F.when(gate, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)), empty)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _ranked(found: Column, rank: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))


def _count(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def base_spans(text: Column) -> Column:
    """Base spans as ``array<struct<start, rank, end>>``, sorted; rank is the place in KINDS. Failing matches are dropped."""
    digit, at, plus = text.rlike("[0-9]"), F.contains(text, F.lit("@")), F.contains(text, F.lit("+"))
    found = (
        matches(text, EMAIL, at),
        F.filter(matches(text, IP, digit), lambda m: m["found"].rlike(OCTETS)),
        F.filter(matches(text, CARD, digit), lambda m: let(_digits(m["found"]), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))),
        F.filter(matches(text, PHONE, plus), lambda m: F.length(_digits(m["found"])).between(9, 15)),
    )
    return F.array_sort(F.concat(*[_ranked(f, rank) for rank, f in enumerate(found)]))


def candidates(text: Column) -> Column:
    """Proposed spans with their features: ``array<struct<start, rank, end, key>>``; they may overlap each other and base spans."""
    mail = matches(text, NEAR_EMAIL, F.contains(text, F.lit("@")) | F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]")))
    number = matches(text, NEAR_NUMBER, text.rlike("[0-9]"))

    def described(m: Column, is_mail: Column) -> Column:
        def with_digits(d: Column) -> Column:
            n = F.length(d)
            dots = F.length(m["found"]) - F.length(F.replace(m["found"], F.lit("."), F.lit("")))
            luhn, octets = n.between(12, 19) & F.call_function("luhn_check", d), m["found"].rlike(OCTETS)
            plus, paren = F.startswith(m["found"], F.lit("+")), F.contains(m["found"], F.lit("("))
            rank = F.when(is_mail, 0).when(dots == 3, 1).when(~plus & ~paren & (n >= 12), 2).otherwise(3)
            left = F.lower(F.substring(text, F.greatest(m["start"] - 19, F.lit(1)), F.least(m["start"], F.lit(20))))
            hint = F.coalesce(*[F.when(left.rlike(rf"\b(?:{words})\b[^a-z]*$"), i + 1) for i, (_, words) in enumerate(HINTS)], F.lit(0))
            side = lambda c: F.when(c.rlike(r"[\p{L}\p{N}]"), 1).otherwise(0)
            before = F.when(m["start"] > 0, side(F.substring(text, m["start"], F.lit(1)))).otherwise(0)
            after = side(F.substring(text, m["end"] + 1, F.lit(1)))
            values = (rank, F.least(n, F.lit(20)), plus, paren, F.least(dots, F.lit(4)), luhn, octets, hint, before, after)
            return F.struct(m["start"].alias("start"), rank.alias("rank"), m["end"].alias("end"), F.concat_ws(",", *[v.cast("int").cast("string") for v in values]).alias("key"))

        return let(_digits(m["found"]), with_digits)

    return F.concat(F.transform(mail, lambda m: described(m, F.lit(True))), F.transform(number, lambda m: described(m, F.lit(False))))


def _meets(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def accepted(docs: DataFrame, precision: float = 0.95, trees: int = 8, depth: int = 3) -> list[str]:
    """Feature vectors whose candidates are redacted, learned from ``docs``.

    A candidate that meets a base span is an example of personal data, any other of none. All
    features are small whole numbers, so all candidates of the corpus collapse into a counted table
    with one row per vector, bounded by the number of vectors there can be and not by the corpus; the boosted trees
    learn from that table with the counts as weights. The threshold is the lowest probability above
    which ``precision`` of the examples are personal data.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(text.alias("text")).where(text.rlike("[0-9@]|.at."))
    rows = rows.select(base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("c")).where(F.size("c") > 0)
    rows = rows.select(F.explode(F.transform("c", lambda c: F.struct(c["key"].alias("key"), _meets(c, F.col("base")).cast("int").alias("label")))).alias("x"))
    counted = rows.groupBy(F.col("x")["key"].alias("key"), F.col("x")["label"].cast("double").alias("label")).agg(F.count("*").cast("double").alias("weight"))
    parts = F.split("key", ",")
    counted = stash(counted.select("key", "label", "weight", *[F.get(parts, i).cast("double").alias(f) for i, f in enumerate(FEATURES)]))
    if counted.select("label").distinct().count() < 2:
        return []
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(counted)
    model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, seed=1).fit(ready)
    scored = model.transform(ready).select("key", "label", "weight", F.round(vector_to_array("probability")[1], 9).alias("p"))
    levels = scored.groupBy("p").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("hits"))
    down = Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = levels.select("p", (F.sum("hits").over(down) / F.sum("n").over(down)).alias("share"))
    least = cut.where(F.col("share") >= precision).agg(F.min("p").alias("least"))
    return sorted(r["key"] for r in scored.crossJoin(least).where("p >= least").select("key").distinct().collect())


def detect(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii_spans``: base spans, and these with the selected candidates that meet none of them.

    Both are ``array<struct<start, rank, end>>``, sorted. A null text counts as empty and has no spans. Where the corpus
    has no base spans (an empty table too) nothing can be learned and the base spans are all.
    """
    keys = F.array(*[F.lit(k) for k in accepted(docs, **options)]).cast("array<string>")
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumn("pii_base", F.when(text.rlike("[0-9@]"), base_spans(text)).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int>>")))
    more = F.filter(candidates(text), lambda c: F.array_contains(keys, c["key"]) & ~_meets(c, F.col("pii_base")))
    more = F.transform(more, lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end")))
    return out.withColumn("pii_spans", F.when(text.rlike(r"[0-9@]|[(\[]at[)\]]"), F.array_sort(F.concat("pii_base", more))).otherwise(F.col("pii_base")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every document; see :func:`detect`. The counts are of base spans."""
    out = detect(docs.select("doc_id", "text"), **options)
    counts = [_count(F.col("pii_base"), rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(listed(F.col("pii_base")), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; spans that overlap become one, named after the first. A null text stays null."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring("text", acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["rank"] + 1))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("pii_spans", start, step, lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text"))))
    out = detect(docs, **options)
    return out.withColumn("text", F.when(F.size("pii_spans") > 0, clean).otherwise(F.col("text"))).select(*docs.columns)
