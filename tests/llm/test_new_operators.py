"""Pieces, vector codes and the divergence audit against plain versions, and their edge cases."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tauscope.llm import divergence, lm_scoring, pieces, queries, vector_codes

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_file())


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pieces_are_those_of_the_library(library):
    codec, rng = pieces.codec(queries.piece_file()), random.Random(4)
    odd = [*"a▁z01-=é中文", " ", "  ", "    ", "\n", "\t", "\0", "😀", "the", "ing", "\U0010ffff", "ﬁ", "́", "<s>", "<0x41>", "İ", "﻿", " ", "Ａ"]
    texts = ["", " ", "z" * 9000, " " * 5000, "ab" * 9000, "=-" * 5000, "word " * 5000, "x" * 40 + "�"]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz" if rng.random() < 0.9 else " -.,ABC") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == library.encode(text) and codec.decode(ids) == library.decode(ids)
    for _ in range(2000):  # any ids, also such that stand for no valid bytes
        ids = [rng.randint(0, 31_999) if rng.random() < 0.5 else rng.randint(3, 258) for _ in range(rng.randint(0, 20))]
        assert codec.decode(ids) == library.decode(ids)


def test_pieces_step_back(library):
    """With little memory of stretches the encoder still agrees, and some stretches need a step back."""
    codec = pieces.Codec(queries.piece_file(), remember=50)
    rng = random.Random(9)
    for _ in range(2000):
        text = "".join(rng.choice("aeinrst") for _ in range(30))
        assert codec.encode(text) == library.encode(text)
    assert len(codec.known) <= 50 and len(codec.bears) <= 50


def test_round_trip(spark, docs, library):
    long = "word\n" * 40_000 + "ü" * 30_000
    rows = [(9001, None, "x"), (9002, "", None), (9003, long, "x"), (9003, long, "x"), (None, " a  b ", "x")]
    more = spark.createDataFrame(rows, "doc_id long, text string, source string")
    table = docs.select("doc_id", "text").unionByName(more.select("doc_id", "text")).withColumns({"ids": F.lit("x"), "n_tokens": F.lit(1)})
    got = collections.Counter(map(tuple, pieces.round_trip(table, queries.piece_file()).collect()))
    want = collections.Counter()
    for d, text in table.select("doc_id", "text").collect():
        ids = library.encode(text or "")
        want[d, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))] += 1
    assert got == want
    assert pieces.round_trip(docs.limit(0), queries.piece_file()).count() == 0
    encoded = pieces.encode(table, queries.piece_file())
    assert encoded.columns == ["doc_id", "text", "n_tokens", "ids"]
    assert all(r.ids == library.encode(r.text or "") for r in encoded.collect())


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, lab, [math.floor(4096 * v) for v in x]) for i, lab, x in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = lambda x, p: x[p * width:(p + 1) * width]
    books = [[cut(x, p) for _, _, x in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))

    def nearest(x, p):
        return min((far(cut(x, p), c), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, _, x in kept:
            for p in range(parts):
                members[p, nearest(x, p)[1]].append(cut(x, p))
        for (p, e), m in members.items():
            books[p][e] = [sum(c) // len(m) for c in zip(*m, strict=True)]
    out, sums = [], collections.Counter()
    for i, lab, x in kept:
        best = [nearest(x, p) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
        sums[lab] += out[-1][3]
    sha = digest(",".join(str(v) for b in books for c in b for v in c))
    return sorted(((i, code, error, sums[lab], sha) for i, lab, code, error in out), key=str)


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e9])
def test_vector_codes(spark, scale):
    rng = np.random.default_rng(8)
    rows = [(i, None if i % 7 == 0 else i % 3, [float(v) for v in np.round(rng.normal(0, 0.2, 16), 2 if i % 2 else 4) * scale]) for i in range(120)]
    rows += [(500, 1, None), (501, 1, [None] * 16), (502, 1, [float("nan")] * 16), (503, 1, [float("inf")] * 16), rows[40], rows[40], (None, 2, rows[3][2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit(1) for c in ("x", "far", "code", "_salt", "error")})
    want = plain_codes(rows)
    if scale == 1e9:  # errors beyond 64 bits
        want = [(i, code, None, None, sha) for i, code, error, total, sha in want if error >= 1 << 63]
        assert len(want) == 123
    assert sorted(map(tuple, vector_codes.compress(df.repartition(5)).collect()), key=str) == want


def test_vector_codes_edges(spark):
    schema = "vec_id long, label int, embedding array<float>"
    few = [(1, 0, [0.5] * 8), (2, 0, [-0.5] * 8), (3, None, [0.25] * 7)]
    got = {r.vec_id: r for r in vector_codes.compress(spark.createDataFrame(few, schema)).collect()}
    assert got[1].code == "00" * 8 and got[2].code == "01" * 8 and (got[3].code, got[3].error, got[3].label_error) == (None, None, None) and got[1].error == 0
    assert vector_codes.compress(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, 1, [])], schema)).first().code is None


def test_pivots_leave_out_distances_but_no_entry():
    rng = np.random.default_rng(2)
    book, centres = rng.integers(-2000, 2000, (16, 8)), rng.integers(-2000, 2000, (16, 8))
    x = np.concatenate([centres[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 8)), book[rng.integers(0, 16, 50)]])
    book[9] = book[4]  # a tie of entries
    pivots = vector_codes.pivots_of(book, 4)
    far = np.stack([vector_codes.roots(vector_codes.squares(x, p[None])) for p in pivots], axis=1)
    index, d, evaluated = vector_codes.nearest(x, far, book, pivots)
    every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all() and evaluated < 0.6 * every.size


def plain_audit(rows, least=10, top=10):
    words = collections.defaultdict(collections.Counter)
    has = collections.Counter()
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        words[lang or "", source or ""].update(found)
        has.update((lang or "", t) for t in set(found))
    out = []
    for lang in {g[0] for g in words}:
        kept = sorted(t for (x, t), n in has.items() if x == lang and n >= least)
        groups = {s: c for (x, s), c in words.items() if x == lang}
        whole = sum(groups.values(), collections.Counter())

        def prices(c, kept=kept):
            total = sum(c[t] for t in kept)
            return [1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept]

        q, p = prices(whole), {s: prices(c) for s, c in groups.items()}
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted(((-sum(map(gap, p[s], p[o])), o.encode(), o) for o in groups if o != s))
            terms = sorted((-gap(a, b), t.encode(), t) for t, a, b in zip(kept, p[s], q, strict=True) if groups[s][t] and a > b)[:top]
            out += [(lang, s, part, item, -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 3])
def test_divergence(spark, docs, block):
    extra = [(t, lang, s) for t, lang, s in [(None, None, None), ("Straße straße ÄÄ A_b", None, ""), ("", "xx", "p"), ("rare", "xx", "q")]] + [(f"tie one{i % 2} É", "yy", f"s{i % 3}") for i in range(30)]
    schema = "text string, lang string, source string"
    table = docs.select("text", "lang", "source").unionByName(spark.createDataFrame(extra, schema))
    got = divergence.audit(table.withColumns({c: F.lit(1) for c in ("n", "df", "term", "block", "total", "kept", "rank")}), block=block)
    assert sorted(map(tuple, got.collect())) == plain_audit([tuple(r) for r in table.collect()])


def test_divergence_edges(spark, docs):
    assert divergence.audit(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(None, None, None)], "text string, lang string, source string")
    assert divergence.audit(one).count() == 0
    big = np.array([0, 10**12, 7 * 10**14])
    assert divergence.prices(big, 8 * 10**14, 10**9).tolist() == [1 + 10**9 * (int(c) + 2) // (8 * 10**14 + 2 * 10**9) for c in big]
    row = spark.range(1).select(divergence.price(F.lit(7 * 10**14), F.lit(8 * 10**14), F.lit(10**9)).alias("p")).first()
    assert row.p == 1 + 10**9 * (7 * 10**14 + 2) // (8 * 10**14 + 2 * 10**9)


@pytest.mark.parametrize("hot", [50, 5000])
def test_the_most_frequent_grams_reach_the_driver_packed(spark, hot):
    rows = [((i * 7919) % 100003, i * i % 41, [float(i), -i / 3, 0.5]) for i in range(3000)]
    model = spark.createDataFrame(rows, "gram long, n long, diff array<double>").repartition(5)
    grams, table = lm_scoring.most_frequent(model, hot)
    want = sorted(sorted(rows, key=lambda r: (-r[1], r[0]))[:hot])
    assert grams.tolist() == [r[0] for r in want] and table.T.tolist() == [r[2] for r in want]
    none, empty = lm_scoring.most_frequent(model.limit(0), hot)
    assert len(none) == 0 and empty.shape == (lm_scoring.FOLDS + 1, 0)
