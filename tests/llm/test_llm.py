"""The training-data operators against brute force on small tables, and their edge cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tauscope.llm import byte_cnn, code_search, licences, lm_scoring, mixing, near_dups, packing, personal_data, quality_rules, queries, sharding
from tauscope.llm.components import components

SMALL = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, a repeated row, and columns named like results and helpers."""
    rows = [
        (1, "a b c d e f", "x"), (2, "a b c d e f", "x"), (2, "a b c d e f", "x"), (3, None, None), (4, "", "y"), (None, "one two", None), (5, " \t\n", "y"),
        (6, "word " * 30_000, "x"), (7, "z" * 60_000, "x"), (8, "call +1 (743) 555-3824 or a.b@c.de, 10.0.0.1; \U0001f600 4111 1111 1111 1111", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(1) for c in ("size", "target", "taken", "shard", "slot", "kept", "score", "word", "one", "v", "node", "_h", "length", "part")})


@pytest.fixture(scope="module")
def few_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")


def size_of(text):
    return len(WORDS.findall(text or ""))


def test_components_match_union_find(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(900 + i, 901 + i) for i in range(60)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def reference_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if rate * weight[s] > 2 * sizes[s]]
        if not full:
            return target | {s: rate * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mix(spark, docs):
    rows = mixing.mix(docs).collect()
    sizes = collections.Counter()
    texts = dict(docs.select("doc_id", "text").collect())
    for r in rows:
        sizes[r.source] += size_of(texts[r.doc_id])
        assert r["size"] == size_of(texts[r.doc_id]) and r.taken <= 2 * r["size"]
    want, taken = reference_targets(sizes), collections.Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and np.isclose(r.target, want[r.source])
    assert len(rows) == docs.count() and all(abs(taken[s] - want[s]) <= 256 for s in want)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    words = mixing.mixed(docs).agg(F.sum(F.regexp_count("text", F.lit(WORDS.pattern)))).first()[0]
    assert words == sum(taken.values())


def plain_taken(docs, block=64, shard_words=1 << 20, seed=17, rows=1 << 16, few=16):
    """The mix by its rule: quotients one seat after the other, blocks one after the other."""
    h = lambda *parts: int(hashlib.md5("|".join("null" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)
    docs = [(d, s, size_of(t), h(t)) for d, t, s in docs]
    sizes = collections.Counter()
    for _, s, n, _ in docs:
        sizes[s] += n
    target, order = reference_targets(sizes), sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    shards = max(1, -(-sum(sizes.values()) // shard_words), -(-len(set(docs)) // rows))
    cells = collections.defaultdict(list)
    for d, s, n, t in docs:
        cells[h(seed, d, t) // 64 % shards, order.index(s) + 1].append((h(seed, d, t), d, t, n, s))
    lines, quota, taken = {}, collections.Counter(), collections.Counter()
    for cell, own in cells.items():
        n = sum(o[3] for o in own)
        if n:
            lines[cell] = (n, round(target[own[0][4]] * n / sizes[own[0][4]], 6), 1 if n < few * block else block)
    for group in {(c[0], v[2]) for c, v in lines.items()}:
        inside = {c: v[1] for c, v in lines.items() if (c[0], v[2]) == group}
        for _ in range(int(round(sum(inside.values()) / group[1], 6) + 0.5)):
            best = max(inside, key=lambda c: (inside[c] / (2 * quota[c] + 1), -c[1]))
            quota[best] += 1
    for cell, (n, _, unit) in lines.items():
        blocks = -(-n // unit)
        q = min(quota[cell], 2 * blocks)
        stride = next(p for p in mixing.PRIMES if blocks % p)
        times = [q // blocks + ((k * stride + h(seed, cell[1], cell[0]) % blocks) % blocks < q % blocks) for k in range(blocks)]
        at = 0
        for _, d, t, size, _ in sorted(cells[cell], key=lambda o: (o[0], o[1] is not None, o[1] or 0, o[2])):
            taken[d, t] += sum(times[w // unit] for w in range(at, at + size))
            at += size
    return collections.Counter({(d, t): taken[d, t] for d, _, _, t in docs})


@pytest.mark.parametrize("shard_words", [1 << 20, 3000])
def test_mix_takes_what_the_quotients_give(spark, docs, odd, shard_words):
    few = spark.createDataFrame([(5000 + i, " ".join("w" * (5 + i % 46)), f"host{i}") for i in range(60)] + [(7000, "a b c", "x"), (7000, "a b c", "x")], "doc_id long, text string, source string")
    table = docs.select("doc_id", "text", "source").unionByName(few).unionByName(odd.select("doc_id", "text", "source"))
    got = collections.Counter()
    for r in mixing.mix(table, shard_words=shard_words).join(table.select("doc_id", "text").distinct(), "doc_id").collect():
        if 5000 <= r.doc_id:
            got[r.doc_id] += r.taken
    want = collections.Counter()
    for (d, _), n in plain_taken([tuple(r) for r in table.collect()], shard_words=shard_words).items():
        if d is not None and d >= 5000:
            want[d] += n
    assert +got == +want


def test_mix_of_many_small_sources(spark):
    rows = [(i, "word " * 15, f"s{i:03d}") for i in range(100)]
    taken = [r.taken for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    assert abs(sum(taken) - 2250) <= 3 and max(taken) <= 30
    rows = [(i * 10 + j, "w " * (5 + (i * 7 + j) % 10), f"s{i:04d}") for i in range(1000) for j in range(1 + i % 4)]
    off = collections.defaultdict(float)
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_words=4096).collect():
        off[r.source] += r.taken
        off[r.source, "target"] = r.target
    assert all(abs(off[f"s{i:04d}"] - off[f"s{i:04d}", "target"]) <= 15 for i in range(1000))


def test_mixed_rows_with_clashing_names(spark, docs, odd):
    clash = odd.withColumns({c: F.lit("x") for c in ("_id", "_hash", "_times", "_row", "_number", "_blocks", "_copies")})
    out = mixing.mixed(clash)
    assert out.columns == clash.columns
    whole = {r.doc_id: r.text for r in clash.where("doc_id is not null").collect()}
    for r in out.where("doc_id is not null").collect():
        assert r._id == "x" and set(WORDS.findall(r.text)) <= set(WORDS.findall(whole[r.doc_id]))


def test_apportion_is_highest_quotients(spark):
    claims = [(0, 0, 53.0), (0, 1, 24.0), (0, 2, 23.0), (0, 3, 0.0), (1, 0, 7.0), (1, 1, 7.0), (1, 2, 1.0)]
    df = spark.createDataFrame(claims, "g int, k long, w double")
    got = {(r.g, r.k): r.quota for r in mixing.apportion(df, ["g"], "k", "w", F.lit(8)).collect()}
    for g in (0, 1):
        won = collections.Counter()
        for _ in range(8):
            best = max(((w / (2 * won[k] + 1), -k) for h, k, w in claims if h == g))
            won[-best[1]] += 1
        assert {k: got[g, k] for h, k, _ in claims if h == g} == {k: won[k] for h, k, _ in claims if h == g}


def exact_components(texts, width=4):
    sets = {d: frozenset(near_dups.shingles(t, width).tolist()) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: (len(sets[d]), root(d)) for d in texts}


def test_near_duplicates(spark, docs):
    texts = dict(docs.select("doc_id", "text").collect())
    base = "the quick brown fox jumps over a lazy dog and runs far away " * 3
    rng = np.random.default_rng(1)
    vocabulary = np.array([f"w{i}" for i in range(500)])
    for n in range(40):  # a family of edits around the limit
        w = list(vocabulary[:160])
        for at in rng.integers(0, 160, n % 7):
            w[at] = f"new{n}_{at}"
        texts[10_000 + n] = " ".join(w)
    texts |= {20_000: base, 20_001: base.upper(), 20_002: "one two", 20_003: "one two", 20_004: "", 20_005: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.near_duplicates(df).collect()}
    assert got == exact_components(texts)
    shingle = {" ".join(base.split()[i:i + 4]) for i in range(len(base.split()) - 3)}
    assert got[20_000][0] == len(shingle)
    assert near_dups.distinct_documents(df).count() == len({c for _, c in got.values()})


def reference_counts(text):
    text = text or ""
    w = WORDS.findall(text)
    c = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    marked = {j for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_quality_rules(spark, docs, labels, odd, few_labels):
    texts = dict(docs.select("doc_id", "text").collect())
    rows = quality_rules.quality(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == reference_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (r.kept is False or not r.base_failed)
    again = quality_rules.quality(odd, few_labels).collect()
    assert len(again) == 10 and all(r.base_failed for r in again)
    assert quality_rules.good(docs, labels).columns == docs.columns


def test_quality_ratio_tells_junk_from_prose(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.quality(d, lab).join(d.select("doc_id", "text"), "doc_id").where("not base_failed").collect()
    junk = [r.llr for r in rows if re.search(r"\*\*\*| \| ", r.text)]
    prose = [r.llr for r in rows if not re.search(r"\*\*\*| \| ", r.text)]
    assert len(junk) > 50 and np.quantile(junk, 0.9) < np.quantile(prose, 0.1)


def test_log_ratios_by_hand(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, "c"), (3, None)], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    table = quality_rules.log_ratios(d, lab, 1 << 16).collect()
    counted = [r for r in table if not np.isclose(r.ratio, np.log((1 / (6 + 65536)) / (1 / (8 + 65536))))]
    assert len(table) == 65536 and len(counted) == 5  # a, b, (a b), (b a), (a end); c and (c end) stand for less than one after leaving themselves out


def test_quality_scores_by_hand(spark):
    texts = {1: "a b a", 2: "b c", 3: "a b a", 4: "c d c d e", 5: "b c", 6: "e", 7: None, 8: ""}
    d = spark.createDataFrame([*texts.items(), (5, "b c"), (None, "e")], "doc_id long, text string")
    lab = spark.createDataFrame([(3, 1), (4, 1), (2, 0)], "doc_id long, quality int")
    trusted, size = {"a b a", "c d c d e"}, 1 << 16

    def grams(t):
        w = (t or "").split()
        return collections.Counter(w) + collections.Counter(zip(w, [*w[1:], None], strict=False))

    def llr(t):
        rest = [x for x in set(texts.values()) - {None, t}]
        c, p, own = sum((grams(x) for x in rest), collections.Counter()), sum((grams(x) for x in rest if x in trusted), collections.Counter()), grams(t)
        score = sum(n * (np.log((p[g] + 1) / (sum(p.values()) + size)) - np.log((c[g] + 1) / (sum(c.values()) + size))) for g, n in own.items())
        return score / max(1, sum(own.values()))

    rows = quality_rules.quality(d, lab, buckets=size).collect()
    assert len(rows) == 10 and sorted(round(r.llr, 9) for r in rows) == sorted(round(float(llr(t)), 9) for t in [*texts.values(), "b c", "e"])


def test_quality_verdict_does_not_count_copies(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    d = d.select("doc_id", "text")
    before = {r.doc_id: r for r in quality_rules.quality(d, lab).collect()}
    clean = d.join(lab, "doc_id", "left_anti").where("length(text) > 2000 and not text rlike '[*|]'").orderBy("doc_id").first()
    copies = spark.range(500).select((F.col("id") + 10**9).alias("doc_id"), F.lit(clean.text).alias("text"))
    after = quality_rules.quality(d.unionByName(copies).unionByName(copies), lab).collect()
    assert len(after) == len(before) + 1000 and before[clean.doc_id].kept
    for r in after:
        old = before[r.doc_id if r.doc_id < 10**9 else clean.doc_id]
        assert r.kept == old.kept and abs(r.llr - old.llr) < 1e-9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_quality_limit_holds_at_every_size(spark, sf):
    d, lab = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.quality(d, lab).join(d.select("doc_id", "text"), "doc_id").where("not base_failed").collect()
    prose = [r.kept for r in rows if not re.search(r"\*\*\*| \| ", r.text)]
    assert np.mean(prose) > 0.95


def test_packing(spark, docs, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(docs.select("doc_id", "text").collect())
    rows = packing.pack(docs, queries.rank_file(), with_ids=True).collect()
    place, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        place[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for d, t in texts.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[d], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids and [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) for r in own)
    for at in place.values():
        at.sort()
        assert [o for o, _ in at] == [0, *np.cumsum([n for _, n in at])[:-1]] and sum(n for _, n in at) <= 2048
    assert sum(r.length for r in rows) >= 0.95 * 2048 * len(place)
    assert packing.pack(odd, queries.rank_file()).groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert packing.pack(docs.limit(0), queries.rank_file()).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a  b   c \n d\n\n e  ", "<|endoftext|>x <|endoftext|>", "x \n  \n y ²½ 12³ don't I'll  'll", "é\U0001f600 中文"])
def test_encoder_has_the_ids_of_the_tokenizer(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder(queries.rank_file())(text), "<u4").tolist() == want


def test_sharding(spark, docs, odd):
    for table, n in ((docs, docs.count()), (odd, 10), (docs.limit(3), 3)):
        rows = sharding.shard(table).collect()
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        counts = [len(slots[s]) for s in range(8)]
        assert sum(counts) == n and max(counts) - min(counts) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = dict(docs.select("doc_id", "text").collect())
    rows = sharding.shard(docs).collect()
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    ring = sharding.ring(8, 64, 29)
    for r in rows:
        at = int(hashlib.md5(f"29|{r.doc_id}".encode()).hexdigest()[:15], 16)
        assert r.home == next((s for p, s in ring if p >= at), ring[0][1])
    full = collections.Counter(r.home for r in rows)
    assert sum(r.shard != r.home for r in rows) <= sum(max(0, c - len(rows) // 8) for c in full.values())
    assert sharding.shard(docs.limit(0)).count() == 0


def test_licences(spark, odd):
    notice = "Licensed under the Apache License, Version 2.0."
    long = licences.TEMPLATES[1][1]
    rows = [(1, f"some text here\n{notice}\nmore"), (2, notice.upper()), (3, "plain text about a version"), (4, long.replace("; ", ";\n")), (5, None), (6, "Released under the MIT License.")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.part, r.licence) for r in got}
    assert {(1, 1, "Apache-2.0"), (2, 0, "Apache-2.0"), (4, -1, "Apache-2.0"), (6, 0, "MIT")} <= found and {d for d, _, _ in found} == {1, 2, 4, 6}
    assert licences.scan(odd).count() == 0
    # the words by which texts are dropped lose nothing
    for _, text in licences.TEMPLATES:
        w = re.findall(r"[^\W_]+(?:\.[0-9]+)*", text.lower())
        pairs, marks = set(zip(w, w[1:], strict=False)), licences.markers(text, 0.8)
        assert sum(not set(p) & set(marks) for p in pairs) < 0.8 / 1.2 * len(pairs)


def test_licences_within_text(spark):
    mit, gpl, prose = licences.TEMPLATES[4][1], licences.TEMPLATES[6][1], lambda n: "".join(f"then value {i} of the table is read by row x{i} and kept " for i in range(n))
    w = mit.split()
    wrapped = "\n".join(" * " + " ".join(w[i : i + 9]) for i in range(0, len(w), 9))
    w = gpl.split()
    header = "\n".join("# " + " ".join(w[i : i + 7]) for i in range(0, len(w), 7))
    line, code = "Released under the MIT License.", "".join(f"int f{i}() {{ return {i}; }}\n" for i in range(60))
    rows = [
        (1, f"/*\n * A file.\n *\n{wrapped}\n */\n{code}"), (2, prose(20) + gpl + " " + prose(20)), (3, prose(9) + line + " " + prose(9)),
        (4, f"import os\n{header}\n{code}"), (5, prose(50) + " license of the software"), (6, f"{prose(1)}\n{line}\n{prose(1)}"), (7, prose(5) + mit + " " + prose(30) + gpl),
    ]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.part, r.licence) for r in got) == [(1, 3, "MIT"), (2, 0, "GPL-3.0"), (3, 0, "MIT"), (4, 1, "GPL-3.0"), (6, 1, "MIT"), (7, 0, "GPL-3.0"), (7, 0, "MIT")]
    assert all(r.dice > 0.99 for r in got)


def test_personal_data(spark, docs, odd):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def valid(kind, s):
        d = re.sub("[^0-9]", "", s)
        luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return (True, kind == 1 and all(int(p) <= 255 for p in s.split(".")), 12 <= len(d) <= 19 and luhn, 9 <= len(d) <= 15)[kind]

    extra = ["a.b@c.d%e@f.g x@y.z@w.q", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.004", "4111 1111 1111 1111-4111111111111111", "+1 (743) 555-3824) +12+345678901", "\U0001f600 a@b.co", "a" * 20_000, "a@" + "b." * 5_000 + "c"]
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(more)
    rows = personal_data.personal_data(table).join(table.select("doc_id", "text").distinct(), "doc_id").collect()
    for r in rows:
        spans = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, r.text or "") if valid(k, m.group()))
        text = ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        if r.doc_id >= 10_000 or r.doc_id > 8:
            assert (r.base_sha256, [r.n_email, r.n_ip, r.n_card, r.n_phone]) == (hashlib.sha256(text.encode()).hexdigest(), [sum(s[1] == k for s in spans) for k in range(4)])
            assert not text or set(text.split(",")) <= set(r.spans.split(","))
    clean = personal_data.redact(more).where("doc_id = 10003").first().text
    assert clean == "[PHONE]) +12[PHONE]"
    assert personal_data.personal_data(docs.limit(0)).count() == 0


def plain_scores(texts, trusted, order):
    fold = {d: int(hashlib.md5(str(d % 100).encode()).hexdigest()[:15], 16) % 2 + 1 for d in trusted}  # 101 is a copy of 1
    pad = bytes(order - 1)
    grams = {d: [(pad + t.encode())[i:i + order] for i in range(len(t.encode()))] for d, t in texts.items()}

    def model(pick):
        c = collections.Counter(g for d in pick for g in grams[d])
        tails = [collections.Counter() for _ in range(order + 1)]
        heads = [collections.Counter() for _ in range(order + 1)]
        for g, n in c.items():
            for k in range(1, order + 1):
                tails[k][g[order - k:]] += n
                heads[k][g[order - k:-1]] += n
        return sum(c.values()), tails, heads

    def p(m, ratio, g):
        value = 1 / 256
        for k in range(1, order + 1):
            value = (m[1][k][g[order - k:]] * ratio + 5 * value) / (m[2][k][g[order - k:-1]] * ratio + 5)
        return value

    background = model(texts)
    targets = {f: model([d for d in trusted if fold[d] != f]) for f in (0, 1, 2)}
    out = {}
    for d in texts:
        t = targets[fold.get(d, 0)]
        loss = [np.log(p(background, t[0] / max(1, background[0]), g)) - np.log(p(t, 1.0, g)) for g in grams[d]]
        out[d] = (len(loss), float(np.mean(loss)) if loss else 0.0)
    return out


@pytest.mark.parametrize("hot", [1 << 18, 40, 0])
def test_language_model_scores(spark, hot):
    texts = {1: "abab", 2: "abcd", 3: "", 4: "the cat sat on the mat " * 3, 5: "cab \u00fc dab", 6: "abcabc", 7: "dab cab", 8: "x" * 300}
    trusted = [1, 4, 6, 7]
    d = spark.createDataFrame([*texts.items(), (9, None), (1, "abab")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("gram", "fold", "rest", "_row", "t1", "n")})
    lab = spark.createDataFrame([(i, 1) for i in trusted] + [(2, 0), (None, 1)], "doc_id long, quality int")
    want = plain_scores(texts | {101: "abab"}, [*trusted, 101], lm_scoring.ORDER)
    rows = lm_scoring.cross_entropy_difference(d, lab, hot=hot).collect()
    assert len(rows) == 10
    for r in rows:
        n, score = want.get(r.doc_id, (0, 0.0))
        assert r.n_tokens == n and np.isclose(r.ce_diff, score)


def test_language_model_scores_of_one_length(spark):
    """Rows with one id and one length but different texts keep their own scores, wherever the line of hot n-grams lies."""
    d = spark.createDataFrame([(1, "aaaabbbb"), (1, "qwertzui"), (2, "aaaabbbb"), (3, "aaaacccc")], "doc_id long, text string")
    lab = spark.createDataFrame([(2, 1), (3, 1)], "doc_id long, quality int")
    found = [sorted((r.doc_id, round(r.ce_diff, 9)) for r in lm_scoring.cross_entropy_difference(d, lab, hot=h).collect()) for h in (1 << 18, 3)]
    assert found[0] == found[1] and len({x for i, x in found[0] if i == 1}) == 2


def test_language_model_edges(spark, odd, few_labels, docs, labels):
    assert lm_scoring.cross_entropy_difference(odd, few_labels).count() == 10
    assert all(np.isfinite(r.ce_diff) for r in lm_scoring.cross_entropy_difference(odd, few_labels.limit(0)).collect())
    assert lm_scoring.cross_entropy_difference(docs.limit(0), labels).count() == 0


def test_trusted_texts_are_not_scored_by_themselves(spark):
    """Texts of one kind score alike, trusted or not."""
    rng = np.random.default_rng(12)
    words = np.array([f"w{i}" for i in range(200)])
    rows = [(i, " ".join(rng.choice(words, 80))) for i in range(120)]
    lab = spark.createDataFrame([(i, 1) for i in range(0, 120, 3)], "doc_id long, quality int")
    score = {r.doc_id: r.ce_diff for r in lm_scoring.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), lab).collect()}
    a, b = (np.mean([v for i, v in score.items() if (i % 3 == 0) == t]) for t in (True, False))
    assert abs(a - b) < 0.05


def test_code_search_is_exact(spark):
    rng = np.random.default_rng(5)
    codes = np.where(rng.random((600, 4)) < 0.3, 77, rng.integers(0, 1 << 16, (600, 4)))
    rows = [(i, [int(v) for v in c]) for i, c in enumerate(codes)] + [(None, [1, 2, 3, 4]), (900, None)]
    df = spark.createDataFrame(rows, "id long, code array<int>")
    got = collections.defaultdict(list)
    for r in code_search.top_k(df, df.where("id % 50 = 0"), 7, block=200, query_block=5).collect():
        got[r.query_id].append((r["rank"], r.distance, r.neighbor_id))
    for q in range(0, 600, 50):
        far = np.bitwise_count(codes ^ codes[q]).sum(axis=1)
        best = np.lexsort((np.arange(600), far))[:7]
        assert sorted(got[q]) == [(i + 1, far[b], b) for i, b in enumerate(best)]
    v = spark.createDataFrame([([0.5, -1.0, 0.0],), ([],), (None,)], "v array<float>").select(code_search.sign_bits(F.col("v")).alias("c")).collect()
    assert [r.c for r in v] == [[5], None, None]
    assert code_search.top_k(df.limit(0), df).count() == 0


def test_classifier(spark, docs, labels, odd, few_labels):
    rows = byte_cnn.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    odd_rows = byte_cnn.classify(odd, few_labels).collect()
    assert len(odd_rows) == 10
    assert {r.score for r in byte_cnn.classify(odd, few_labels.limit(0)).collect()} == {0.5}
    text = "x" * 3000 + "***"
    parts = byte_cnn.chunks(text)
    seen = np.zeros(len(text), bool)
    for i in range(len(parts)):
        seen[i * 960:i * 960 + 1024] = True
    assert seen.all() and b"***" in parts[-1].tobytes()


def test_one_row_of_each_group_stays(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "b"), (1, text, "b"), (None, text, "c"), (None, text, "c"), (2, text, "d"), (7, "other words that stand alone in here", "x"), (8, None, "x"), (8, None, "x"), (9, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("_row", "_number", "kept", "component_id")})
    out = near_dups.distinct_documents(df, width=5)
    assert out.columns == df.columns
    assert sorted(((r.doc_id or 0, r.text) for r in out.collect()), key=str) == sorted([(2, text), (7, rows[5][1]), (8, None), (8, None), (9, "")], key=str)
    repeated = df.where("doc_id = 1 or doc_id is null")
    assert near_dups.distinct_documents(repeated, width=5).count() == 1 and near_dups.distinct_documents(df.limit(0)).count() == 0


def test_classifier_learns_from_bounded_rows(spark, monkeypatch):
    """However many documents share a labelled id, one text of each picked id is learned from."""
    sizes = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(byte_cnn, "train", lambda texts, labels: sizes.add(len(texts)) or byte_cnn.Net.fresh(1))
    rows = [(i % 6, "good text " * 3 if i % 2 == 0 else "*** | bad " + "y" * (i % 40)) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1 - i % 2) for i in range(6)], "doc_id long, quality int")
    assert byte_cnn.fit(d, lab, sample=4, folds=7) is not None


def test_classifier_on_held_out_rows(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = byte_cnn.classify(d, lab).where("held_out").join(lab, "doc_id").collect()
    score, quality = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    good, bad = score[quality == 1], score[quality == 0]
    auc = np.mean([(g > bad).mean() + (g == bad).mean() / 2 for g in good])
    assert len(rows) > 50 and auc > 0.95


def test_network_is_its_plain_form():
    net = byte_cnn.Net.fresh(3)
    text = "plain text with *** marks " * 90
    rows = byte_cnn.chunks(text)
    value = np.zeros((len(rows), len(net.bias)))
    for c, row in enumerate(rows):
        acts = [sum(net.embed[row[at + w]] @ net.kernel[w] for w in range(byte_cnn.WIDTH)) + net.bias for at in range(0, byte_cnn.CHUNK - byte_cnn.WIDTH + 1, byte_cnn.STEP)]
        value[c] = np.maximum(np.max(acts, axis=0), 0)
    f = len(net.bias)
    z = value.max(axis=0) @ net.weight[:f] + value.mean(axis=0) @ net.weight[f:] + net.offset[0]
    assert np.isclose(byte_cnn.logits(net, rows, np.zeros(len(rows), int), 1)[0], z, atol=1e-4)


def test_edge_rows(spark, odd):
    assert mixing.mix(odd).count() == 10 and mixing.mix(odd.limit(0)).count() == 0
    near = near_dups.near_duplicates(odd).collect()
    assert len(near) == 10 and all(r.kept for r in near if r.n_shingles == 0)
    assert [r.component_id for r in near if r.doc_id == 2] == [1, 1]
    assert near_dups.near_duplicates(odd.limit(0)).count() == 0
