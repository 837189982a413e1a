"""The ten queries as a driver calls them, on small written tables, against SQL or naive counterparts; and odd tables for every operator."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import fingerprints, near_dedup, packing, quality_cnn, quality_rules, queries, sentencepiece_bpe, sharding, substring_dedup, tokenizer_files, toxicity, url_filter

from .test_operators import IDS, SCHEMA, brute_counts, words


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    r, path = random.Random(9), str(tmp_path_factory.mktemp("sf"))
    rows = {x[0]: x for x in IDS}
    toxic = lambda i: i % 6 == 0
    good = ["river", "stone", "walks", "over", "evening", "letter", "quiet", "garden", "of", "the"]
    for i in range(100, 420):
        text = " ".join(r.choice(good) + ("." if r.random() < 0.1 else "") for _ in range(r.randint(50, 90)))
        rows[i] = (i, text + (" You rotten grobian!" if toxic(i) else "") + (" $$$ BUY # " * 30 if i % 4 == 0 else ""), "en", "s", 0)
    spark.createDataFrame(list(rows.values()), SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), int(toxic(i))) for i in range(100, 420)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    urls = [None, "", "http://EXAMPLE.net/en/a", "http://x.net/", "https://b.example.com/de/x#f", "http://a.org/fr/?q", "http://ads-track.example.com/p", "http://y.org/"]
    spark.createDataFrame([(i, u, None) for i, u in enumerate(urls * 3)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path, [rows[k] for k in sorted(rows)]


def rows_of(df):
    names = sorted(df.columns)
    return sorted(repr(tuple(r[c] for c in names)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf[0]}/{t}.parquet/*.parquet')")
    found = con.sql(queries.ORACLE_SQL[name])
    names = sorted(found.columns)
    want = sorted(repr(tuple(dict(zip(found.columns, r, strict=True))[c] for c in names)) for r in found.fetchall())
    assert rows_of(queries.QUERIES[name](spark, sf[0])) == want


def test_op3(spark, sf):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_files.path("piece_bpe_32k.model"))
    sha, want = (lambda b: hashlib.sha256(b).hexdigest()), []
    for d, t, *_ in sf[1]:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids).encode())))
    got = queries.QUERIES["op3_sentencepiece"](spark, sf[0]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == want


def naive_digest(text):
    data, counts = text.encode(), Counter()
    for i in range(len(data) - 2):
        h = (data[i] * 0x9E3779B1 ^ data[i + 1] * 0x85EBCA77 % 2**32 ^ data[i + 2] * 0xC2B2AE3D % 2**32) % 2**32
        counts[h * 0x27D4EB2F % 2**32 >> 25] += 1
    c = [counts[b] for b in range(128)]
    q = [sorted(c)[128 * k // 4 - 1] for k in (1, 2, 3)]
    return [min(255, round(math.log1p(len(data)) / math.log(1.1))), q[0] * 15 // max(1, q[2]), q[1] * 15 // max(1, q[2])], [sum(x > y for y in q) for x in c]


def naive_likeness(a, b):
    score = sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(a[1], b[1], strict=True)) + min(24, abs(a[0][0] - b[0][0])) + min(12, abs(a[0][1] - b[0][1]) + abs(a[0][2] - b[0][2]))
    return max(0.0, 1 - score / 240)


def test_op4(spark, sf):
    texts = [(d, t or "") for d, t, *_ in sf[1]]
    want = []
    for k, (d, t) in enumerate(texts):
        follow = texts[(k + 1) % len(texts)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        own, other, after = naive_digest(t), naive_digest(edited), naive_digest(follow)
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(naive_likeness(own, other), 9), round(naive_likeness(own, after), 9)))
    got = queries.QUERIES["op4_fingerprints"](spark, sf[0]).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    for d, t in texts[:40]:
        head, quartiles = naive_digest(t)
        codes = bytes(a << 6 | b << 4 | c << 2 | e for a, b, c, e in zip(*[iter(quartiles)] * 4, strict=True))
        assert prints[d] == (bytes(head) + codes).hex()


def test_range_numbers_rise(spark):
    for m in (0, 1, 2, 5, 9, 30):
        bounds = [3 * i for i in range(m)]
        df = spark.createDataFrame([(None,), *[(i,) for i in range(-2, 100)]], "x long")
        got = [r["n"] for r in df.select("x", fingerprints.range_number(F.col("x"), bounds).alias("n")).orderBy(F.asc_nulls_first("x")).collect()]
        place = [0, *[sum(b < i for b in bounds) for i in range(-2, 100)]]
        assert got == sorted(got) and [a != b for a, b in zip(got, got[1:])] == [a != b for a, b in zip(place, place[1:])]


def naive_rung(good, alpha, level):
    """The last rung certified for these documents' ratios."""
    last = None
    for i in range(quality_rules.RUNGS):
        k, n = sum(any(x > ladder[i] for x, ladder in zip(g, quality_rules.LADDERS.values(), strict=True)) for g in good), len(good)
        if k > n * alpha or sum(math.comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(k + 1)) > level:
            break
        last = i
    return last


def test_cutoffs_by_brute_force(spark):
    r, rows = random.Random(3), []
    spans = {"en": (400, 0.11), "de": (150, 0.3), "fr": (95, 0.0), "es": (85, 0.0), None: (300, 0.9)}
    for lang, (n, most) in spans.items():
        for _ in range(n):
            rows.append((len(rows), len(rows), lang, r.random() < 0.1, *(most * r.random() ** 3 for _ in quality_rules.LADDERS)))
    rows += [(i, i, *rows[0][2:]) for i in range(5000, 5003)]
    rows.append((6000, *rows[1][1:]))  # a labelled copy of a text counts once
    measured = spark.createDataFrame(rows, "doc_id long, text_hash long, lang string, base_failed boolean, " + ", ".join(f"{x} double" for x in quality_rules.LADDERS))
    bad = {i for i in range(0, 1030, 7)}
    labels = spark.createDataFrame([(x[0], int(x[0] not in bad)) for x in rows], "doc_id long, quality int")
    got = {x["stratum"]: x for x in quality_rules.cutoffs(measured, labels).collect()}
    held = defaultdict(dict)
    for d, h, lang, failed, *ratios in rows:
        if d not in bad and not failed:
            held[lang or "other"][h] = ratios
    rungs = {s: naive_rung(list(g.values()), quality_rules.ALPHA, quality_rules.DELTA / 5) for s, g in held.items()}
    assert {s: x["rung"] for s, x in got.items()} == rungs and {s: x["n"] for s, x in got.items()} == {s: len(g) for s, g in held.items()}
    assert rungs["fr"] is None and rungs["es"] is None and rungs["en"] is not None and rungs["de"] is not None
    limits = {s: {k: None if rungs[s] is None else v[rungs[s]] for k, v in quality_rules.LADDERS.items()} for s in rungs}
    want = {d: not failed and not any(limits[lang or "other"][k] is not None and x > limits[lang or "other"][k] for k, x in zip(quality_rules.LADDERS, ratios, strict=True)) for d, h, lang, failed, *ratios in rows}
    assert {x["doc_id"]: x["kept"] for x in quality_rules.judge(measured, quality_rules.cutoffs(measured, labels)).collect()} == want


def test_op5(spark, sf):
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_quality_rules"](spark, sf[0]).collect()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {d: tuple(r[c] for c in names) for d, r in got.items()} == {d: brute_counts(t) for d, t, *_ in sf[1]}
    # 240 good labels of one language certify cutoffs: the bad documents do not pass, and nearly all good ones do
    assert not any(got[i]["kept"] for i in range(100, 420, 4))
    good = [got[i] for i in range(100, 420) if i % 4 and not got[i]["base_failed"]]
    assert sum(not r["kept"] for r in good) <= 0.05 * len(good)


def naive_net(net, text):
    p, features = net.p, []
    for start in range(0, max(1, len(text) - quality_cnn.CHUNK + quality_cnn.HOP), quality_cnn.HOP):
        chunk = list(text[start : start + quality_cnn.CHUNK])
        chunk += [quality_cnn.PAD] * (quality_cnn.CHUNK - len(chunk))
        r = [p["embed"][chunk[i : i + quality_cnn.WIDTH]].ravel() @ p["filters"] for i in range(0, quality_cnn.CHUNK - quality_cnn.WIDTH + 1, quality_cnn.STRIDE)]
        features.append(np.maximum(np.max(r, axis=0) + p["bias"], 0))
    z = np.mean(features, axis=0) @ p["out"][: quality_cnn.FILTERS] + np.max(features, axis=0) @ p["out"][quality_cnn.FILTERS :] + p["offset"][0]
    return 1 / (1 + math.exp(-z))


def test_op6(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf[0]}/{t}.parquet") for t in ("documents", "labels"))
    net = quality_cnn.train_quality(docs, labels)
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_quality_cnn"](spark, sf[0]).collect()}
    assert len(got) == len(sf[1])
    for d, t, *_ in sf[1]:
        r = got[d]
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7)
        if d < 60:
            assert abs(r["score"] - naive_net(net, (t or "").encode())) < 1e-4
    assert np.mean([got[i]["predicted"] == (i % 4 > 0) for i in range(100, 420) if got[i]["held_out"]]) > 0.95


def test_long_labelled_texts_are_learned_from(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (5000 if i == 3 else 5)) for i in range(8)], "doc_id long, text string")
    texts, y = quality_cnn.training_sample(docs, docs.select("doc_id", F.lit(1).alias("toxic")), "toxic", F.lit(True), 100)
    assert max(len(t) for t in texts.to_pylist()) == 35000 and len(y) == 8


def naive_packing(lengths, capacity, limit):
    """Online best-fit with at most ``limit`` open bins, by looking at all of them: (bin, offset) of each piece, and how many bins closed early."""
    open_, made, placed, closed = [], 0, [], 0  # [free, bin], the latest touched last
    for n in lengths:
        if n >= capacity:
            placed.append((made, 0))
            made += 1
            continue
        fits = [b for b in open_ if b[0] >= n]
        if fits:
            least = min(b[0] for b in fits)
            bin_ = [b for b in fits if b[0] == least][-1]
            open_.remove(bin_)
        else:
            if len(open_) >= limit:
                least = min(b[0] for b in open_)
                open_.remove([b for b in open_ if b[0] == least][-1])
                closed += 1
            bin_, made = [capacity, made], made + 1
        placed.append((bin_[1], capacity - bin_[0]))
        if bin_[0] > n:
            open_.append([bin_[0] - n, bin_[1]])
    return placed, closed


def test_packing_is_online_and_bounded(spark):
    r = random.Random(2)
    lengths = [r.randint(0, 100) for _ in range(800)]
    want, closed = naive_packing(lengths, 100, 4)
    assert closed > 50
    parts = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "i int, length long, offset string").coalesce(1)
    got = packing.pack(parts, 100, 4, 10**6).orderBy("i").collect()
    assert [(x["sequence_id"], x["offset_"]) for x in got] == want and got[0]["offset"] == "x"
    with pytest.raises(Exception, match="length"):
        packing.pack(spark.createDataFrame([(None,)], "length long")).collect()


def test_words_are_encoded_alone_only_where_the_file_allows(tmp_path):
    from tokenizers import Tokenizer

    texts = ["Ab, c. D<|endoftext|>e <|ENDOFTEXT|> x́ it's  Y", "", "  one "]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        tokens, lib = packing.WordTokens(tokenizer_files.path(name)), Tokenizer.from_file(tokenizer_files.path(name))
        assert tokens.by_word == name.startswith("word")
        ids, ends = tokens.encode(pa.array(texts, pa.large_string()), 1)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [[*lib.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_op7(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_files.path("word_bpe_49k.json"))
    want, by = [], defaultdict(list)
    for d, t, *_ in sf[1]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(d, k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    got = queries.QUERIES["op7_packing"](spark, sf[0]).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 4096
    assert len(by) <= -(-sum(x[3] for x in want) // 4096) + 1


def naive_toxicity(model, text):
    scores = []
    for sentence in re.split("[.!?\n]", text):
        plain = re.sub(r"[\x00-\x26\x28-\x2f:;<=>@\[\\\]^_`{|}~]+", " ", sentence.lower())
        found = words(plain)
        z = model.bias + sum(float(model.weights[f]) for w in found for f in toxicity.features(pa.array([w], pa.large_string()))[0]) if found else -30
        scores.append(1 / (1 + math.exp(-z)))
    worst, floor = max(scores), toxicity.FLOOR
    scores.remove(worst)
    return 1 - (1 - worst) * math.prod(1 - max(0, p - floor) / (1 - floor) for p in scores)


def test_op8(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf[0]}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train_toxicity(docs, labels)
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_toxicity"](spark, sf[0]).collect()}
    for d, t, *_ in sf[1]:
        r = got[d]
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5)
        if d % 3 == 0 and len(t or "") < 2000:
            assert abs(r["score"] - naive_toxicity(model, t or "")) < 1e-6
    assert np.mean([got[i]["predicted"] == (i % 6 == 0) for i in range(100, 420)]) > 0.98
    # length alone makes nothing toxic, and hides nothing
    calm = "The quiet river walks over the stone. " * 20_000
    for text, low, high in ((calm, 0, 0.1), (calm + "You rotten grobian! " + calm, 0.5, 1)):
        d, s, w, _ = toxicity.sentence_bags(pa.array([text], pa.large_string()))
        assert low <= model.document_scores(1 / (1 + np.exp(-model.sentence_logits(s, w))), d)[0] <= high


def test_window_names_are_independent():
    r = np.random.default_rng(4)
    a, b = (r.integers(0, 2**63, 120).astype(np.uint64) for _ in range(2))
    assert (substring_dedup.window_names(a)[:71] == substring_dedup.window_names(a.copy())[:71]).all()
    assert (substring_dedup.window_names(a)[:71] != substring_dedup.window_names(b)[:71]).all()
    texts = pa.array([" ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))], pa.large_string())
    # two word sequences with (forged) equal first hashes are told apart by their second ones
    _, (h, g) = substring_dedup._words(texts, 9, 10)
    h[50:] = h[:50]
    names, checks = substring_dedup.window_names(h), substring_dedup.window_names(g)
    assert names[0] == names[50] and checks[0] != checks[50]


def test_op10(spark, sf):
    got = queries.QUERIES["op10_sharding"](spark, sf[0]).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in sf[1]]
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    n = [len(slots[s]) for s in range(16)]
    assert max(n) - min(n) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_ring_overflow_by_brute_force(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    for slack in (0.0, 0.1):
        got = sharding.shard(docs, 5, 8, slack).collect()
        owners, room = [s for _, s in sharding.ring(5, 8)], sharding.capacities(3000, 5, slack)
        counts, free, used = Counter(r["arc"] for r in got), list(room), Counter()
        over = {}
        for arc, s in enumerate(owners):  # every arc's own shard first, then the overflow row by row
            take = min(counts[arc], free[s])
            free[s] -= take
            used[arc, s] += take
            over[arc] = counts[arc] - take
        for arc in range(len(owners)):
            for _ in range(over[arc]):
                step = next(k for k in range(1, len(owners) + 1) if free[owners[(arc + k) % len(owners)]])
                s = owners[(arc + step) % len(owners)]
                free[s] -= 1
                used[arc, s] += 1
        assert Counter((r["arc"], r["shard"]) for r in got) == +used


def test_odd_tables(spark):
    """Empty tables, extra columns with clashing names, repeated rows and a text of a megabyte, for operators that no other test gives them."""
    long = " ".join(f"w{i * 7919 % 50021}" for i in range(150_000))
    rows = [(1, long), (1, long), (2, None), (3, ""), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in "score range head next_text kept failed_rules n_words text_hash stratum name later lo ids decoded lang".split()})
    net, model, path = quality_cnn.ByteNet(), toxicity.SentenceModel(), tokenizer_files.path("piece_bpe_32k.model")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    made = {
        "op3": lambda d: sentencepiece_bpe.encode_documents(d, path), "op4": fingerprints.fingerprint_documents, "op4 next": fingerprints.with_next,
        "op5": lambda d: quality_rules.quality_rules(d, labels), "op6": lambda d: quality_cnn.score_quality(d, net), "op8": lambda d: toxicity.score_toxicity(d, model),
        "op9": substring_dedup.remove_repeats, "op2": near_dedup.near_duplicates, "op7": lambda d: packing.pieces(d, tokenizer_files.path("word_bpe_49k.json")), "op10": sharding.shard,
    }
    for name, f in made.items():
        assert f(docs.limit(0)).count() == 0, name
        out = f(docs)
        assert len(set(out.columns)) == len(out.columns), name
        found = out.groupBy("doc_id").count().collect()
        want = {1: 2, 2: 1, 3: 1, None: 1}
        assert {r["doc_id"]: r["count"] for r in found if name != "op7" or r["doc_id"] != 1} == {k: v for k, v in want.items() if name != "op7" or k != 1}, name
    pages = spark.createDataFrame([], "page_id long, url string, host string, verdict string")
    listed = spark.createDataFrame([("a.org/", "block", 0)], "key string, verdict string, priority int")
    assert url_filter.filter_urls(pages, listed).count() == 0 and url_filter.filter_urls(pages, listed.limit(0)).count() == 0
