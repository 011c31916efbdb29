"""Each operator against a plain version of itself, and over odd tables."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers
from docloom.llm import (
    common,
    components,
    exact_dedup,
    language,
    mixing,
    packing,
    simhash,
    spotsigs,
    suffix_dedup,
    token_counts,
    token_files,
    tokens,
    toxicity,
)
from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORD = re.compile("[^\x20\x09-\x0d]+")


def test_workers_keep_what_their_work_needs(spark):
    """Batches come in slices, and what a worker keeps for other work goes when a task begins."""

    def run(batches):
        kept = sorted(sys.__dict__.get("_docloom_kept", {}))
        sizes = [b.num_rows for b in batches]
        for name in ("test:a", "test:b"):
            common.worker_cache(name, list)
        yield pa.RecordBatch.from_arrays([pa.array([sizes]), pa.array([kept], pa.list_(pa.string()))], ["sizes", "kept"])

    df = spark.range(0, 1200, 1, 1)
    for _ in range(4):
        found = common.rows_in_arrow(df, run, "sizes array<bigint>, kept array<string>", 512, ("test:a",)).collect()
        assert [r.sizes for r in found] == [[512, 512, 176]] and set(found[0].kept) <= {"test:a"}


# -- 1: suffix arrays ------------------------------------------------------------------------------


def test_suffix_order_is_the_sorted_order():
    rng = random.Random(1)
    for n in [*range(1, 30), 100, 333]:
        for letters in (1, 2, 3, 26):
            text = np.array([rng.randint(1, letters) for _ in range(n)])
            assert suffix_dedup.suffix_order(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


def plain_removal(texts):
    """Removed and kept bytes of ``(id, bytes)`` in order, window by window."""
    seen, out = set(), {}
    for key, raw in texts:
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            window = raw[p : p + 100]
            if window in seen:
                gone[p : p + 100] = True
            seen.add(window)
        spans = int(gone[0] + (gone[1:] & ~gone[:-1]).sum()) if len(raw) else 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[key] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def check_removal(df, texts):
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).drop("kept", "spans").collect()}
    assert found == plain_removal(texts)


def test_op1_documents(documents, rows):
    check_removal(documents, [(r.doc_id, (r.text or "").encode()) for r in rows])


@pytest.mark.parametrize("hot", [5, 1024])
def test_op1_edges(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(hot)
    base = ["".join(rng.choice("ab cde") for _ in range(400)) for _ in range(4)]
    docs = []
    for i in range(150):
        b, x = rng.choice(base), rng.randint(0, 200)
        text = "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 50))) + b[x : x + rng.randint(60, 190)]
        text += (b[:150] if rng.random() < 0.2 else "") + ("a" * rng.randint(0, 400) if rng.random() < 0.2 else "")
        docs.append((i, text + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 90)))))
    docs += [(1000, None), (1001, ""), (1002, "é" * 300), (1003, base[0] * 3)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    check_removal(df, [(i, (t or "").encode()) for i, t in docs])


def phrases(spark, common):
    """Documents that have nothing in common but a passage, each with another text around it."""
    rng = random.Random(common)
    own = lambda: "".join(rng.choice("abcdefgh") for _ in range(300))
    phrase = own()[:common]
    docs = [(k, own() + phrase + own()) for k in range(60)]
    return docs, spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)


@pytest.mark.parametrize(("common", "goes_on"), [(40, False), (52, False), (99, True), (100, True)])
def test_op1_sorts_only_what_may_repeat(spark, common, goes_on):
    """Runs that share an anchor but neither side of it are not sorted; those of a string that repeats are."""
    docs, df = phrases(spark, common)
    collapsed = suffix_dedup._collapse(suffix_dedup._runs(suffix_dedup._packed(df.withColumnRenamed("doc_id", "key"))))
    assert (collapsed.where("anchor is not null").count() > 0) == goes_on
    check_removal(df, [(i, t.encode()) for i, t in docs])


@pytest.mark.parametrize("held", [3, 40, 1 << 17])
def test_op1_kinds_over_batches(spark, held, monkeypatch):
    """Kinds of an anchor that come in many batches, fewer and more than a task holds."""
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    rng = random.Random(held)
    base = "".join(rng.choice("abcdefgh") for _ in range(160))
    docs = []
    for k in range(120):
        x = rng.randint(0, 59)
        docs.append((k, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 80))) + base[x : x + rng.randint(70, 110)] + rng.choice("xyz") * rng.randint(0, 90)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        check_removal(df, [(i, t.encode()) for i, t in docs])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_op1_odd(odd, none):
    found = suffix_dedup.remove_repeats(odd).collect()
    assert collections.Counter(r.doc_id for r in found)[6] == 1 and len(found) == 12
    by = {r.doc_id: r for r in found}
    assert by[4].n_removed > 0 and by[5].n_removed == by[5].n_bytes and by[None].n_removed == by[None].n_bytes == 0 or by[None].n_bytes < 100
    assert bytes(by[6].kept) and suffix_dedup.remove_repeats(none).collect() == []


# -- 2: token counts -------------------------------------------------------------------------------


def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pre_tokens_count_as_the_library_does():
    model, rng = pieces(), random.Random(2)
    parts = ["the", " ", "  ", "\n", "\n\n", "\t", "é", "日本", "▁", "<s>", "!", "123", "ing", "\0", "\r\n", "😀", "\xa0"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert sum(token_counts.pieces_of(model, token_counts.pre_tokens(text))) == len(model.encode(text)), repr(text)


def test_op2(documents, odd, none):
    model = pieces()
    for df in (documents, odd):
        want = collections.Counter((r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 4096) for r in df.collect())
        assert collections.Counter(tuple(r) for r in token_counts.count_tokens(df).collect()) == want
    assert token_counts.count_tokens(none).collect() == []


def test_op2_many_of_one_word(spark):
    df = spark.createDataFrame([(1, "word " * 1000)], "doc_id bigint, text string")
    assert token_counts.count_tokens(df).first().n_tokens == len(pieces().encode("word " * 1000))
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in token_counts.count_tokens(blank).collect()) == [(1, 0, 0, False), (2, 0, 0, False)]


def test_op2_counts_a_pre_token_once(monkeypatch, spark):
    """The library is asked for each distinct pre-token of a bucket once, though many blocks hold it."""
    monkeypatch.setattr(token_counts, "BUCKETS", 2)
    asked = spark.sparkContext.accumulator(0)
    plain = token_counts.pieces_of
    monkeypatch.setattr(token_counts, "pieces_of", lambda model, words: (asked.add(len(words)), plain(model, words))[1])
    df = spark.createDataFrame([(k, f"one two three own{k}") for k in range(40)], "doc_id bigint, text string").repartition(8)
    assert token_counts.count_tokens(df).count() == 40 and asked.value == 43


# -- 3: exact dedup --------------------------------------------------------------------------------


def test_index_is_minimal_and_perfect(spark, documents):
    winners = exact_dedup.digests(documents).groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("copies"))
    _, slots = exact_dedup.build_index(winners)
    n = winners.count()
    assert sorted(r.slot for r in slots.collect()) == list(range(n))


def test_op3_odd(odd, none):
    found = exact_dedup.exact_duplicates(odd).collect()
    assert len(found) == 13
    by = collections.defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    assert (by[1][0].keep_id, by[1][0].group_size, by[1][0].kept) == (2, 2, False) and by[2][0].kept
    assert by[10][0].kept and by[10][0].group_size == 4 and [r.kept for r in by[6]] == [False, False] and not by[None][0].kept
    assert by[4][0].keep_id == 5 and exact_dedup.exact_duplicates(none).collect() == []


def test_op3_history(documents):
    old, new = documents.where("doc_id < 120"), documents.where("doc_id >= 80")
    seen = {r.text_sha256 for r in exact_dedup.exact_duplicates(old).collect()}
    found = exact_dedup.exact_duplicates(new, old).collect()
    assert len(found) == new.count()
    kept = [r.text_sha256 for r in found if r.kept]
    assert len(kept) == len(set(kept)) and set(kept) == {r.text_sha256 for r in found} - seen


def test_op3_history_and_arrivals_both_decide(spark):
    """Texts of history only, of arrivals only and of both; the largest doc_id stays wherever it comes from."""
    docs = [(k, f"Text {k % 17}" if k < 200 else f"only {k}") for k in range(260)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    groups = collections.defaultdict(list)
    for k, t in docs:
        groups[t.lower()].append(k)
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(df).collect()}
    assert found == {k: (max(groups[t.lower()]), len(groups[t.lower()]), k == max(groups[t.lower()])) for k, t in docs}


# -- 4: language -----------------------------------------------------------------------------------


def test_op4_held_out_accuracy(documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    found = language.identify_languages(documents).collect()
    assert len(found) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert sum(r.rejected for r in found) / len(found) < 0.02


def test_op4_rejection(spark, documents):
    model = language.fit(documents)
    strange = "мы были там и видели всё это своими глазами когда наступила ночь над городом и рекой"
    df = spark.createDataFrame([(1, strange), (2, None), (3, "12 34 !"), (4, "the and of")], "doc_id bigint, text string")
    found = {r.doc_id: r for r in language.identify(df, model).collect()}
    assert found[1].rejected and (found[2].lang_pred, found[3].lang_pred) == ("und", "und") and not found[4].rejected


def test_op4_odd(odd, none):
    found = language.identify_languages(odd).collect()
    assert len(found) == 13 and {r.lang_pred for r in found} <= {"en", "fr", "de", "und"}
    assert language.identify_languages(none).collect() == []


def plain_grams(text):
    """Counts of hashed byte n-grams, one by one."""
    data = language.letters_only(text)
    out = collections.Counter()
    for n in language.ORDERS:
        for k in range(len(data) - n + 1):
            code = 0
            for byte in data[k : k + n]:
                code = (code * 0x01000193 + byte + 1) % (1 << 32)
            mixed = (code ^ (code >> 15)) * 0x2C1B3C6D % (1 << 32)
            out[(mixed >> 17) % language.DIMS] += 1
    return out


def test_op4_is_the_plain_nearest_centroid(spark, documents):
    """TF-IDF, k-means and cosine written out, over a table small enough for it."""
    df = documents.where("doc_id % 3 = 0")
    docs = [r for r in df.collect() if r.lang is not None and r.text is not None]
    counts = {r.doc_id: plain_grams(r.text) for r in df.collect() if r.text is not None}
    learned = [r for r in docs if counts[r.doc_id]]
    idf = np.zeros(language.DIMS)
    for r in learned:
        idf[list(counts[r.doc_id])] += 1
    idf = np.log((1 + len(learned)) / (1 + idf)) + 1

    def vector(count):
        v = np.zeros(language.DIMS)
        for d, n in count.items():
            v[d] = (1 + np.log(n)) * idf[d]
        return v / np.linalg.norm(v)

    centroids = []
    for lang in sorted({r.lang for r in learned}):
        own = sorted((language.size_class(language.letters_only(r.text)), sorted(counts[r.doc_id].items())) for r in learned if r.lang == lang)
        own.sort(key=lambda x: (x[0], [d for d, _ in x[1]], [n for _, n in x[1]]))
        points = [vector(dict(x)) for _, x in own]
        means = [points[int(k)] for k in np.linspace(0, len(points) - 1, min(language.CENTROIDS, len(points)))]
        for _ in range(language.ROUNDS):
            groups = collections.defaultdict(list)
            for p in points:
                groups[int(np.argmax([p @ m for m in means]))].append(p)
            means = [sum(groups[k]) / np.linalg.norm(sum(groups[k])) for k in sorted(groups)]
        centroids += [(lang, m) for m in means]
    model = language.fit(df)
    assert len(model.matrix) == len(centroids)
    found = {r.doc_id: r for r in language.identify(df, model).collect()}
    for r in df.collect():
        if not counts.get(r.doc_id):
            assert (found[r.doc_id].lang_pred, found[r.doc_id].score) == ("und", 0.0)
            continue
        scores = [float(vector(counts[r.doc_id]) @ m) for _, m in centroids]
        assert abs(found[r.doc_id].score - max(scores)) < 1e-5
        assert found[r.doc_id].lang_pred in {lang for (lang, _), x in zip(centroids, scores, strict=True) if x > max(scores) - 1e-5}


def test_grams_of_long_texts_are_those_of_the_whole(monkeypatch):
    data = bytes(random.Random(4).randbytes((1 << 20) + 5000))
    at, n = language.grams(data)
    assert n.sum() == sum(len(data) - k + 1 for k in language.ORDERS)


# -- 5: SpotSigs -----------------------------------------------------------------------------------


def plain_signatures(text):
    """Readable chains of a text, found by a walk over its words."""
    common = {*spotsigs.ANCHORS, *spotsigs.SKIPPED}
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    out = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            chain, at, run = [], i + 1, 0
            while at < len(words) and len(chain) < spotsigs.CHAIN:
                run = run + 1 if words[at] in common else 0
                if run > spotsigs.STEP:
                    break
                chain += [words[at]] * (words[at] not in common)
                at += 1
            if len(chain) == spotsigs.CHAIN:
                out.add((w, *chain))
    return out


def test_signatures_are_the_walks(spark, documents):
    found = documents.select("text", spotsigs.signatures(F.coalesce("text", F.lit(""))).alias("s")).collect()
    for r in found:
        extra = 1 if (r.text or "").strip() else 0
        assert len(r.s) == len(plain_signatures(r.text)) + extra


def test_chains_step_over_any_run(spark):
    """Anchors before 9 and before 30,000 common words have their chains."""
    texts = ["the " + "a " * 9 + "cat sat", "the of the " * 10_000 + "cat sat", "cat sat the of", "the cat"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", spotsigs.signatures(F.col("t")).alias("s"))
    assert [len(r.s) for r in df.orderBy("k").collect()] == [2, 3, 1, 1]
    chained = spark.range(1).select(F.xxhash64(F.lit("the cat sat")).alias("x")).first().x
    assert all(chained in r.s for r in df.where("k < 2").collect())


def plain_spots(text):
    """Chains of a text with the signature of its start, or the one of a text without letters."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if words:
        return plain_signatures(text) | {("^", *words[:3])}
    return {("#", *(text or "").split())} if (text or "").strip() else set()


def plain_likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op5(documents, rows):
    found = {r.doc_id: r for r in spotsigs.fingerprints_with_edits(documents).collect()}
    order = sorted(rows, key=lambda r: -r.doc_id)
    for k, r in enumerate(order):
        text, after = r.text or "", order[(k + 1) % len(order)].text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own = found[r.doc_id]
        assert own.n_chars == len(text) and own.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        spots = plain_spots(text)
        assert own.near_edited == pytest.approx(plain_likeness(spots, plain_spots(edited)), abs=1e-12)
        assert own.near_next == pytest.approx(plain_likeness(spots, plain_spots(after)), abs=1e-12)
        assert (own.fingerprint == own.edited_fingerprint) == (spots == plain_spots(edited))
    prints = collections.defaultdict(set)
    for r in rows:
        prints[r.text].add(found[r.doc_id].fingerprint)
    assert all(len(x) == 1 for x in prints.values())


def test_op5_odd(spark, odd, none):
    found = spotsigs.fingerprints_with_edits(odd).collect()
    assert len(found) == 12
    by = {r.doc_id: r for r in found}
    assert by[1].fingerprint == by[2].fingerprint and by[5].near_next == 1.0 and by[5].next_is_near
    assert spotsigs.fingerprints_with_edits(none).collect() == []
    alone = spark.createDataFrame([(1, "the big cat sat of the old mat")], "doc_id bigint, text string")
    assert spotsigs.fingerprints_with_edits(alone).first().near_next == 1.0


def test_near_pairs(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}x" for k in range(300)]
    whole = " ".join(("the " if k % 3 == 0 else "") + w for k, w in enumerate(words))
    docs = [(1, whole), (2, whole.replace("waax", "zzz")), (3, whole), (4, " ".join(reversed(whole.split()))), (5, None), (6, "of one two")]
    members, pairs = spotsigs.near_pairs(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {(r.doc_id, r.class_id) for r in members.collect()} == {(1, 1), (2, 2), (3, 1), (4, 4), (5, 5), (6, 6)}
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 2)]


# -- 6: mixing -------------------------------------------------------------------------------------


def plain_targets(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = sum(weight[s] for s in open_)
        want = {s: cap * sizes[s] if s in full else rest * weight[s] / share for s in order}
        over = {s for s in open_ if want[s] > cap * sizes[s]}
        if not over:
            return want
        full |= over


def check_mix(df, tolerance):
    rows = df.collect()
    size = collections.Counter()
    for r in rows:
        size[r.source] += len(WORD.findall(r.text or ""))
    want, took = plain_targets(size), collections.Counter()
    found = mixing.mix(df).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r.copies <= 3 and r.source_size == size[r.source] and abs(r.target - want[r.source]) <= 1e-6 * max(1, sum(size.values()))
        took[r.source] += r.copies * r.size
    longest = max(len(WORD.findall(r.text or "")) for r in rows)
    for s, t in want.items():
        assert abs(took[s] - t) <= max(tolerance * t, longest / 2 + 1)
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing.mix(df).collect()), key=str)


def test_op6(documents, odd, none):
    check_mix(documents, 0.02)
    check_mix(odd, 1.0)
    assert mixing.mix(none).collect() == []


def test_multipliers_solve_the_dual(spark):
    """Rates that meet targets, against a root finder over one multiplier at a time."""
    sizes = [("a", 3, 50), ("a", 40, 9), ("a", 700, 2), ("b", 5, 10), ("b", 6, 4), (None, 1000, 3)]
    wanted = {"a": 900.0, "b": 200.0, None: 8999.0}
    given = spark.createDataFrame(sizes, "source string, size long, n long")
    tilts = {r.source: r for r in mixing.multipliers(given, spark.createDataFrame(list(wanted.items()), "source string, target double")).collect()}
    for source, target in wanted.items():
        own = [(z, n) for s, z, n in sizes if s == source]
        mean = sum(z * n for z, n in own) / sum(n for _, n in own)
        words = lambda m: sum(z * n * 3 / (1 + 2 * np.exp(np.clip(-m * z / mean, -600, 600))) for z, n in own)  # noqa: B023, E731
        low, high = -700.0, 700.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (low, middle) if words(middle) > target else (middle, high)
        assert tilts[source].mean == pytest.approx(mean)
        assert words(tilts[source].multiplier) == pytest.approx(target, rel=1e-5)
        assert tilts[source].multiplier == pytest.approx(low, rel=1e-2)


def test_op6_capped_source(spark):
    docs = [(k, "a b c", "s1") for k in range(10)] + [(100 + k, "w " * 200, "s2") for k in range(40)]
    check_mix(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), 0.03)


# -- 7: SimHash ------------------------------------------------------------------------------------


def plain_fingerprint(text):
    import xxhash

    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    parent = {k: k for k in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: find(k) for k in prints}


def test_op7(documents, rows):
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    want = plain_components(prints)
    found = simhash.near_duplicates(documents).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found} == {(k, f"{v:016x}", want[k]) for k, v in prints.items()}


@pytest.mark.parametrize("dense", [1024, 4])
def test_links_of_planted_fingerprints(spark, dense, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(7)
    values = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(8):
            values.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    order = sorted(values)
    want = plain_components(dict(enumerate(order)))
    df = spark.createDataFrame([(np.array(v, np.uint64).view(np.int64).item(),) for v in order], "fp bigint")
    reached = {r.node % (1 << 64): r.component % (1 << 64) for r in components.connected_components(simhash.near_links(df)).collect()}
    groups, expected = collections.defaultdict(set), collections.defaultdict(set)
    for k, v in enumerate(order):
        groups[reached.get(v, v)].add(v)
        expected[want[k]].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_op7_odd(odd, none):
    by = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    assert by[1].fingerprint == "0" * 16 and by[3].component_id == 1 and by[10].component_id == by[6].component_id
    assert simhash.near_duplicates(odd).count() == 13 and simhash.near_duplicates(none).collect() == []


def test_components_of_long_chains(spark):
    n = 300
    ids = list(range(n))
    random.Random(3).shuffle(ids)
    df = spark.createDataFrame([(ids[k], ids[k + 1]) for k in range(n - 1)] + [(5, 5), (None, 3)], "a bigint, b bigint")
    found = components.connected_components(df).collect()
    assert {r.node for r in found} == set(range(n)) and {r.component for r in found} == {0} and len(found) == n
    assert components.connected_components(df.limit(0)).collect() == []


# -- 8: packing ------------------------------------------------------------------------------------


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def check_packing(df, capacity):
    t = tokenizer("word_bpe_49k.json")
    found = packing.best_fit(df, capacity).collect()
    ids = {r.text: t.encode(r.text or "", add_special_tokens=False).ids + [1] for r in df.collect()}
    texts = collections.Counter()
    for r in df.collect():
        own = ids[r.text]
        for k, start in enumerate(range(0, len(own), capacity)):
            part = own[start : start + capacity]
            texts[r.doc_id, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == texts
    bins = collections.defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in found) / capacity


def test_op8(documents, odd, none):
    check_packing(documents, 4096)
    check_packing(odd, 64)
    assert packing.best_fit(none).collect() == []


@pytest.mark.parametrize("partitions", [8, 51, 200])
def test_op8_needs_few_sequences(spark, documents, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        bins, least = check_packing(documents.repartition(7), 4096)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert bins <= 1.02 * math.ceil(least) + 1


def test_op8_packs_loose_sequences_again(spark, monkeypatch):
    """Many partitions leave open sequences; later passes fill them."""
    monkeypatch.setattr(packing, "PART_TOKENS", 5000)
    rng = random.Random(8)
    cut = [(k, 0, 0, rng.randint(1, 900), k, k) for k in range(400)]
    df = spark.createDataFrame(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, row bigint")
    found = packing.pack(df, 1000, 64).collect()
    held = collections.defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    assert sorted(r.doc_id for r in found) == list(range(400))
    for own in held.values():
        assert sum(n for _, n in own) <= 1000 and all(o == sum(n for _, n in sorted(own)[:k]) for k, (o, _) in enumerate(sorted(own)))
    assert len(held) <= 1.1 * sum(c[3] for c in cut) / 1000 + 1


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Tokenizing operators in a session whose workers cannot import docloom: their code comes with the tasks."""
    script = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
from docloom.llm import packing, token_counts, token_files
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(1, "the cat sat"), (2, None)], "doc_id bigint, text string")
for f in (packing.best_fit, token_counts.count_tokens, token_files.round_trip):
    assert f(docs).count() == 2
print("ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ran" in done.stdout, done.stderr[-2000:]


def test_open_bins_are_bounded_and_the_fullest_closes():
    bins = packing.OpenBins(10, 2)
    assert [bins.add(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # 1 was fuller than 0 and closed
    assert bins.open == 2 and bins.add(4) == (0, 6) and bins.add(2) == (2, 8) and bins.open == 0


# -- 9: token files --------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_stretches_encode_as_the_whole(name):
    t, rng = tokenizer(name), random.Random(9)
    kept = tokens._Kept(public_tokenizers.path(name))
    parts = ["the", "it's", "don'T", " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "\xa0", "é", "É", "é", "ß", "İ", "123", "4", "!", "?!", ".", "(,", "'s", "'",
             "日本", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", " ", "😀", "Σας", "a.", "-", "_", "\0", "ﬁ", "́"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert kept.serialized(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_op9(documents, rows):
    t, at, want = tokenizer("byte_bpe_50k.json"), 0, {}
    for r in rows:
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        want[r.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.round_trip(documents).collect()} == want


def test_op9_single_documents_and_hashes(spark, documents, rows, tmp_path):
    path, t = f"file://{tmp_path}/ids", tokenizer("byte_bpe_50k.json")
    token_files.write(documents, path, public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows[:3]:
        assert token_files.read_document(spark, path, r.doc_id).tolist() == t.encode(r.text or "", add_special_tokens=False).ids + [0]
    assert token_files.read_document(spark, path, -1) is None
    spark.createDataFrame([(bytearray(b"x"), "00")], "data binary, sha256 string").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError):
        token_files.read(spark, path)


def test_op9_long_documents_have_a_dictionary(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(500)]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(words, k=5000))) for k in range(40)], "doc_id bigint, text string")
    token_files.write(docs, f"file://{tmp_path}/ids", public_tokenizers.path("byte_bpe_50k.json"))
    assert len(spark.read.parquet(f"file://{tmp_path}/ids/dictionary").first().data) > 0
    with pytest.warns(UserWarning, match="no dictionary"):
        assert token_files.train_dictionary([b"x"]) == b""


def test_op9_ids_of_large_vocabularies(spark, tmp_path):
    """Ids beyond 16 bits take 32, and are never cut."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    large = Tokenizer(models.WordLevel({**{f"w{k}": k for k in range(70_000)}}, unk_token="w0"))
    large.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
    file, path = f"{tmp_path}/large.json", f"file://{tmp_path}/ids"
    large.save(file)
    docs = spark.createDataFrame([(1, "w69999 w5 w65536"), (2, "w1")], "doc_id bigint, text string")
    assert token_files.width_of(file) == 4 and token_files.width_of(public_tokenizers.path("byte_bpe_50k.json")) == 2
    with pytest.raises(ValueError, match="need 4 bytes"):
        token_files.write(docs, path, file, id_bytes=2)
    with pytest.warns(UserWarning, match="no dictionary"):
        token_files.write(docs, path, file)
    assert token_files.read_document(spark, path, 1).tolist() == large.encode("w69999 w5 w65536").ids + [0]


def test_op9_odd(odd, none):
    found = token_files.round_trip(odd).collect()
    assert len(found) == 13
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert token_files.round_trip(none).collect() == []


# -- 10: toxicity ----------------------------------------------------------------------------------


def test_op10_held_out(spark):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    docs, labels = [], []
    for k in range(900):
        toxic, bad = rng.random() < 0.2, rng.random() < 0.2
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))] + ["idiot"] * toxic + ["lorem", "click"] * bad
        rng.shuffle(text)
        docs.append((k, " ".join(text)))
        if k < 600:
            labels.append((k, 1 - int(bad), int(toxic)))
        else:
            docs[-1] += (int(toxic), int(bad))
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id bigint, text string")
    given = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.toxic_documents(df, given).collect()}
    for k, _, toxic, bad in docs[600:]:
        assert found[k].toxic == bool(toxic)
        assert (found[k].p_low_quality >= 0.5) == bool(bad)


def test_chain_feeds_earlier_categories():
    rng = np.random.default_rng(0)
    x = rng.random((400, 2)) < 0.5
    first = x[:, 0]
    labels = np.stack([first, first], axis=1).astype(float)
    chain = toxicity.fit_chain([np.nonzero(r)[0] for r in x], labels, ("a", "b"), {"u": 0, "v": 1}, np.arange(400) % 5)
    assert len(chain.models[0].before) == 0 and chain.models[1].before[0] > 0.1
    assert chain.predict("u")[1] > 0.9 and chain.predict("v")[1] < 0.1


def newton(x, y, ridge):
    """Logistic regression by plain Newton steps; the first column is barely penalised."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (p - y) + penalty * w)
    return w


def test_op10_is_the_plain_chain(spark):
    """Models fed out-of-fold probabilities, written out densely, and predictions from a text's words."""
    rng = np.random.default_rng(10)
    names = ["alpha", "beta", "gamma", "delta", "omega"]
    x = (rng.random((240, 5)) < 0.4).astype(float)
    labels = np.stack([x[:, 0] > 0, (x[:, 1] + x[:, 0] > 1) | (rng.random(240) < 0.05)], axis=1).astype(float)
    labels[:7, 1] = np.nan
    folds = np.arange(240) % toxicity.FOLDS
    chain = toxicity.fit_chain([np.nonzero(r)[0] for r in x], labels, ("a", "b"), {n: k for k, n in enumerate(names)}, folds)
    before, models = np.zeros((240, 0)), []
    for k in range(2):
        data, known = np.concatenate([np.ones((240, 1)), before, x], axis=1), ~np.isnan(labels[:, k])
        unseen = np.zeros(240)
        for f in range(toxicity.FOLDS):
            train = known & (folds != f)
            unseen[folds == f] = 1 / (1 + np.exp(-data[folds == f] @ newton(data[train], labels[train, k], toxicity.RIDGE)))
        models.append(newton(data[known], labels[known, k], toxicity.RIDGE))
        before = np.concatenate([before, unseen[:, None]], axis=1)
    texts = [" ".join(n for n, v in zip(names, r, strict=True) if v) for r in x]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in toxicity.classify(df, chain).collect()}
    for k in range(240):
        given = []
        for w in models:
            given.append(1 / (1 + np.exp(-np.concatenate([[1.0], given, x[k]]) @ w)))
        assert found[k].p_a == pytest.approx(given[0], abs=0.01) and found[k].p_b == pytest.approx(given[1], abs=0.02)


def test_op10_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 1), (4, 0, None), (4, 0, 1)], "doc_id bigint, quality int, toxic int")
    found = toxicity.toxic_documents(odd, labels).collect()
    assert len(found) == 13 and all(0 <= r.p_toxic <= 1 for r in found)
    assert all(r.p_toxic == 0.5 for r in toxicity.toxic_documents(odd, labels.limit(0)).collect())
    assert toxicity.toxic_documents(none, labels).collect() == []
