"""Operators against plain restatements of their rules, on small tables."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkindex.llm import extract, license_rules, licenses, minhash, packing, pipeline, positional, quality, quotes, sharding, simhash, sketch, warc
from sparkindex.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def roots(items, linked):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def plain_simhash(text, k=4):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"](spark, SF).collect()}
    prints = {d: plain_simhash(t) for d, t in docs.items()}
    ids = sorted(docs)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 4]
    root = roots(ids, pairs)
    assert got == {d: (f"{prints[d]:016x}", root[d]) for d in ids}


def near_copies(seed=7):
    """Texts and copies of them with words replaced, so that many have similarity about 0.8."""
    rng = random.Random(seed)
    texts = [None, "", " \t", "one two", "One  two", "one two three"]
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 300))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(1, 5)):
            copy = list(words)
            for at in rng.sample(range(len(copy)), round(len(copy) * rng.uniform(0.001, 0.035))):
                copy[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    words = [f"v{k}" for k in range(200)]
    texts += [" ".join(words[:k] + [f"y{k}"] + words[k + 1 :]) for k in range(150)]  # one large group
    return texts


def five_word_sets(texts):
    sets = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return sets


def test_near_duplicate_stage(spark, docs):
    """The stage keeps the first of each group that five-word similarity 0.8 connects."""
    texts = near_copies() + [docs[d] for d in sorted(docs)]
    sets = five_word_sets(texts)
    pairs = []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)):
                pairs.append((i, j))
    assert sum(0.8 <= len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.9 for i, j in pairs if sets[i]) > 20
    root = roots(range(len(texts)), pairs)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    left = pipeline.one_of_each_group(spark, table, SF).collect()
    assert sorted(r.doc_id for r in left) == sorted({*root.values()})


def test_near_duplicate_stage_by_fingerprints(spark, monkeypatch):
    """Without bands, the stage drops what SimHash groups and the check of texts confirms."""
    texts = [t for t in near_copies() if t and t.split()]
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(tuple(t.lower().split()), i)
    prints = {i: plain_simhash(texts[i], 5) for i in first.values()}
    seen, marked, grouped = [], minhash._marked, minhash.grouped
    monkeypatch.setattr(minhash, "_marked", lambda *a: marked(*a).withColumn("bands", F.array().cast("array<long>")))
    monkeypatch.setattr(minhash, "grouped", lambda *a, **k: seen.append(grouped(*a, **k)) or seen[-1])
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    monkeypatch.setattr(minhash, "discard", lambda df: None)
    gone = {r.id for r in minhash.repeats(rows, "id").collect()}
    groups = {r.id: (r.fp % 2**64, r.component_id) for r in seen[0].collect()}
    assert {i: fp for i, (fp, _) in groups.items()} == prints
    ids = sorted(prints)
    close = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert all(groups[a][1] == groups[b][1] for a, b in close)
    sets = five_word_sets(texts)
    like = {i for i, (_, c) in groups.items() if i != c and len(sets[i] & sets[c]) >= 0.8 * len(sets[i] | sets[c])}
    assert gone == like | {i for i in range(len(texts)) if i not in prints}
    assert len(like) > 100 and any((prints[i] ^ prints[groups[i][1]]).bit_count() > 4 for i in like)


def test_pipeline_by_brute_force(spark):
    """Each stage's decision, restated plainly, over all rows of the smallest tables."""
    import corpus_pipeline

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    scores = {r.id: r.score for r in quality.quality_scores(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    left = [r for r in rows if scores[r.doc_id] >= 0.3]
    sets = five_word_sets([r.text for r in left])
    pairs = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or len(a & b) >= 0.8 * len(a | b)]
    root = roots(range(len(left)), pairs)
    left = [r for k, r in enumerate(left) if root[k] == k]
    hits = plain_hits({r.doc_id: r.text for r in left}, [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    left = [r for r in left if not hits[r.doc_id][1]]
    encode, want = packing.encoder(packing.default_vocabulary()), set()
    for r in left:
        ids = [*encode(r.text or ""), 0]
        at = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want |= {(r.doc_id, k, a, b - a) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length) for r in got} == want and len(got) == len(want)
    assert 20 < len(left) < len(rows)


@pytest.mark.parametrize(("crowd", "k"), [(2, 2), (10_000, 2), (10_000, 3), (10_000, 4)])
def test_links_in_dense_balls(spark, crowd, k):
    """Crowded buckets give the same components as pairs do."""
    draw = random.Random(5)
    values = {0}
    for _ in range(12):
        base = draw.getrandbits(64)
        values |= {base ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(9))) for _ in range(15)}
    signed = [v - 2**64 if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = [(r.a, r.b) for r in simhash.links(nodes, crowd=crowd, k=k).collect()]
    exact = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 4]
    assert roots(signed, edges) == roots(signed, exact)


def test_links_beyond_the_radius(spark):
    """With reach, no link of the radius is lost and none is longer than the reach."""
    draw = random.Random(6)
    values = set()
    for _ in range(60):
        base = draw.getrandbits(64)
        values |= {base ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(11))) for _ in range(4)}
    signed = [v - 2**64 if v >> 63 else v for v in values]
    edges = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), reach=10).collect()]
    bits = [((a ^ b) % 2**64).bit_count() for a, b in edges]
    assert max(bits) <= 10 and sum(x > 4 for x in bits) > 20
    root = roots(signed, edges)
    assert all(root[a] == root[b] for a in signed for b in signed if ((a ^ b) % 2**64).bit_count() <= 4)


def test_more_blocks_for_more_fingerprints():
    assert [simhash.agreeing(n) for n in (0, 5 * 10**7, 10**9, 10**11)] == [2, 2, 3, 4]
    assert all(sum(simhash.block_widths(4, k)) == 64 for k in (2, 3, 4))


def test_tokenizers_agree(docs):
    """Merge ranks give the ids that the tokenizers library gives."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    encode = packing.encoder(packing.default_vocabulary())
    odd = ["", " ", "\n\n a", "<|endoftext|> x", "it's We'LL", "a\u0000b", "​ x", "１２ ½ ³", "\U0001f469‍\U0001f680 हिन्दी", "a" * 5000, "  \t " * 50, "ȩ́"]
    for text in [*docs.values(), *odd]:
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_pack_query(spark, docs):
    encode = packing.encoder(packing.default_vocabulary())
    expected = {}
    for d, text in docs.items():
        ids = np.asarray([*encode(text or ""), 0], "<u4")
        first = len(ids) % 2048 or 2048
        at = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            expected[d, k] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    rows = QUERIES["op1_pack"](spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in rows) // 2048) + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    draw = random.Random(seed)
    histogram = {draw.randrange(1, 65): draw.randrange(1, 30) for _ in range(20)}
    segments, bins = packing.plan_bins(histogram, 64)
    load, ranks = defaultdict(int), defaultdict(list)
    for length, first, n, copies, bin_, _ in segments:
        ranks[length] += range(first, first + n)
        for k in range(n):
            load[bin_ + k // copies] += length
    assert {k: len(v) for k, v in ranks.items()} == histogram and all(sorted(v) == list(range(len(v))) for v in ranks.values())
    assert max(load.values()) <= 64 and len(load) == bins


def test_fullest_is_fullest():
    draw = random.Random(1)
    for _ in range(50):
        left = {draw.randrange(1, 20): draw.randrange(1, 4) for _ in range(5)}
        room = draw.randrange(1, 60)
        sums = {0}
        for length, n in left.items():
            sums |= {s + k * length for s in sums for k in range(n + 1)}
        chosen = packing.fullest(room, sorted(left, reverse=True), left)
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)
        assert all(n <= left[k] for k, n in chosen.items())


def plain_hits(docs, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, text in items:
        words = word.findall(lower(text))
        for k in range(max(1, len(words) - size + 1) if words else 0):
            windows[tuple(words[k : k + size])].add(str(i))
    lengths, out = {len(w) for w in windows}, {}
    for d, text in docs.items():
        words, hit, found = word.findall(lower(text)), set(), set()
        for n in lengths:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    found |= windows[tuple(words[k : k + n])]
                    hit |= set(range(k, k + n))
        out[d] = (len(words), len(hit), sorted(found))
    return out


def test_contamination_query(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = plain_hits(docs, items)
    rows = QUERIES["op10_decontaminate"](spark, SF).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    assert got == {d: (w, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, (w, h, i) in expected.items()}
    assert any(r.contaminated for r in rows)


def test_contamination_in_groups_and_proximity(spark):
    docs = {1: "a b c d e f", 2: "x a b z c d", 3: "c d a b", 4: "a b a b c d c d", 5: None}
    items = [(10, "a b c d"), (11, "d e f"), (12, "q"), (13, "f"), (14, "q r a")]
    index = positional.write_index(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), shard_bytes=30)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = {r.id: (r.n_words, r.n_hit, r["items"], r.near_items) for r in positional.search(index, benchmark, slop=1).collect()}
    groups = {r.id: (r.n_words, r.n_hit, r["items"], r.near_items) for r in positional.search(index, benchmark, slop=1, group_windows=1).collect()}
    assert whole == groups
    assert {d: v[:3] for d, v in whole.items()} == {d: (w, h, i) for d, (w, h, i) in plain_hits(docs, items).items()}
    assert whole[2][3] == ["10"] and whole[3][3] == []


@pytest.mark.parametrize("group_windows", [1, 1000])
def test_equal_shards_keep_their_rows(spark, group_windows):
    """Partitions of equal content, ids and all, do not merge; nor do null ids."""
    first = F.col("id") % 2 == 0
    docs = spark.range(0, 8, 1, 4).select(F.when(~first, F.lit(3)).alias("doc_id"), F.when(first, "a b c d").otherwise("x y").alias("text"))
    index = positional.write_index(docs)
    assert index.select("shard").distinct().count() == 4
    benchmark = spark.createDataFrame([(1, "b c"), (2, "d"), (3, "c d")], "item_id long, text string")
    got = sorted(tuple(r[1:4]) for r in positional.search(index, benchmark, group_windows=group_windows).collect())
    assert got == [(2, 0, [])] * 4 + [(4, 3, ["1", "2", "3"])] * 4


def test_proximity_does_not_depend_on_shards(spark):
    draw = random.Random(2)
    docs = {k: " ".join(draw.choice("abcdefgh") for _ in range(30)) for k in range(40)}
    items = {k: " ".join(draw.choice("abcdefgh") for _ in range(4)) for k in range(12)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")

    def near(words, window, slop):
        return any(all(w in words[max(0, s + o - slop) : max(0, s + o + slop + 1)] for o, w in enumerate(window)) for s in range(-slop, len(words) + slop))

    for size in (60, 10_000):
        for r in positional.search(positional.write_index(frame, shard_bytes=size), benchmark, slop=2).collect():
            words = docs[r.id].split()
            exact = {str(i) for i, t in items.items() if f" {t} " in f" {docs[r.id]} "}
            expected = {str(i) for i, t in items.items() if near(words, t.split(), 2)} - exact
            assert set(r["items"]) == exact and set(r.near_items) == expected


@pytest.mark.parametrize("shared", [0, 100])
def test_warc_round_trip(spark, tmp_path, shared):
    big, other = "<p>same</p>" * 200, "é " * 600
    rows = [(1, "http://a/ b?c=%20\r\nX: y", big), (5, None, big), (3, "http://é/", big), (4, "u", "<p>small</p>"), (6, "u", "<p>small</p>"), (7, "u", None), (8, "u", other), (None, "n", big), (5, "twice", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = f"{tmp_path}/archives"
    warc.write_archives(warc.with_decision(pages, shared_payloads=shared).coalesce(2), path)
    got = warc.read_archives(spark, path, with_html=True).collect()
    assert len(got) == len(rows)
    html = {i: h or "" for i, _, h in rows}
    for r in got:
        payload = html[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        revisit = r.page_id in (1, 3, None)
        assert (r.record_type, r.refers_to) == (("revisit", 5) if revisit else ("response", None))
        assert r.html == (None if revisit else html[r.page_id])
    assert {(r.page_id, r.url) for r in got} == {(i, u) for i, u, _ in rows}
    assert warc.read_archives(spark, path).where("false").count() == 0


def test_warc_frames_are_standard(spark, tmp_path):
    """An archive opens with its dictionary; any decoder reads record after record."""
    import struct

    import zstandard

    texts = [f"<html>{k} " + "lorem ipsum " * 40 for k in range(400)]
    data = warc.EMPTY_FRAME.join(warc.archives(warc.page_record(k, k, None, t.encode()) for k, t in enumerate(texts)))
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.DICTIONARY_MAGIC
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(data[8 + size :], read_across_frames=True)
    assert reader.read().count(b"WARC-Type: response") == len(texts)
    assert len(list(warc.records_of(data))) == len(texts) + 1
    assert list(warc.archives(iter([]))) == []


@pytest.mark.parametrize("n", [1, 7, 500])
def test_archives_are_bounded(spark, tmp_path, n):
    """One partition makes several archives, each with its dictionary; record ids differ."""
    draw = random.Random(n)
    rows = [(k % 5 or None, f"u{k}", "".join(chr(draw.randrange(33, 126)) for _ in range(draw.randrange(3000)))) for k in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = f"{tmp_path}/archives"
    warc.write_archives(warc.with_decision(pages), path, chunk_bytes=20_000, chunks=3)
    files = sorted(x for x in os.listdir(path) if x.endswith(".warc.zst"))
    assert len(files) >= n // 100
    ids = []
    for name in files:
        with open(f"{path}/{name}", "rb") as file:
            data = file.read()
        assert data[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little") and len(data) < 3 * 30_000 + warc.DICTIONARY_BYTES
        ids += [warc.parse_record(r)[0]["WARC-Record-ID"] for r in warc.records_of(data)][1:]
    assert len(ids) == len(set(ids)) == n
    got = warc.read_archives(spark, path, with_html=True).collect()
    assert sorted((r.url, r.html) for r in got) == sorted((u, h) for _, u, h in rows)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op4_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95


def test_quality_equations(spark, docs):
    """The sums over partitions solve to what one solution over all rows does, and the
    held-out labels have no influence."""
    sf = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    stats = quality.with_statistics(table.repartition(5))
    model = quality.fit(stats, labels)
    marked = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(zlib.crc32(str(r.id).encode()) % 5, r.x, marked[r.id]) for r in stats.collect() if r.id in marked]
    z = model.features(np.asarray([x for f, x, _ in rows if f > 1]))
    y = np.asarray([v for f, _, v in rows if f > 1], float)
    penalty = quality.PENALTY * len(y) / quality.FEATURES * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    assert np.allclose(z @ beta, z @ model.beta, atol=1e-6)
    x = np.clip((np.asarray([x for f, x, _ in rows if f > 1]) - model.mean) / model.scale, -5, 5)
    kernel = np.exp(-(quality.WIDTH**2) / 2 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert abs(z[:, :-1] @ z[:, :-1].T - kernel).mean() < 0.08
    flipped = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    a, b = ({r.id: r.score for r in quality.quality_scores(table, given).collect()} for given in (labels, flipped))
    assert a == b


def test_isotonic_by_brute_force():
    draw = random.Random(9)
    for _ in range(20):
        y = np.array([draw.random() for _ in range(12)])
        w = np.array([draw.randrange(1, 5) for _ in y], float)
        mean = lambda j, k: (y[j : k + 1] * w[j : k + 1]).sum() / w[j : k + 1].sum()
        want = [max(min(mean(j, k) for k in range(i, len(y))) for j in range(i + 1)) for i in range(len(y))]
        assert np.allclose(quality.isotonic(y, w), want)


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_sketch(text, scale=8):
    """The sketch and the least hash, from the words' hashes."""
    import xxhash

    def of(shingle):
        value = 42
        for word in shingle:
            value = xxhash.xxh64_intdigest(xxhash.xxh64_intdigest(word.encode(), 42).to_bytes(8, "little"), value)
        return value >> 1

    values = {of(x) for x in plain_shingles(text)}
    return sorted(v for v in values if v < 2**63 // scale), min(values, default=None)


def plain_print(text):
    kept, least = plain_sketch(text)
    return "".join(f"{v:016x}" for v in kept) if kept or least is None else f"~{least:016x}"


def plain_likeness(a, b):
    (a, least_a), (b, least_b) = plain_sketch(a), plain_sketch(b)
    return len({*a} & {*b}) / len({*a} | {*b}) if a or b else float(least_a == least_b)


def test_sketch_query(spark, docs):
    rows = {r.doc_id: r for r in QUERIES["op5_sketch"](spark, SF).collect()}
    order = sorted(docs, reverse=True)
    miss = []
    for k, d in enumerate(order):
        text, after = docs[d] or "", docs[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (plain_print(text), plain_print(edited))
        assert (r.near_edited, r.near_next) == (plain_likeness(text, edited), plain_likeness(text, after))
        a, b = plain_shingles(text), plain_shingles(edited)
        miss.append(abs(r.near_edited - len(a & b) / max(1, len(a | b))))
    assert np.mean(miss) < 0.12


@pytest.mark.parametrize("ids", ["many", "large", "hot", "one"])
def test_next_document_over_many_windows(spark, ids):
    import xxhash

    rows = [(k, f"t{k}") for k in range(200)] + [(50, "again"), (None, "null"), (120, "t120")]
    if ids == "large":
        rows = [(None if k is None else (1 << 62) + k, text) for k, text in rows]
    if ids in ("hot", "one"):
        rows += [(70 if ids == "hot" else None, f"hot {k % 90}") for k in range(150)]
    if ids == "one":
        rows = [(3, text) for _, text in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.text, r.next_text, r.next_of) for r in sketch.with_next(docs, window_bytes=40, of_text=F.upper).collect())

    def tie(text):
        return xxhash.xxh64_intdigest(text.encode(), 42) >> 11

    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -1), -tie(r[1])))
    assert got == sorted((a[1], b[1], b[1].upper()) for a, b in zip(order, [*order[1:], order[0]], strict=True))


def test_sketches_merge_and_contain(spark, docs):
    """At the scale in use: parts merge to the whole, and an excerpt lies in its source."""
    rows = [(k, " ".join(words[at : at + n]), text) for k, text in docs.items() for words in [re.findall(r"[^\x20\x09-\x0D]+", text or "")] for at in (0, 7, 40) for n in (9, 30, 200) if len(words) >= at + n]
    found = spark.createDataFrame(rows, "id long, part string, text string").select("id", sketch.sketch(F.col("part")).alias("p"), sketch.sketch(F.col("text")).alias("s"))
    inside = found.select("p", sketch.containment(F.col("p"), F.col("s")).alias("c")).collect()
    assert all(r.c == (1.0 if r.p else None) for r in inside) and sum(r.c is None for r in inside) > 5 and len(inside) > 100
    words = " ".join(f"w{k}" for k in range(900)).split()
    parts = [" ".join(words[k : k + 104]) for k in range(0, 900, 100)]  # parts share four words, so that no shingle is lost
    whole = spark.createDataFrame([(x,) for x in parts], "text string").agg(sketch.merged(F.collect_list(sketch.sketch(F.col("text")))).alias("m")).first().m
    assert whole == plain_sketch(" ".join(words))[0] and len(whole) > 80


def shards_of(rows, shards):
    """What holds whatever the method: sizes, places without gaps, counts at most one apart;
    returns the shards of each text."""
    groups, slots = defaultdict(list), defaultdict(list)
    for text, r in rows:
        text = text or ""
        assert (r["size"], r.text_crc32) == (len(text.encode()) + 8, zlib.crc32(text.encode()))
        groups[text].append(r.shard)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))
    counts = [len(slots[k]) for k in range(shards)]
    assert max(counts) - min(counts) <= 1
    return groups


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_shard_query(spark, sf):
    """Every group of equal texts that is no larger than a shard is whole."""
    path = f"/root/testdata/{sf}"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = QUERIES["op6_shards"](spark, path).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text) and {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    groups = shards_of([(text[r.doc_id], r) for r in rows], 24)
    assert [t for t, v in groups.items() if len(set(v)) > 1 and len(v) <= len(text) // 24] == []
    assert sum(len(v) > 1 for v in groups.values()) > 5


def test_shards_keep_groups(spark):
    rows = [(k, f"text {k // 3}" if k < 300 else "hot" if k < 500 else f"single {k}") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    groups = shards_of([(text[r.id], r) for r in sharding.shard_documents(docs, shards=8).collect()], 8)
    assert [t for t, v in groups.items() if len(set(v)) > 1] == ["hot"]


@pytest.mark.parametrize("seed", range(3))
def test_one_pair_is_kept_together(spark, seed):
    rows = [(k, "pair" if k in (seed * 7, 60 - seed) else f"single {k}") for k in range(72)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = shards_of([(dict(rows)[r.id], r) for r in sharding.shard_documents(docs).collect()], 24)
    assert len(set(groups["pair"])) == 1 and len(groups["pair"]) == 2


def test_given_links_lower_the_cut(spark):
    """Chains of documents that are linked by others than equal texts move together."""
    draw = random.Random(4)
    rows = [(k, f"text {k}") for k in range(600)]
    links = [(k, k + 1) for k in range(300) if k % 5 != 4] + [(draw.randrange(300), draw.randrange(300)) for _ in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at = {r.id: r.shard for r in sharding.shard_documents(docs, shards=6, links=spark.createDataFrame(links, "a long, b long")).collect()}
    assert sum(at[a] != at[b] for a, b in links) / len(links) < 0.35


def test_license_query(spark, docs):
    rows = {r.doc_id: r for r in QUERIES["op9_licenses"](spark, SF).collect()}
    for d, text in docs.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        at, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            found = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        r = rows[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) or not labels


def test_license_rules():
    scan = licenses.Scanner().scan
    written = license_rules.rows(license_rules.SENTENCES) + license_rules.rows(license_rules.IDENTIFIERS)
    assert len({pattern for _, _, pattern in written}) == len(written) > 200
    assert scan("Distributed under GPL-3.0-or-later, GPLv2 or later")[5] == ["gpl-2.0-or-later", "gpl-3.0-or-later"]
    assert scan("the GNU Lesser General Public License version 2.1")[5] == ["lgpl-2.1"]
    assert scan("CC BY-SA 4.0")[4:6] == (["cc-by"], ["cc-by", "cc-by-sa-4.0"])
    assert scan("mit license mit license")[1:4] == (2, 0, 2)
    assert scan("a permissive text")[5:] == ([], 0.0)


def sample_of(pattern, draw):
    """A text that a pattern matches: gaps are filled, one alternative is taken, optional
    groups are left out."""
    while (m := re.search(r"\(\?:([^()]*)\)(\?|\{\d+,\d+\}\??)?", pattern)) or "|" in pattern:
        if not m:
            return sample_of(draw.choice(pattern.split("|")), draw)
        if m[1] == r"\S+ ":
            fill = "filler " * max(1, int(re.match(r"\{(\d+)", m[2])[1]))
        else:
            fill = "" if m[2] == "?" else draw.choice(m[1].split("|"))
        pattern = pattern[: m.start()] + fill + pattern[m.end() :]
    return re.sub(r"(\[\w+\])|(\w)\?", lambda x: x[1][1] if x[1] else x[2], pattern)


def test_each_written_rule_finds_its_text():
    draw = random.Random(6)
    scanner = licenses.Scanner()
    for label, keyword, pattern in license_rules.rows(license_rules.SENTENCES) + license_rules.rows(license_rules.IDENTIFIERS):
        for part in re.split(r"\|(?![^()]*\))", pattern):
            text = "so " + sample_of(part, draw) + " end"
            assert keyword in text, (keyword, part)
            found = scanner.detections(b" " + text.encode() + b" ")
            assert any(rule.pattern == pattern.encode() for _, _, rule in found) or any(a == 1 and b >= len(text.split()) - 1 for a, b, _ in found), (label, text, found)


def plain_detections(rules, text):
    """Every rule is tried, words are counted, each detection is compared with each."""
    joined = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))) + " "
    found = [(k, m.start(), m.end(), rule) for k, rule in enumerate(rules) for m in re.finditer("(?<= )(?:" + rule.pattern.decode() + ")(?= )", joined)]
    kept = [(a, b, rule) for k, a, b, rule in found if not any(j < k and x <= a and b <= y for j, x, y, _ in found)]
    return sorted((len(joined[:a].split()), len(joined[:b].split()), rule.label) for a, b, rule in kept)


def test_license_labels_by_brute_force(docs):
    draw = random.Random(8)
    rules = licenses.build_rules()
    scanner = licenses.Scanner()
    pieces = [sample_of(part, draw) for _, _, pattern in license_rules.rows(license_rules.SENTENCES) for part in [re.split(r"\|(?![^()]*\))", pattern)[0]]]
    pieces += ["gpl 2 0 or later", "gnu general public license version 3 or any later version", "cc by nc sa 4 0", "apache license 2 0", "mit license", "all rights reserved", "plain words here"]
    texts = [" ".join(draw.choices(pieces, k=12)) for _ in range(15)] + [t for t in docs.values() if t and len(t) < 1500]
    seen = 0
    for text in texts:
        words = licenses.words_of(text)
        got = sorted((a, b, rule.label) for a, b, rule in scanner.detections(b" " + b" ".join(words) + b" "))
        want = plain_detections(rules, text)
        assert got == want
        assert scanner.scan(text)[5] == sorted({label for _, _, label in want} | set(scanner.scan(text)[4]))
        seen += len(want)
    assert seen > 150


def test_license_scan_is_linear():
    """A few MB of one phrase take seconds, in however many detections."""
    import time

    text = "MIT license, " * 240_000
    start = time.time()
    n_words, n_base, first, last, *_ = licenses.Scanner().scan(text)
    assert (n_words, n_base, first, last) == (480_000, 240_000, 0, 479_998) and time.time() - start < 10


def test_sentences_are_gated_by_their_own_words():
    written = license_rules.rows(license_rules.SENTENCES) + license_rules.rows(license_rules.IDENTIFIERS)
    assert [(keyword, part) for _, keyword, pattern in written for part in re.split(r"\|(?![^()]*\))", pattern) if keyword not in part] == []
    text = "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"
    assert licenses.Scanner().scan(text)[5:] == (["gfdl"], 0.99)


def test_quotation_linking(spark):
    rows = [
        (1, 0, "a", "First point.\n\nSecond point here."),
        (1, 1, "b", "On Monday A wrote:\n> Second  POINT here.\n\nI agree."),
        (1, 2, "c", "> First point.\n\nI do not."),
        (1, 3, "a", "B wrote:\n> On Monday A wrote:\n>> Second point here.\n> I agree.\n\nThanks."),
        (1, 4, "d", "> never said\n\nhello"),
        (2, 0, "a", "> Second point here.\n\nother conversation"),
        (None, 5, "a", "> First point.\nlost"),
        (1, None, "a", None),
        (1, 1, "b", "On Monday A wrote:\n> Second  POINT here.\n\nI agree."),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("clash"))
    got = sorted(quotes.conversations(messages).collect(), key=lambda r: (r.conv is None, r.conv, r.position))
    first = [(r.position, r.turn, r.text, r.reply_to, r.depth) for r in got if r.conv == 1]
    assert first == [
        (0, 0, "First point.\n\nSecond point here.", None, 0),
        (1, 1, "I agree.", 0, 1),
        (2, 1, "I agree.", 0, 1),
        (3, 2, "I do not.", 0, 1),
        (4, 3, "Thanks.", 1, 2),
        (5, 4, "hello", None, 0),
        (6, None, "", None, 0),
    ]
    assert [(r.turn, r.text, r.reply_to) for r in got if r.conv != 1] == [(0, "other conversation", None), (5, "lost", None)]
    assert quotes.conversations(messages.where("false")).count() == 0


def generated_threads(seed):
    """Conversations whose messages quote earlier ones, whole or in part, rewrapped, nested;
    and for each message the turn it replies to."""
    draw = random.Random(seed)
    rows, replies = [], {}
    for conv in range(8):
        said: list[tuple[list[list[str]], int | None]] = []  # own paragraphs of sentences, replied turn
        for turn in range(12):
            own = [[f"Conversation {conv} turn {turn} says {p} {k} {draw.randrange(10**6)}" + draw.choice(".!?") for k in range(draw.randrange(1, 5))] for p in range(draw.randrange(1, 4))]
            lines, parent = [], None
            if turn and draw.random() < 0.8:
                parent = draw.randrange(turn)
                lines.append(f"On Monday user {parent} wrote:")
                above = said[parent][1]
                if above is not None and draw.random() < 0.5:  # what the parent quoted itself, at level two
                    lines += ["> On Sunday someone wrote:", *(f">{draw.choice(['', ' '])}> {x}" for x in draw.choice(said[above][0])), ">"]
                for paragraph in draw.sample(said[parent][0], draw.randrange(1, len(said[parent][0]) + 1)):
                    first = draw.randrange(len(paragraph))
                    part = " ".join(paragraph[first : draw.randrange(first, len(paragraph)) + 1]).split(" ")
                    at = 0
                    while at < len(part):
                        width = draw.randrange(2, 9)
                        lines.append("> " + draw.choice(["", " "]).join([""]) + "  ".join(part[at : at + width]).upper())
                        at += width
                    lines.append(">")
                lines.append("")
            body = "\n\n".join(" ".join(p) for p in own)
            rows.append((conv, turn, f"user {turn}", "\n".join([*lines, body])))
            replies[conv, turn] = (parent, body)
            said.append((own, parent))
    return rows, replies


@pytest.mark.parametrize("seed", [1, 2])
def test_quotes_in_generated_threads(spark, seed):
    rows, replies = generated_threads(seed)
    random.Random(seed).shuffle(rows)
    got = quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    assert {(r.conv, r.turn): (r.reply_to, r.text) for r in got} == replies
    for conv in range(8):
        depth = {}
        for turn in range(12):
            parent = replies[conv, turn][0]
            depth[turn] = (turn, 0) if parent is None else (depth[parent][0], depth[parent][1] + 1)
        order = sorted(range(12), key=lambda t: (*depth[t], t))
        mine = sorted((r for r in got if r.conv == conv), key=lambda r: r.position)
        assert [(r.position, r.turn, r.root_turn, r.depth) for r in mine] == [(k, t, *depth[t]) for k, t in enumerate(order)]


def test_quotes_of_long_and_deep_messages(spark):
    long = " ".join(f"Sentence {k} of a very long text goes on." for k in range(30_000))
    deep = "\n".join(">" * k + f" level {k} was never said" for k in range(1, 400))
    rows = [(1, 0, "a", long), (1, 1, "b", "> Sentence 29999 of a very LONG text goes on.\n\nyes"), (1, 2, "c", deep + "\n> yes"), (1, 3, None, None), (1, 3, None, None), (1, 4, "d", "")]
    got = sorted(quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.position)
    assert [(r.turn, r.reply_to, r.depth) for r in got] == [(0, None, 0), (1, 0, 1), (2, 1, 2), (3, None, 0), (3, None, 0), (4, None, 0)]
    assert got[0].text == long and got[2].n_quotes == 400


PAGE = "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><div class=top>Site name</div><nav><a>Menu</a></nav><div class='cookie-notice'>We use cookies</div><div>{lead}</div><div id=x><p>{a}</p><p>{b}<br>more &amp; more<p>Subscribe now to the letter</p></div><div class='comments'><p>reader says {a}</p></div><footer>foot {a}</footer></body></html>"


def test_wrapper_induction(spark):
    """Without an article element: constant nodes go, varying slots stay."""
    rows = [(k, "http://h.example/" + str(k), PAGE.format(lead="Always the same words", a=f"Paragraph {k} " * 10, b=f"Second {k * 7} " * 8)) for k in range(12)]
    rows += [(90, None, None), (91, "http://h.example/e", ""), (92, "bad url", "<article><h1>T</h1>x <b>y</b>z<p>unclosed <i>tag"), (93, "http://one.example/", "<div>" * 5000 + "deep" + "</div>" * 10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.id: r.text for r in extract.main_texts(pages).collect()}
    assert len(got) == len(rows)
    for k in range(12):
        assert got[k] == (f"Paragraph {k} " * 10).strip() + "\n\n" + f"Second {k * 7} " * 8 + "more & more"
    assert (got[90], got[91], got[92], got[93]) == ("", "", "T\n\nx yz\n\nunclosed tag", "deep")
    assert extract.main_texts(pages.where("false")).count() == 0


def test_copies_of_one_page_keep_their_text(spark):
    page = "<body><nav>m</nav><article><h1>T</h1><p>same text</p></article></body>"
    pages = spark.createDataFrame([(k, "http://c.example/", page) for k in range(20)], "page_id long, url string, html string")
    assert {r.text for r in extract.main_texts(pages).collect()} == {"T\n\nsame text"}


def article(head, paragraphs):
    return "<body><div><p>Part of the Example Network</p></div><article><h1>" + head + "</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article></body>"


@pytest.mark.parametrize("kind", ["exact", "near", "mostly near"])
def test_copies_among_other_pages_keep_their_text(spark, kind):
    """What only copies of one article share is not template, be they exact or not."""
    many, others = (95, 12) if kind == "mostly near" else (6, 4)
    rows, want = [], {}
    for k in range(many + others):
        if k < many:
            blocks = [f"Shared paragraph {j} that all copies have " * 4 for j in range(10)]
            if kind != "exact":
                blocks[k % 10] = f"Only copy {k} says this in its own paragraph " * 4
            head = "Copied"
        else:
            head, blocks = f"Other {k}", [f"Article {k} has its paragraph {j} to itself " * 4 for j in range(3)]
        rows.append((k, "http://copies.example/", article(head, blocks)))
        want[k] = "\n\n".join([head, *(b.strip() for b in blocks)])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.id: r.text for r in extract.main_texts(pages).collect()} == want


@pytest.mark.parametrize("least", [60, 150])
def test_template_around_long_articles(spark, least):
    """Template before and after many paragraphs is known, whatever menu stands first."""
    menu = "<nav><ul>" + "".join(f"<li>Entry {k}</li>" for k in range(500)) + "</ul></nav>"
    rows, want = [], {}
    for k in range(25):
        blocks = [f"Article {k} has paragraph {j} of its own" for j in range(least + k * 7 % 13)]
        rows.append((k, "http://long.example/", "<body>" + menu + "<article>" + "".join(f"<p>{b}</p>" for b in ["Always first", *blocks, "Always last"]) + "</article></body>"))
        want[k] = "\n\n".join(blocks)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.id: r.text for r in extract.main_texts(pages).collect()} == want


def story(host, k, n=4):
    """A page without article element; what is template is told from the host's pages alone."""
    lead = f"Written for {host} by its own staff"
    paragraphs = "".join(f"<p>Story {k} of {host} tells in part {j} what no other story tells</p>" for j in range(n))
    return f"<body><header><h2>Site {host}</h2></header><div><p>{lead}</p><p>Weather today {k}</p></div><div><h1>Title {k} of {host}</h1>{paragraphs}<p>{lead}</p></div><div><p>Read us every day</p></div></body>", [f"Title {k} of {host}", *(f"Story {k} of {host} tells in part {j} what no other story tells" for j in range(n))]


HOSTS = {"two": 2, "four": 4, "many": 30}


def stories():
    return [(f"{host}.example", k, *story(host, k, 60 if k % 7 == 3 else 4)) for host, n in HOSTS.items() for k in range(n)]


@pytest.mark.parametrize("shared_bytes", [1 << 20, 0])
def test_wrapper_decides(spark, shared_bytes):
    """Hosts of two pages and more, none with an article element, some with many blocks."""
    rows = stories()
    pages = spark.createDataFrame([(n, f"http://{host}/{k}", page) for n, (host, k, page, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.id: r.text for r in extract.main_texts(pages, shared_bytes=shared_bytes).collect()}
    for n, (*_, page, want) in enumerate(rows):
        assert got[n] == "\n\n".join(want)
        assert extract.main_text(page, None) != got[n]  # taking the wrapper away changes it


def test_main_text_does_not_depend_on_order(spark):
    rows = [(n, f"http://{host}/{k}", page) for n, (host, k, page, _) in enumerate(stories())]
    rows += [(100 + k, "http://h.example/" + str(k), PAGE.format(lead="Always the same words", a=f"Paragraph {k} " * 10, b=f"Second {k * 7} " * 8)) for k in range(12)]
    results = set()
    for seed, parts in ((1, 1), (2, 3), (3, 8)):
        random.Random(seed).shuffle(rows)
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        results.add(tuple(sorted((r.id, r.text) for r in extract.main_texts(pages).collect())))
    assert len(results) == 1


def test_page_header_without_article():
    assert extract.main_text("<body><header><p>Site header</p></header><p>One.</p><p>Two.</p></body>") == "One.\n\nTwo."
    assert extract.main_text("<body><article><header><h1>T</h1></header><p>One.</p></article></body>") == "T\n\nOne."


def test_main_text_query(spark):
    import html

    rows = {r.page_id: r for r in QUERIES["op8_main_text"](spark, SF).collect()}
    for page in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", page.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", inside)]
        assert rows[page.page_id].text == "\n\n".join(b for b in blocks if b)
