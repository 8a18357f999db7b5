"""Operators on documents against plain Python."""

import base64
import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from barspan.llm import common, license_scan, mixing, near_dups, packing, quality, secret_scan, shingles, tok, token_files
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def encoded(text):
    return [*tok.encoder(tok.vocabulary()).alone(text or "").tolist(), tok.END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# Tokens.


def test_encoder_equals_library(rows):
    texts = [t for _, t, _ in rows] + ["<|STARTOFTEXT|> É é É ́ a\ń", "a. b, c| d! e", "'s 'S it's", "ﬁ ǅ ŉ. ß, ÿ; ×, a÷ b"]
    counts, ids = tok.with_end(*tok.encoder(tok.vocabulary())(pa.array(texts)))
    for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert got.tolist() == encoded(text), text


def test_encoder_forgets_and_is_right(monkeypatch, rows):
    monkeypatch.setattr(tok, "CACHED_WORDS", 5)
    encode = tok.WordEncoder(tok.vocabulary())
    texts = [t for _, t, _ in rows[:30]]
    for t in texts * 2:
        assert encode(pa.array([t]))[1].tolist() == encoded(t)[:-1]


def test_encoder_keeps_words_in_arrays_and_learns_plain_ones_from_the_bare_model(monkeypatch):
    """What made op4_token_files pass its budget: plain words need neither the normaliser nor a Python object each."""
    import random

    rng = random.Random(2)
    monkeypatch.setattr(tok, "CACHED_WORDS", 2000)
    plain = ["".join(rng.choice("abcdefghijknoprstuvzßäéñøÿ") for _ in range(rng.randint(1, 12))) for _ in range(6000)]
    odd = ["İi", "ﬁ", "e\u0301", "ª", "x2", "don't", "日本", "ǅ", "\x0b", "\u200b", "ſ", "µ", "", "a\u00a0b", "ß.", "٣", "x" * 5000]
    library = tok.encoder(tok.vocabulary()).library
    encode = tok.WordEncoder(tok.vocabulary())
    encode.library = None
    texts = [" ".join(plain[k : k + 1500]) for k in range(0, 6000, 1500)] * 2
    for t in texts:
        counts, ids = encode(pa.array([t, None, ""]))
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids and counts.tolist() == [len(ids), 0, 0]
    assert isinstance(encode.now.words, pa.Array) and len(encode.old) > 1
    encode.library = library
    for _ in range(20):
        some = [" ".join(rng.choice(odd if rng.random() < 0.3 else plain) for _ in range(rng.randint(0, 400))) for _ in range(5)]
        counts, ids = encode(pa.array(some))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in some]
    assert encode(pa.array([], pa.string()))[1].tolist() == []


@pytest.mark.parametrize("more", [-1, 0, 1, token_files.CHUNK + 777])
def test_wavelet_shard_of_many_chunks(more):
    n = 2 * token_files.CHUNK + more
    ids = (np.random.default_rng(3).zipf(1.2, n) % 900).astype("<u4")
    shard = token_files.WaveletShard(token_files.build(ids, [1], np.array([n])))
    assert (shard.ids() == ids).all()
    for i in (0, token_files.CHUNK - 1, token_files.CHUNK, n - 1):
        assert shard.access(i) == ids[i] and shard.rank(int(ids[i]), i) == (ids[:i] == ids[i]).sum()
    assert shard.locate(int(ids[n - 1])) == np.flatnonzero(ids == ids[n - 1]).tolist()


@pytest.mark.parametrize("n,v", [(0, 5), (1, 1), (5000, 300), (3000, 70000), (513, 2), (512, 3)])
def test_wavelet_shard(n, v):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % v).astype("<u4") if n else np.zeros(0, "<u4")
    shard = token_files.WaveletShard(token_files.build(ids, [1, None, -3], np.array([n, 0, 0])))
    assert shard.ids().tolist() == ids.tolist()
    assert shard.documents()[0] == [1, None, -3]
    for i in rng.integers(0, max(n, 1), min(n, 30)).tolist():
        assert shard.access(i) == ids[i]
        assert shard.rank(int(ids[i]), i) == (ids[:i] == ids[i]).sum()
    for token in set(ids[:10].tolist()):
        assert shard.locate(token) == np.flatnonzero(ids == token).tolist()
        assert shard.count(token) == (ids == token).sum()
    assert shard.count(999_999) == 0 and shard.rank(-1, n) == 0
    with pytest.raises(IndexError):
        shard.access(n)
    with pytest.raises(IndexError):
        shard.select(999_999, 0)


def test_token_files(docs, rows):
    files = token_files.write_shards(docs, shard_ids=5000)
    assert files.count() > 3
    found = token_files.read_shards(files).collect()
    want = Counter((d, crc(encoded(t))) for d, t, _ in rows)
    assert Counter((r.doc_id, zlib.crc32(r.ids)) for r in found) == want
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d))


@pytest.mark.parametrize("text", ["'same text'", "cast(id as string)"])
def test_rows_without_an_id_spread(spark, text):
    """Neither null ids nor equal rows meet in one task."""
    rows = spark.range(100_000).selectExpr("cast(null as long) as doc_id", f"{text} as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = [r["count"] for r in token_files.in_order(rows).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(counts) == 4 and max(counts) < 40_000


def test_token_files_of_nothing(none):
    assert token_files.read_shards(token_files.write_shards(none)).count() == 0


def test_packing(docs, rows):
    pieces = packing.pack(docs, length=256).collect()
    whole = Counter()
    taken = defaultdict(int)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32
        taken[p.doc_id] += p.length
    for d, t, _ in rows:
        whole[d] += len(encoded(t))
    assert taken == whole
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    short = 0
    for number, inside in by_sequence.items():
        at = 0
        for p in sorted(inside, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
        short += at < 256
    assert short <= 1 and sorted(by_sequence) == list(range(len(by_sequence)))
    for d, t, _ in rows[:40]:
        own = sorted({(p.start, p.ids) for p in pieces if p.doc_id == d})
        if len([r for r in rows if r[0] == d]) == 1:
            assert b"".join(i for _, i in own) == np.array(encoded(t), "<u4").tobytes()


def test_packed_sequences_join_up(docs):
    pieces = packing.pack(docs, length=256)
    made = {r.sequence_id: r.ids for r in packing.sequences(pieces).collect()}
    assert sum(map(len, made.values())) == 4 * sum(p.length for p in pieces.collect())


def test_packing_in_ranges(docs, rows):
    """Cut into many ranges, with a third of the rows in one cell of the curve, the stream is still without gaps."""
    for part_tokens in (500, 20_000):
        pieces = packing.pack(docs.unionByName(docs).unionByName(docs), length=256, part_tokens=part_tokens).collect()
        at = 0
        for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
            assert p.sequence_id * 256 + p.offset == at
            at += p.length
        assert at == 3 * sum(len(encoded(t)) for _, t, _ in rows)


def test_neighbours_on_the_curve_are_alike():
    """Documents of one subject stand together more often than chance has it."""
    rng = np.random.default_rng(2)
    subject = rng.integers(0, 10, 600)
    texts = [rng.choice(np.arange(k * 500, k * 500 + 200), 150).astype(np.uint32) for k in subject]
    order = np.argsort(packing.curve_keys(np.concatenate(([0], np.cumsum([len(t) for t in texts]))), np.concatenate(texts)), kind="stable")
    assert (subject[order][1:] == subject[order][:-1]).mean() > 0.2  # 0.1 by chance; texts of 150 words from 200 say no more of their subject


def test_packing_nothing(none):
    assert packing.pack(none).count() == 0


def test_hilbert_curve_is_a_walk():
    for dimensions, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
        keys = packing.hilbert(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert set(np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1)) == {1}


# Near duplicates.


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def components_of(sets):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = [(d, s) for d, s in sets.items() if s]
    for n, (d, s) in enumerate(items):
        for e, t in items[:n]:
            both = len(s & t)
            if 100 * both >= 75 * (len(s) + len(t) - both):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d in sets}


def test_word_hashes_tell_words_apart():
    texts = ["a b", "ab", "a  b", None, "", "b", "x" * 70_000, "x" * 70_001, "x" * 65_536 + "y" + "x" * 65_535, "x" * 131_072]
    first, hashes = shingles.word_hashes(pa.array(texts))
    assert np.diff(first).tolist() == [2, 1, 2, 0, 0, 1, 1, 1, 1, 1]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[4] == hashes[5] and len(set(hashes.tolist())) == 7


def test_near_duplicates(spark, plain):
    from tests.llm.conftest import frame

    docs = frame(spark, [(d, t, None) for d, t in plain.items()] + [(None, "no id", None), (3, plain[3], None)])
    sets = {d: shingle_set(t) for d, t in plain.items()}
    want = components_of(sets)
    found = {r.doc_id: r for r in near_dups.near_duplicates(docs).collect()}
    assert len(found) == len(plain)
    for d in plain:
        assert found[d].n_shingles == len(sets[d])
        assert found[d].component_id == want[d], d
        assert found[d].kept == (want[d] == d)


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    """Small blocks: groups are compared over many of them, in all three steps."""
    import random

    from tests.llm.conftest import frame, word

    monkeypatch.setattr(near_dups, "BLOCK", 3)
    monkeypatch.setattr(near_dups, "CROSS", (2, 3))
    rng = random.Random(5)
    base = [word(rng) + str(k) for k in range(60)]
    texts = {}
    for d in range(90):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(60)] = word(rng) + "x"
        texts[d] = " ".join(copy)
    want = components_of({d: shingle_set(t) for d, t in texts.items()})
    found = {r.doc_id: r.component_id for r in near_dups.near_duplicates(frame(spark, [(d, t, None) for d, t in texts.items()])).collect()}
    assert found == want and 1 < len(set(want.values())) < 90


def test_near_duplicates_in_small_blocks(spark, monkeypatch, plain):
    """Blocks cut by their shingles find what whole ones do; a row that comes again and again changes nothing."""
    rows = [(d, t, "s") for d, t in plain.items()]
    want = {r.doc_id: r.component_id for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    monkeypatch.setattr(near_dups, "SHINGLES", 100)
    monkeypatch.setattr(near_dups, "CROSS", (3, 5))
    more = spark.createDataFrame(rows + [rows[5], rows[6]] * 300, "doc_id long, text string, source string")
    assert {r.doc_id: r.component_id for r in near_dups.near_duplicates(more).collect()} == want


def test_near_duplicates_take_few_stages(spark, monkeypatch):
    """On many partitions most of the time of small tables is that of starting tasks, so stages count; results are those of many rounds."""
    import random

    from tests.llm.conftest import frame, word

    monkeypatch.setattr(near_dups, "BLOCK", 3)
    rng = random.Random(6)
    texts = {}
    for d in range(120):
        copy = [word(random.Random(d % 4 * 100 + k)) + str(k) for k in range(60)]
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(60)] = word(rng) + "x"
        texts[d] = " ".join(copy)
    # A doc_id that comes with two sets links them, and what they are copies of.
    docs = frame(spark, [(d, t, None) for d, t in texts.items()] + [(7, texts[0] + " more", None)])
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    sc.setJobGroup("few", "")
    try:
        found = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in tracker.getJobIdsForGroup("few") for s in tracker.getJobInfo(j).stageIds}
    ran = [s for s in stages if (i := tracker.getStageInfo(s)) and i.numCompletedTasks]
    assert 20 < len(ran) <= 80
    monkeypatch.setattr(near_dups, "LINKS", 0)
    assert {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs).collect()} == found
    sets = {d: shingle_set(t) for d, t in texts.items()} | {1000: shingle_set(texts[0] + " more")}
    want = components_of(sets)
    one = {want[7], want[1000]}  # the two sets of 7
    assert found == {d: min(one) if want[d] in one else want[d] for d in texts}


def test_near_duplicates_of_an_id_with_and_without_words(spark, monkeypatch):
    """One doc_id with a text and an empty row, in a bucket that is compared block by block."""
    import random

    from tests.llm.conftest import frame, word

    monkeypatch.setattr(near_dups, "CROSS", (2, 3))
    rng = random.Random(5)
    base = [word(rng) + str(k) for k in range(60)]
    texts = {}
    for d in range(90):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(60)] = word(rng) + "x"
        texts[d] = " ".join(copy)
    docs = frame(spark, [(d, t, None) for d, t in texts.items()] + [(d, "", None) for d in texts])
    found = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs).collect()}
    assert found == components_of({d: shingle_set(t) for d, t in texts.items()})


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    for share in (0.7, 0.8, 0.95):
        n = 2000
        same = int(2 * n * share / (1 + share))
        pool = shingles.mixed(rng.integers(0, 1 << 62, 3 * n).astype(np.uint64))
        sets = [np.unique(pool[:n]), np.unique(pool[n - same : 2 * n - same])]
        bounds = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
        bits = near_dups.sketch(near_dups.samples(bounds, np.concatenate(sets)))
        flips = int(np.bitwise_count((bits[0] ^ bits[1]).view(np.uint64)).sum())
        assert near_dups.least_flips(share + 0.13) < flips < near_dups.least_flips(share - 0.13)


def test_near_duplicates_of_nothing(none, spark):
    from tests.llm.conftest import frame

    assert near_dups.near_duplicates(none).count() == 0
    blank = near_dups.near_duplicates(frame(spark, [(2, "", None), (1, None, None), (3, " ", None)])).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in blank} == {(d, 0, d, True) for d in (1, 2, 3)}


def test_components(spark):
    import random

    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    found = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_components_in_one_task(spark):
    """Up to the bound in one task, beyond it in rounds: the same components."""
    import random

    rng = random.Random(3)
    path = [*range(1000, 1400)]
    rng.shuffle(path)
    edges = [*zip(path, path[1:])] + [(rng.randrange(500), rng.randrange(500)) for _ in range(250)] + [(2500, k) for k in range(2000, 2400)] + [(-5, 3000), (8, 8)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    want = sorted(common.components(df).collect())
    assert sorted(common.components(df, at_once=len(edges)).collect()) == sorted(common.components(df, at_once=1).collect()) == want
    assert common.components(df.where("a = b"), at_once=5).count() == 0


# Licenses.


def test_license_scan(docs, rows):
    texts = [*license_scan.TEMPLATES]
    found = defaultdict(list)
    for r in license_scan.scan(docs).collect():
        found[r.doc_id].append((r.n_words, sorted((p.word, p.label) for p in r.places), sorted((m.at, m.label, round(m.share, 9)) for m in r.matches)))
    want = defaultdict(list)
    for d, t, _ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        places = [(k, label) for p, label in license_scan.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        matches = []
        for at in range(0, max(len(words) - 1 - license_scan.STRIDE, 0) + 1, license_scan.STRIDE):
            block = set(words[at : at + license_scan.WINDOW])
            for text, label in texts:
                own = set(text.split())
                if words and len(own & block) >= math.ceil(license_scan.CONTAINMENT * len(own) - 1e-9):
                    matches.append((at, label, round(len(own & block) / len(own), 9)))
        want[d].append((len(words), sorted(places), sorted(matches)))
    assert {d: sorted(v) for d, v in found.items()} == {d: sorted(v) for d, v in want.items()}
    assert any(m for v in found.values() for _, _, m in v) and any(p for v in found.values() for _, p, _ in v)


def test_license_scan_counts_the_contracts_phrases(spark, tmp_path):
    """The phrases are written out here: a shorter one counts other places."""
    from tests.llm.conftest import frame

    texts = ["mit license", "Under the\nMIT_License, under the MIT-license", "the mit license", "under the mit licenses", "Apache License, Version 2.0 CC-BY/NC", "cc by ncc", "", None]
    frame(spark, [(k, t, None) for k, t in enumerate(texts)]).write.parquet(str(tmp_path / "documents.parquet"))
    found = license_scan.op2_license_scan(spark, str(tmp_path)).orderBy("doc_id")
    got = [tuple(r) for r in found.select("n_words", "n_base", "first_word", "last_word", "base_labels").collect()]
    none = (0, None, None, "")
    assert got == [(2, *none), (8, 2, 0, 4, "mit"), (3, *none), (4, *none), (8, 2, 0, 5, "apache-2,cc-by-nc"), (3, *none), (0, *none), (0, *none)]


def test_license_containment_join_on_many_blocks(spark):
    """Random blocks of template words: the filters lose none that an exact count finds."""
    import random

    from tests.llm.conftest import frame

    rng = random.Random(4)
    words = sorted({w for t, _ in license_scan.TEMPLATES for w in t.split()})
    rows = []
    for d in range(150):
        own = list(set(rng.choice(license_scan.TEMPLATES)[0].split()))
        rng.shuffle(own)
        rows.append((d, " ".join(own[: rng.randint(len(own) - 4, len(own))] + rng.sample(words, rng.randint(0, 10)) + ["filler"] * rng.randint(0, 40)), None))
    found = {r.doc_id: sorted((m.at, m.template) for m in r.matches) for r in license_scan.scan(frame(spark, rows)).collect()}
    for d, t, _ in rows:
        w = t.split()
        want = []
        for at in range(0, max(len(w) - 1 - 32, 0) + 1, 32):
            for n, (text, _) in enumerate(license_scan.TEMPLATES):
                own = set(text.split())
                if len(own & set(w[at : at + 64])) >= math.ceil(0.85 * len(own) - 1e-9):
                    want.append((at, n))
        assert found[d] == want


def test_license_scan_of_many_templates(spark):
    import random

    from tests.llm.conftest import frame

    rng = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    templates = tuple((" ".join(rng.sample(words, rng.randint(6, 30))), f"label{n}") for n in range(200))
    rows = []
    for d in range(60):
        own = rng.choice(templates)[0].split()
        rows.append((d, " ".join(own[rng.randint(0, 3) :] + rng.sample(words, 10) + ["filler"] * rng.randint(0, 40)), None))
    found = {r.doc_id: sorted((m.at, m.template) for m in r.matches) for r in license_scan.scan(frame(spark, rows), templates=templates).collect()}
    for d, t, _ in rows:
        w = t.split()
        blocks = [(at, set(w[at : at + 64])) for at in range(0, max(len(w) - 1 - 32, 0) + 1, 32)]
        want = [(at, n) for at, block in blocks for n, (text, _) in enumerate(templates) if len(block & set(text.split())) >= math.ceil(0.85 * len(set(text.split())) - 1e-9)]
        assert found[d] == want
    assert any(found.values())


def test_license_scan_is_native(docs):
    plan = license_scan.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_license_scan_of_nothing(none):
    assert license_scan.scan(none).count() == 0


# Secrets.


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


KEY = der(0x30, der(2, b"\0") + b"".join(der(2, b"\1" * 40) for _ in range(8)))


def test_key_structures():
    assert secret_scan.is_der_key(KEY)
    assert not secret_scan.is_der_key(KEY + b"\0") and not secret_scan.is_der_key(KEY[:-1]) and not secret_scan.is_der_key(b"")
    assert not secret_scan.is_der_key(der(0x30, der(2, b"\0") + b"".join(der(2, b"\1" * 40) for _ in range(7))))
    pkcs8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86")) + der(4, KEY))
    sec1 = der(0x30, der(2, b"\1") + der(4, b"k" * 32) + der(0xA0, der(6, b"\x2a")))
    assert secret_scan.is_der_key(pkcs8) and secret_scan.is_der_key(sec1)

    def part(b):
        return len(b).to_bytes(4, "big") + b

    ssh = b"openssh-key-v1\0" + part(b"none") * 2 + part(b"") + (1).to_bytes(4, "big") + part(b"pub") + part(b"private")
    assert secret_scan.is_openssh_key(ssh) and not secret_scan.is_openssh_key(ssh + b"x") and not secret_scan.is_openssh_key(ssh[:-1])


def test_secret_spans():
    import base64
    import json

    def b(o):
        return base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")

    token = b({"alg": "HS256"}) + "." + b({"sub": "1"}) + ".abc"
    b64 = base64.b64encode(KEY).decode()
    armoured = f"-----BEGIN RSA PRIVATE KEY-----\n{base64.encodebytes(KEY).decode()}-----END RSA PRIVATE KEY-----"
    text = f"é {token} {b64} {KEY.hex()} {armoured} x{b64} {b64[:-8]} {b({'alg': 1})}.{b({})}.x"
    kinds = [(k, text[s:e]) for k, s, e in secret_scan.spans(text)]
    assert ("jwt", token) in kinds and ("base64_key", b64) in kinds and ("hex_key", KEY.hex()) in kinds and ("pem", armoured) in kinds
    assert len([k for k, _ in kinds if k not in ("hex", "assign")]) == 4
    assert token not in secret_scan.redacted(text, "#") and armoured not in secret_scan.redacted(text, "#")


def test_secret_scan(docs, rows):
    found = defaultdict(list)
    for r in secret_scan.find_secrets(docs).collect():
        found[r.doc_id].append([tuple(s) for s in r.spans if s.kind in secret_scan.BASE])
    patterns = (
        ("assign", r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
        ("access", r"(AKIA[A-Z0-9]+)", 20),
        ("hex", r"([0-9a-f]+)", 24),
    )
    for d, t, _ in rows:
        want = [(kind, m.start(), m.end()) for kind, p, least in patterns for m in re.finditer(p, t or "") if len(m[1]) >= least]
        assert sorted(want, key=lambda s: (s[1], secret_scan.KINDS.index(s[0]))) in found[d]
    assert sum(len(v) for vs in found.values() for v in vs) >= 5


def test_redact_keeps_everything_else(docs, rows):
    clean = secret_scan.redact(docs)
    assert clean.schema == docs.schema
    held = clean.collect()
    assert len(held) == len(rows)
    for r in held:
        if r.text is not None:
            assert r.n_chars == len(r.text) and not secret_scan.spans(r.text.replace("[SECRET]", " "))
    assert any("[SECRET]" in (r.text or "") for r in held)


def test_secret_digest(spark):
    r = secret_scan.op6_secret_scan(spark, "/root/testdata/sf0.01").where("n_hex > 0").first()
    kept = [s for s in r.spans.split(",") if s.split(":")[0] in secret_scan.BASE]
    assert r.base_sha256 == hashlib.sha256(",".join(kept).encode()).hexdigest()


def test_secret_scan_is_linear():
    """A million characters that begin a token again and again, and other unlucky texts."""
    import time

    for unlucky in ("ey" * 500_000, "ey." * 333_000, "eyA.eyA." * 125_000, "M" * 1_000_000, "30" * 500_000, "-----BEGIN PRIVATE KEY-----\n" * 37_000, "password  " * 100_000):
        began = time.process_time()
        secret_scan.spans(unlucky)
        assert time.process_time() - began < 5, unlucky[:20]


def test_tokens_in_a_run():
    part = lambda **x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    head, claims = part(alg="HS256"), part(sub="me")
    text = f"a {head}.{claims}.sig x.{head}.{claims} +{head}.{claims}.s {claims}.{head} {head}.{claims}.s.{head}.{claims}"
    found = [text[a:b] for k, a, b in secret_scan.spans(text) if k == "jwt"]
    assert found == [f"{head}.{claims}.sig", f"{head}.{claims}", f"{head}.{claims}.s", f"{head}.{claims}"]


def test_secrets_of_nothing(none):
    assert secret_scan.find_secrets(none).count() == 0 and secret_scan.redact(none).count() == 0


# Mixing.


def water(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, done, rest = 1.5 * sum(sizes.values()), {}, set(names)
    while rest:
        level = (total - sum(done.values())) / sum(weight[s] for s in rest)
        over = {s for s in rest if level * weight[s] > 2 * sizes[s]}
        if not over:
            return done | {s: level * weight[s] for s in rest}
        done |= {s: 2.0 * sizes[s] for s in over}
        rest -= over
    return done


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, None: 30, "c": 0}, {"x": 5}, {f"s{k}": (k * 37) % 101 for k in range(23)}):
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r.source: r.target for r in mixing.targets(rows).collect()}
        assert found == pytest.approx(water(sizes))


def test_mix(docs, rows):
    found = mixing.mix(docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(d for d, *_ in rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = water(size), Counter()
    for r in found:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= max((r.size for r in found if r.source == s), default=0)
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_emit(docs):
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id, r.source] += r.copies
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.source) for r in out.collect()) == +copies


def test_many_equal_rows_are_mixed(spark):
    rows = spark.range(100_000).selectExpr("7L as doc_id", "'one two three' as text", "'a' as source", "id")
    out = mixing.emit(rows)
    counts = Counter(r["count"] for r in out.groupBy("id").count().collect())
    assert set(counts) <= {1, 2} and sum(k * n for k, n in counts.items()) in (150_000, 150_001)


def test_mixing_nothing(none):
    assert mixing.mix(none).count() == 0 and mixing.emit(none).count() == 0


# Quality.


def test_quality_on_held_out_rows(spark):
    found = quality.op1_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in found)
    assert len(found) > 50 and right >= 0.95 * len(found)
    good = [r.score for r in found if r.quality == 1]
    bad = [r.score for r in found if r.quality == 0]
    assert sum(g > b for g in good for b in bad) >= 0.97 * len(good) * len(bad)
    assert all(r.held_out == quality.in_test(r.doc_id) for r in found)


def test_quality_reads_no_other_column(spark, docs):
    labels = spark.createDataFrame([(d, d % 2) for d in range(60)] + [(None, 1), (5, None), (9999, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    a = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    b = {r.doc_id: r.score for r in quality.scored(docs.withColumn("source", F.lit("z")).withColumn("lang", F.lit("q")), model).collect()}
    assert a == b and all(0 <= s <= 1 for s in a.values())
    assert quality.scored(docs, model).columns.count("score") == 1


def test_quality_without_labels(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r.score, 6) for r in quality.scored(docs, quality.train(docs, labels)).collect()} == {0.5}
    ones = spark.createDataFrame([(d, 1) for d in range(40)], "doc_id long, quality int")
    assert all(r.score > 0.99 for r in quality.scored(docs, quality.train(docs, ones)).collect())
    assert quality.scored(none, quality.train(none, ones)).count() == 0


def test_quality_bounds(spark, docs):
    labels = spark.createDataFrame([(d, d % 2) for d in range(100)], "doc_id long, quality int")
    few = quality.train(docs, labels, max_rows=10)
    assert few.weights.shape == (quality.BUCKETS,)
    assert quality.train(docs, labels, max_entries=500).weights.shape == (quality.BUCKETS,)


def test_ngram_sets():
    bounds, found = quality.features(pa.array(["a b a b", "a b", None, "", "z"]))
    sets = [set(found[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert all(len(s) == b - a for s, a, b in zip(sets, bounds[:-1], bounds[1:], strict=True))
    assert not sets[2] and not sets[3] and sets[1] < sets[0]
