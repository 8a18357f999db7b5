"""Operators on vectors and pages against plain Python."""

import hashlib
import math

import numpy as np
import pytest
from barspan.llm import bit_search, common, embed_dups, warc
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int, rep long, n long, leaf long, score double, rank int"


def vectors(seed=1, n=400, d=16):
    rng = np.random.default_rng(seed)
    rows = [(k, rng.standard_normal(d).astype("f4").tolist()) for k in range(n)]
    at = n
    for base in range(0, 60):
        for _ in range(base % 7):
            rows.append((at, (np.array(rows[base][1]) * rng.uniform(0.5, 2) + rng.standard_normal(d) * rng.choice([0.02, 0.2, 0.35])).astype("f4").tolist()))
            at += 1
    rows += [(at + k, rows[3][1]) for k in range(5)]
    at += 5
    rows += [(at, None), (at + 1, [0.0] * d), (at + 2, [float("nan")] + [1.0] * (d - 1)), (at + 3, [float("inf")] + [1.0] * (d - 1)), (at + 4, [None] + [1.0] * (d - 1)), (at + 5, [])]
    rows += [(at + 6, [1.0, 0.0]), (at + 7, [1.0, 0.01]), (at + 8, [-0.0, 1.0]), (at + 9, [0.0, 1.0]), (at + 10, (np.array(rows[4][1]) * 1e-30).tolist()), (None, rows[4][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 7, 7, 7, 7.0, 7) for i, v in rows], VECTORS).repartition(3)


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain_links(rows):
    good = [(i, np.array(v, "f4").astype(float)) for i, v in rows if i is not None and usable(v)]
    links, root = {i: 0 for i, _ in rows if i is not None}, {i: i for i, _ in rows if i is not None}
    for k, (i, v) in enumerate(good):
        for j, w in good[:k]:
            if len(v) == len(w) and (v / np.linalg.norm(v)) @ (w / np.linalg.norm(w)) >= 0.95:
                links[i] += 1
                links[j] += 1
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
    for i in root:
        a = i
        while root[a] != a:
            a = root[a]
        root[i] = a
    return links, root


@pytest.mark.parametrize("leaf,block", [(64, 1024), (8, 1024), (64, 16)])
def test_links(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(embed_dups, "LEAF", leaf)
    monkeypatch.setattr(embed_dups, "BLOCK", block)
    rows = vectors()
    links, root = plain_links(rows)
    found = {r.vec_id: r for r in embed_dups.link_vectors(frame(spark, rows)).collect()}
    assert len(found) == len(links)
    assert {i: r.n_links for i, r in found.items()} == links
    assert {i: r.component_id for i, r in found.items()} == root
    assert all(r.kept == (r.component_id == i) for i, r in found.items())
    assert max(links.values()) > 5


def test_links_of_nothing(spark):
    assert embed_dups.link_vectors(frame(spark, [])).count() == 0
    only = embed_dups.link_vectors(frame(spark, [(1, None), (2, [0.0])])).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in only} == {(1, 0, 1, True), (2, 0, 2, True)}


def test_repeated_rows_of_a_vector(spark):
    found = embed_dups.link_vectors(frame(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in found} == {(1, 2, 1), (2, 2, 1)}


def test_forest_deals_every_vector():
    rng = np.random.default_rng(0)
    x = embed_dups.unit(rng.standard_normal((3000, 8)))
    forest = embed_dups.grow(x[:600], 3000, 100)
    assert len(forest.trees) > 2
    for tree in range(len(forest.trees)):
        rows, leaves = forest.leaves(x, tree)
        assert set(rows) == set(range(3000))
        assert np.bincount(leaves - leaves.min()).max() < 600
    assert forest.places(x[:5])[1].max() < forest.first[-1]


def planted(n, clusters, d=64, seed=5):
    """Unit vectors, half of them partners of the other half at a cosine of 0.951."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n // 2, d))
    if clusters:
        x = rng.standard_normal((clusters, d))[rng.integers(0, clusters, n // 2)] + 0.6 * x
    x = embed_dups.unit(x)
    off = rng.standard_normal(x.shape)
    off = embed_dups.unit(off - (off * x).sum(1, keepdims=True) * x)
    return x, 0.951 * x + math.sqrt(1 - 0.951**2) * off


@pytest.mark.parametrize("clusters", [0, 50])
@pytest.mark.parametrize("n,leaf,depth,places,largest", [(10_000, 18, 10, 32, 0.02), (10_000, 200, 6, 14, 0.2), (6_000, 1, 14, 110, 0.05)])
def test_forest_recall_and_places(monkeypatch, n, leaf, depth, places, largest, clusters):
    """Planted pairs at the threshold meet, at the depth of a table of 10 thousand to many millions; places and leaves stay few and small."""
    x, y = planted(n, clusters)
    both = np.concatenate((x, y))
    monkeypatch.setattr(embed_dups, "LEAST", 4)
    forest = embed_dups.grow(both, n, leaf)
    met, total, most = np.zeros(len(x), bool), 0, 0
    for tree in range(len(forest.trees)):
        leaves = [{}, {}]
        for side, v in enumerate((x, y)):
            rows, at = forest.leaves(v, tree)
            total += len(rows)
            most = max(most, np.bincount(at - forest.first[tree]).max())
            for r, a in zip(rows.tolist(), at.tolist(), strict=True):
                leaves[side].setdefault(r, set()).add(a)
        met |= np.array([bool(leaves[0][r] & leaves[1][r]) for r in range(len(x))])
    print(depth, clusters, len(forest.trees), met.mean(), total / n, most / n)
    assert met.mean() >= 0.99 and total / n <= places and most / n <= largest


def plain_search(rows, k, every):
    seen = {}
    for i, v in rows:
        if i is not None and usable(v):
            v = np.array(v, "f4").astype(float).tolist()
            seen[i] = min(v, seen.get(i, v))
    out = {}
    for q, v in seen.items():
        if q % every == 0:
            scores = sorted((-float(np.dot(v, w)), i) for i, w in seen.items() if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("query_bytes,tile", [(32 << 20, 64), (9000, 7)])
def test_search(spark, monkeypatch, query_bytes, tile):
    monkeypatch.setattr(bit_search, "QUERY_BYTES", query_bytes)
    monkeypatch.setattr(bit_search, "TILE", tile)
    rows = vectors(2)
    data = frame(spark, rows)
    found = {}
    for r in bit_search.search(bit_search.index(data), data.where("vec_id % 5 = 0"), 20).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = plain_search(rows, 20, 5)
    assert set(found) <= set(want) and all(q in found for q, w in want.items() if w)
    hit = 0
    for q, own in found.items():
        own.sort()
        assert [n for n, *_ in own] == list(range(1, len(want[q]) + 1))
        scores = dict(plain_search(rows, 10_000, 5)[q]) if q < 25 else None
        for _, i, s in own:
            assert scores is None or s == pytest.approx(scores[i], abs=1e-12)
        assert own == sorted(own, key=lambda o: (-o[2], o[1]))
        hit += len({i for _, i, _ in own} & {i for i, _ in want[q]})
    assert hit >= 0.98 * sum(map(len, want.values()))


def test_search_recall_on_the_tables(spark):
    path = "/root/testdata/sf0.1"
    found = bit_search.op7_bit_search(spark, path).toPandas()
    rows = spark.read.parquet(f"{path}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack(rows.embedding.to_numpy()).astype(float)
    hit = 0
    for q in found.query_id.unique():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(found[found.query_id == q].vec_id))
    assert hit >= 0.99 * len(found)


def test_estimates_keep_their_bounds():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 64)) * rng.uniform(0.1, 10, (4000, 1))
    words, length, scalar = bit_search.codes(x)
    assert words.shape == (4000, 1) and np.allclose(length, np.linalg.norm(x, axis=1))
    asked = rng.standard_normal((5, 64))
    got, error = bit_search.estimates(words, length, scalar, bit_search.prepared(np.arange(5), asked))
    assert got.shape == (5, 4000) and ((np.abs(got - asked @ x.T) <= error).mean(axis=1) > 0.95).all()


def test_search_ties_go_to_the_smaller_id(spark):
    """Copies of a vector, dealt over blocks of many sizes, score alike and stand in order of their ids."""
    rng = np.random.default_rng(8)
    rows = [(k, rng.standard_normal(96).tolist()) for k in range(900)]
    shared = rows[0][1]
    copies = rng.permutation(np.arange(1, 900))[:120]
    for k in copies:
        rows[k] = (int(k), shared)
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    found = bit_search.search(bit_search.index(data), data.where("vec_id % 20 = 0"), 20).collect()
    of = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        of.setdefault(r.query_id, []).append((r.vec_id, r.score))
    alike = sorted([0, *map(int, copies)])
    for q in (k for k in alike if k % 20 == 0):
        assert [i for i, _ in of[q]] == [k for k in alike if k != q][:20]
        assert len({s for _, s in of[q]}) == 1
    for own in of.values():
        assert own == sorted(own, key=lambda o: (-o[1], o[0]))


def test_search_of_nothing(spark):
    data = frame(spark, [])
    assert bit_search.search(bit_search.index(data), data).count() == 0
    alone = frame(spark, [(0, [1.0, 2.0])])
    assert bit_search.search(bit_search.index(alone), alone).count() == 0


# Pages.

PAGES = "page_id long, url string, html string, digest string, size long, row long, payload string, refers_to long"


def page_frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 1, "p", 1) for r in rows], PAGES).repartition(3)


def pages():
    long = "<html>" + "same body é " * 40 + "</html>"
    rows = [(k, f"http://h/{k}", f"<p>{'text ' * (k % 50)}{k}</p>") for k in range(200)]
    rows += [(1000 - k, "http://copy", long) for k in range(30)] + [(2000, None, None), (2001, "http://e/ü?a=b c\r\nX: 1", ""), (2002, "x", "short"), (2003, "x", "short"), (2004, "big", "z" * 3_000_000), (2005, "nul", "\0a\r\n\r\nb")]
    return rows


def plain_pages(rows):
    out, first = {}, {}
    for i, _, h in sorted(rows):
        raw = (h or "").encode()
        digest = hashlib.sha256(raw).hexdigest()
        known = first.setdefault(digest, i) if len(raw) >= 100 else i
        out[i] = (len(raw), digest, "response" if known == i else "revisit", None if known == i else known)
    return out


@pytest.mark.parametrize("size", [warc.ARCHIVE_BYTES, 2000])
def test_archives(spark, size):
    rows = pages()
    archives = warc.write_archives(page_frame(spark, rows), size)
    read = warc.read_archives(archives).collect()
    want = plain_pages(rows)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read} == want and len(read) == len(rows)
    text = {i: h or "" for i, _, h in rows}
    assert all(r.payload.decode() == text[r.page_id] for r in read if r.record_type == "response")
    assert all(r.payload is None for r in read if r.record_type == "revisit")
    urls = {i: u or "" for i, u, _ in rows}
    assert all(r.url == urls[r.page_id] for r in read)


def test_archive_format(spark):
    file = warc.write_archives(page_frame(spark, pages())).first().file
    assert file[:4] == (0x184D2A5D).to_bytes(4, "little")
    heads = [h for h, _ in warc.records(file)]
    assert len({h["warc-record-id"] for h in heads}) == len(heads)
    assert heads[0]["warc-type"] == "warcinfo" and all(h["warc-record-id"] for h in heads)
    with pytest.raises(ValueError):
        list(warc.records(b"\x28\xb5\x2f\xfd" + file[4:]))


def test_repeated_page_ids(spark):
    body = "b" * 200
    found = warc.read_archives(warc.write_archives(page_frame(spark, [(1, "u", body), (1, "u", body), (2, "u", body), (None, "u", body)]))).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to or 0) for r in found) == [("1", "response", 0), ("1", "response", 0), ("2", "revisit", 1), ("None", "revisit", 1)]


def test_archives_as_files(spark, tmp_path):
    archives = warc.write_archives(page_frame(spark, pages()), 2000)
    told = {r.path: r.bytes for r in common.export(archives, tmp_path.as_uri(), "archive", ".warc.zst").collect()}
    assert {str(p): p.stat().st_size for p in tmp_path.iterdir()} == told and len(told) > 3
    ids = [h["warc-record-id"] for p in tmp_path.iterdir() for h, _ in warc.records(p.read_bytes())]
    assert len(set(ids)) == len(ids) == sum(r.n_records + 1 for r in archives.collect())


def test_archives_of_nothing(spark):
    assert warc.read_archives(warc.write_archives(page_frame(spark, []))).count() == 0


def test_dictionary_pays(spark):
    """Records compressed alone with the dictionary take less than without."""
    import zstandard

    rows = [warc.page_record(f"<urn:{k}>", k, f"http://h/{k}", 300, "0" * 64, (f"<html><head><title>{k}</title></head><body>" + "<div class=item>shared layout</div>" * 8).encode(), None) for k in range(3000)]
    file = warc.archive(rows)
    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in rows)
    assert len(file) < 0.6 * alone
    assert [b for _, b in warc.records(file)][5].endswith(b"</div>")


def test_search_takes_part(spark):
    rows = spark.createDataFrame([(v,) for v in ([1.0], [0.0], None, [], [None], [float("nan")])], "embedding array<float>")
    assert [r[0] for r in rows.select(embed_dups.usable("embedding")).collect()] == [True, False, False, False, False, False]
    assert rows.select(F.lit(1)).count() == 6
