"""Stages on a corpus with every awkward row, and the whole chain on the smallest tables."""

import corpus_pipeline
from barspan.llm import near_dups, quality, secret_scan


def test_stages_are_the_ones_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "packing"]


def test_stages_keep_columns(spark, docs, none, sf):
    for table in (docs, none):
        now = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf)
            assert now.columns == table.columns
        last = corpus_pipeline.STAGES[-1][1](spark, now, sf)
        assert last.count() >= 0 and "sequence_id" in last.columns


def test_run_on_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = quality.scored(docs, model).where(f"score >= {quality.ACCEPT}").drop("score")
    kept = {r.doc_id for r in near_dups.near_duplicates(good).where("kept").collect()}
    pieces = corpus_pipeline.run(spark, sf).collect()
    found = {p.doc_id for p in pieces}
    assert found <= kept and len(found) > 0.5 * len(kept)
    ends = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    for (s, a, n), (t, b, _) in zip(ends, ends[1:], strict=False):
        assert (s == t and a + n == b) or (t == s + 1 and b == 0 and a + n == 4096)
    clean = corpus_pipeline.hide_secrets(spark, docs, sf).collect()
    assert not any(k in ("access", "jwt", "pem") for r in clean for k, *_ in secret_scan.spans(r.text or ""))


def test_narrower_ids(spark):
    """Ids of 32 bits are as good as wider ones."""
    from barspan.llm import bit_search, embed_dups, packing, token_files, warc

    docs = spark.createDataFrame([(1, "a b c", "s"), (2, "a b c", "s")], "doc_id int, text string, source string")
    assert {r.component_id for r in near_dups.near_duplicates(docs).collect()} == {1}
    assert token_files.read_shards(token_files.write_shards(docs)).count() == 2
    assert packing.pack(docs).count() == 2 and secret_scan.find_secrets(docs).count() == 2
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id int, embedding array<double>")
    assert {r.n_links for r in embed_dups.link_vectors(rows).collect()} == {1}
    assert bit_search.search(bit_search.index(rows), rows).count() == 2
    pages = spark.createDataFrame([(1, "u", "x" * 100), (2, "u", "x" * 100)], "page_id int, url string, html string")
    assert [r.refers_to for r in warc.read_archives(warc.write_archives(pages)).orderBy("page_id").collect()] == [None, 1]
