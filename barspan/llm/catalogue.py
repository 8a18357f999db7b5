"""The corpus operators' registered queries, and the SQL each is held against where SQL can express it."""

from __future__ import annotations

from barspan.llm import bit_search, embed_dups, license_scan, mixing, near_dups, packing, quality, secret_scan, token_files, warc

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality,
        license_scan.op2_license_scan,
        embed_dups.op3_vector_dups,
        token_files.op4_token_files,
        mixing.op5_mix_sources,
        secret_scan.op6_secret_scan,
        bit_search.op7_bit_search,
        near_dups.op8_near_duplicates,
        packing.op9_pack_sequences,
        warc.op10_warc,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": license_scan.oracle_sql(),
    "op3_vector_dups": embed_dups.OP3_SQL,
    "op5_mix_sources": mixing.OP5_SQL,
    "op7_bit_search": bit_search.OP7_SQL,
    "op8_near_duplicates": near_dups.OP8_SQL,
    "op10_warc": warc.OP10_SQL,
}
