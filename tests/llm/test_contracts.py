"""Every registered query runs on the smallest tables and returns the columns and types it promises."""

import pytest

from inkwell.llm import registry

SF = "/root/testdata/sf0.001"
DOCUMENTS = {
    "op1": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op3": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op4": "doc_id bigint, kept boolean",
    "op5": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op6": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op7": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op8": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op9": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
}


@pytest.mark.parametrize("name", sorted(n for n in registry.queries() if n != "pipeline"))
def test_columns_and_rows(spark, name):
    got = registry.queries()[name](spark, SF)
    types = dict(got.dtypes)
    want = dict(c.split() for c in DOCUMENTS[name.split("_")[0]].split(", "))
    assert {c: types.get(c) for c in want} == want
    rows = got.collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if name.startswith("op7"):
        assert len(rows) == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1
    else:
        assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
        if name.split("_")[0] not in ("op3", "op4"):  # these have rows for pieces and lines
            assert len(rows) == docs.count()
