"""Registered queries over the whole documents of sf0.01, held against plain re-computation where SQL has none."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from lodegraph.llm import queries, sharding, token_count

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    table = pq.read_table(f"{SF}/documents.parquet")
    return dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))


def test_token_counts_equal_the_tokenizer_on_raw_texts(spark, texts):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_count.unigram_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    pieces = [("<unk>", 0.0), *vocabulary, *((f"<0x{i:02X}>", -1.0) for i in range(256))]
    tokenizer = Tokenizer(models.Unigram(pieces, 0, True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    got = {r.doc_id: r.n_tokens for r in queries.op1_token_counts(spark, SF).collect()}
    assert got == {i: len(tokenizer.encode(t or "").ids) for i, t in texts.items()}


def test_packed_pieces_hold_every_id_once(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = queries.op2_packing(spark, SF).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == texts.keys()
    for doc, parts in pieces.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padding += 4096 - at if at & (at - 1) else 0
    assert padding == 0


def test_held_out_languages_are_found(spark, texts):
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"])
    lang = dict(zip(table["doc_id"].to_pylist(), table["lang"].to_pylist(), strict=True))
    rows = queries.op4_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and lang[r.doc_id] is not None and any(c.isalpha() for c in texts[r.doc_id] or "")]
    assert judged and sum(r.lang_pred == lang[r.doc_id] for r in judged) >= 0.99 * len(judged)
    assert all(r.lang_pred == "und" for r in rows if not any(c.isalpha() for c in texts[r.doc_id] or ""))


def test_sharding_of_odd_tables_equals_its_sql(spark, tmp_path):
    import duckdb

    copies = [(i, "x" * 5000) for i in range(300)] + [(i, "é" * 900) for i in range(300, 500)]
    rest = [(i, f"text {i} " * (i % 37)) for i in range(500, 900)] + [(None, None), (None, "no id"), (None, None), (7, None), (8, ""), (8, ""), (8, "other")]
    for name, rows in {"hot": copies + rest, "few": rest[:5], "one": [(1, None)], "none": []}.items():
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = sharding.shard(docs, 40).collect()
        folder = str(tmp_path / name)
        docs.coalesce(1).write.parquet(folder)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
        want = con.execute(f"SELECT doc_id, size, text_crc32, shard, slot FROM ({sharding.SQL})").fetchall()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)), name
