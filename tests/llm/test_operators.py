"""Whole operators on small tables: nulls, empties, repeats, ties, clashing columns, and brute force."""

import collections
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import ann, chat, common, langid, mixing, near_dup, packing, sharding, token_count, url_filter, vector_dup

BPE = public_tokenizers.path("word_bpe_49k.json")
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.upper(), "en", None), (4, BASE + " more", "en", "b"), (5, None, None, "b"), (6, "", "de", "b"), (7, " \n\t", "de", None), (8, "eins zwei", "de", "c"),
    (9, "eins zwei", "de", "c"), (10, "12 34 !!", "en", "c"), (10, "12 34 !!", "en", "c"), (None, "no id", "en", "a"), (11, "x" * 20000, "de", "a"), (12, "der die das " * 3000, "de", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with extra columns that clash with what operators make."""
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string")
    return df.select("*", *(F.lit(-7).alias(c) for c in ("size", "score", "n", "keys", "key", "group", "shard", "target", "start", "list", "component")))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_token_counts(docs, none):
    rows = token_count.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    held = token_count.word_counts(public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i is None, i or 0, sum(held[w] for w in (t or "").split())) for i, t, *_ in ROWS)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in rows) == want
    assert token_count.token_counts(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_token_counts_of_whole_texts(docs):
    rows = token_count.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), whole=True).where("doc_id in (5, 6, 7, 8)").collect()
    assert sorted((r.doc_id, r.n_words, r.n_tokens) for r in rows)[:3] == [(5, 0, 0), (6, 0, 0), (7, 0, 3)]


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tokenizer, rows = Tokenizer.from_file(BPE), packing.pack(docs.where("doc_id <> 10"), BPE, size=256).collect()
    parts = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.start):
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4
        parts[r.doc_id].append(bytes(r.ids))
    for i, t, *_ in ROWS:
        if i not in (10, None):
            assert np.frombuffer(b"".join(parts[i]), "<u4").tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    for _, group in pieces_by(rows, "sequence_id"):
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 256 or at & (at - 1) == 0
    assert packing.pack(none, BPE).count() == 0


def pieces_by(rows, name):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[name]].append(r)
    return out.items()


def test_language_id(spark, docs, none):
    train = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the cat and the dog of the house", "en"), ("der hund und die katze aus dem haus", "de")] * 5)], "doc_id bigint, text string, lang string")
    model = langid.fit(train)
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(docs.drop("score"), model, keep=("doc_id", "n")).collect()}
    assert {(5, "und"), (6, "und"), (7, "und"), (10, "und"), (12, "de")} <= got
    assert langid.identify(none, model).count() == 0 and langid.fit(train.limit(0)) == {"languages": [], "strings": [], "counts": []}
    many = train.unionByName(train.selectExpr("doc_id", "text", "concat('x', doc_id) as lang"))
    assert langid.fit(many, most_languages=2)["languages"] == ["de", "en"]
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(train.limit(0))).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.identify(docs, model, keep=("doc_id", "score"))


def test_near_duplicates(docs, none):
    rows = near_dup.near_duplicates(docs, shingle=3, percent=85).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert len(rows) == len(ROWS)
    assert got[1] == (18, 1, True) and got[2] == (18, 1, False) and got[3] == (18, 1, False) and got[4] == (19, 1, False)
    assert got[5] == (0, 5, True) and got[6] == (0, 6, True) and got[7] == (0, 7, True) and got[8] == (1, 8, True) and got[9] == (1, 8, False)
    assert got[10] == (1, 10, True) and got[None][2] is False
    assert near_dup.near_duplicates(none).count() == 0


def test_rows_that_repeat_an_id_are_judged_by_their_own_text(spark):
    other = BASE.replace("o", "0")
    rows = [(1, BASE), (1, other), (1, other), (2, other + " more"), (3, BASE + " more"), (None, BASE), (None, "some words of their own"), (None, "some words of their own"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit(0))
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in near_dup.near_duplicates(df, shingle=3, percent=85).collect())
    assert got == [(-1, 0, -1, False), (-1, 3, -1, False), (-1, 3, -1, False), (-1, 18, 1, False), (1, 18, 1, True), (1, 18, 1, True), (1, 18, 1, True), (2, 19, 1, False), (3, 19, 1, False)]
    kept = near_dup.one_of_each(df, shingle=3, percent=85)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted([(1, BASE), (1, other), (-1, "some words of their own"), (-1, "")])


def test_large_sets_are_compared_in_smaller_blocks(spark, monkeypatch):
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(f"x{i}_{k}" if k == i * 7 else w for k, w in enumerate(base)) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(near_dup, "BLOCK_ITEMS", 900)
    monkeypatch.setattr(near_dup, "PAIRED", 2)
    rows = near_dup.near_duplicates(df, shingle=3, percent=85, pivots=0).collect()
    assert {r.component_id for r in rows} == {0}


def test_near_duplicates_join_large_groups_exactly(spark):
    """Copies of one text with random edits: the components are those of brute force, whatever the bucket sizes."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(150):
        w = list(base)
        for k in rng.integers(0, 80, rng.integers(0, 9)):
            w[k] = f"x{i}_{k}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [near_dup.shingles(t, 3) for t in texts]
    both = near_dup.common(sets, sets).astype(int)
    sizes = np.array([len(s) for s in sets])
    linked = 100 * both >= 85 * (sizes[:, None] + sizes[None, :] - both)
    root = np.arange(150)
    while True:
        new = np.array([root[linked[i]].min() for i in range(150)])
        if (new == root).all():
            break
        root = new
    for paired, block in ((near_dup.PAIRED, near_dup.BLOCK), (2, 16)):
        old = near_dup.PAIRED, near_dup.BLOCK
        near_dup.PAIRED, near_dup.BLOCK = paired, block
        try:
            got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, shingle=3, percent=85).collect()}
        finally:
            near_dup.PAIRED, near_dup.BLOCK = old
        assert [got[i] for i in range(150)] == root.tolist()


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 7), (20, 20), (None, 3)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "src bigint, dst bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7}
    assert common.components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source_size, r.target].append(r)
    total = sum(len((t or "").split()) for _, t, *_ in ROWS)
    assert sum(t for _, t in by) == pytest.approx(total)
    for (size, target), group in by.items():
        assert abs(sum(r.taken for r in group) - target) <= 1 and target <= 3 * size + 1e-9 and all(0 <= r.taken <= 3 * r.size for r in group)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, rows)) and mixing.mix(none).count() == 0


def test_mixing_with_cuts_of_many_sources_joined(docs, monkeypatch):
    want = sorted(map(str, mixing.mix(docs, keep=("doc_id", "text")).collect()))
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert sorted(map(str, mixing.mix(docs, keep=("doc_id", "text")).collect())) == want


def test_mixed_documents_hold_the_words_taken(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(5 + i)) + "\n", f"s{i % 3}") for i in range(30)], "doc_id bigint, text string, source string")
    mixed = mixing.mix(df, keep=("doc_id", "text", "source"))
    want = {r.doc_id: r.taken for r in mixed.collect()}
    got = collections.Counter()
    for r in mixing.repeated(mixed, ["doc_id", "text", "source"]).collect():
        got[r.doc_id] += len(r.text.split())
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "a<|im_end|>\\n<|"), (1, 1, "assistant", "\\<|\\\\"), (1, 2, None, None), (2, 0, "x\ny\\n", "é\n"), (None, 0, "assistant", ""), (3, 1, "assistant", "second"), (3, 0, "assistant", "first")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("position", F.lit(-1))
    pieces = chat.format_turns(chat.with_probe(spark, df))
    got = {r.conv_id: r for r in chat.digests(chat.expand(pieces)).collect()}
    probe = chat.PROBE
    for conv, group in pieces_by([*map(lambda t: collections.namedtuple("T", "conv turn role text")(*t), turns), *(collections.namedtuple("T", "conv turn role text")(-1, k, r, probe) for k, r in enumerate(("user", "assistant")))], 0):
        group = sorted(group, key=lambda t: t.turn)
        said = "".join(f"{t.role or ''}\n{t.text or ''}\n" for t in group)
        loss = "".join(t.text for t in group if t.role == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(group), hashlib.sha256(said.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    found = chat.examples(pieces).where("conv_id = 3").orderBy("example").collect()
    text = chat.written_out(pieces, 3, 1)
    assert [text[r.loss_start : r.loss_end] for r in found] == ["first", "second"] and found[1].context_chars == len("<|im_start|>assistant\nfirst<|im_end|>\n")
    assert chat.digests(chat.expand(chat.format_turns(df.limit(0)))).count() == 0
    # One example for each reply, each with all turns before it as context; the loss is read through these rows alone.
    assert chat.examples(pieces).groupBy("conv_id").count().where("conv_id = 3 and count = 2").count() == 1
    shifted = chat.expand(pieces).withColumn("context_chars", F.col("context_chars") + 1)
    with pytest.raises(Exception, match="context is not the text before"):
        chat.digests(shifted).collect()
    without = chat.digests(chat.expand(pieces).where("kind = 0")).collect()
    assert {r.loss_chars for r in without} == {0} and {r.n_turns for r in without} == {r.n_turns for r in got.values()}


def test_chat_of_long_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", "<|\\" * 200_000), (1, 1, "assistant", "é" * 500_000)], "conv_id bigint, turn bigint, role string, text string")
    (row,) = chat.digests(chat.expand(chat.format_turns(df))).collect()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, 500_000, hashlib.sha256(("é" * 500_000).encode()).hexdigest())


def vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8))
    x[100:140] = x[5] + rng.normal(size=(40, 8)) * 0.02
    x[150:160] = x[7] * 2
    rows = [(i, [float(v) for v in x[i]], i % 2 if i < 90 else 1) for i in range(300)]
    odd = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 8, 1), (1003, [float("nan")] * 8, 1), (1004, [1.0, None] * 4, 1), (1005, [float("inf")] * 8, 1), (1006, rows[5][1], None), (1020, rows[5][1], 1), (1020, rows[5][1], 1)]
    return x, rows, spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int").withColumn("id", F.lit(-3)).withColumn("v", F.lit(0))


@pytest.mark.parametrize("cell, block, copy", [(vector_dup.CELL, vector_dup.BLOCK, vector_dup.COPY), (4, 32, 0)])
def test_vector_duplicates(spark, monkeypatch, cell, block, copy):
    _, _, df = vectors(spark)
    for name, value in (("CELL", cell), ("BLOCK", block), ("COPY", copy)):
        monkeypatch.setattr(vector_dup, name, value)
    x = vector_dup.unit(np.random.default_rng(8).normal(size=(300, 8)))
    assert len(vector_dup.pivots_for(x, 200, 0.2)) > (8 if copy == 0 else 0)
    got = {r.vec_id: r for r in vector_dup.vector_duplicates(df).collect()}
    fine = {r.vec_id: (np.array(r.embedding, float), r.label) for r in df.collect() if r.vec_id < 1000 or r.vec_id == 1020}
    ids = sorted(fine)
    u = np.stack([fine[i][0] / np.linalg.norm(fine[i][0]) for i in ids])
    labels = np.array([fine[i][1] for i in ids])
    linked = (u @ u.T >= 0.98) & (labels[:, None] == labels[None, :])
    root = np.array(ids)
    for _ in range(20):
        root = np.array([root[row].min() for row in linked])
    assert {i: (got[i].n_links, got[i].component_id) for i in ids} == {i: (int(row.sum()) - 1, int(c)) for i, row, c in zip(ids, linked, root, strict=True)}
    assert all(got[i].n_links == 0 and got[i].kept for i in range(1000, 1007)) and vector_dup.vector_duplicates(df.limit(0)).count() == 0


def test_vectors_of_null_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.001], 1), (2, [0.0, 1.0], 1), (2, [0.0, 1.0], 0), (3, [0.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in vector_dup.vector_duplicates(df).collect())
    assert got == [(-1, 0, -1, False), (1, 0, 1, True), (2, 1, 2, True), (2, 1, 2, True), (2, 1, 2, True), (3, 1, 2, False)]
    found = ann.nearest(df, "id = 1", 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(2, 0.0), (3, 0.0)]


def test_nearest_of_many_equal_vectors_takes_the_smallest_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATES", 16)
    monkeypatch.setattr(ann, "BLOCK", 40)
    rng = np.random.default_rng(3)
    same = [float(v) for v in rng.normal(size=32)]
    rows = [(i, same if i % 3 else [float(v) for v in rng.normal(size=32)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = ann.nearest(df, "id % 50 = 1", 20).orderBy("query_id", "rank").collect()
    for q, group in pieces_by(found, "query_id"):
        if q % 3:
            assert [r.vec_id for r in group] == [i for i in range(60) if i % 3 and i != q][:20]


def test_recall_and_scores_on_clustered_vectors(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 64))
    x = centres[rng.integers(0, 40, 4000)] + 0.4 * rng.normal(size=(4000, 64))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(4000)], "vec_id bigint, embedding array<double>")
    found, hits = ann.nearest(df, "id % 20 = 0", 20).collect(), 0
    for q, group in pieces_by(found, "query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({r.vec_id for r in group} & set(np.lexsort((np.arange(4000), -s))[:20].tolist()))
        assert len(group) == 20
    assert hits >= 0.9 * 20 * 200


def test_nearest(spark):
    _, _, df = vectors(spark)
    rows = ann.nearest(df, "id % 20 = 0", 5).collect()
    fine = {r.vec_id: np.array(r.embedding, float) for r in df.collect() if r.vec_id < 1000 or r.vec_id in (1006, 1020)}
    ids, hits = sorted(fine), 0
    x = np.stack([fine[i] for i in ids])
    by = dict(pieces_by(rows, "query_id"))
    assert sorted(by) == [i for i in ids if i % 20 == 0]
    for q, found in by.items():
        s = x @ fine[q]
        best = sorted((-v, i) for v, i in zip(s, ids, strict=True) if i != q)[:5]
        assert [r["rank"] for r in sorted(found, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]
        hits += len({i for _, i in best} & {r.vec_id for r in found})
        assert all(r.score == pytest.approx(float(fine[q] @ fine[r.vec_id])) for r in found)
    assert hits >= 0.9 * 5 * len(by) and ann.nearest(df.limit(0), "true").count() == 0
    assert ann.nearest(df.where("vec_id < 3"), "true", 5).groupBy("query_id").count().where("count = 2").count() == 3


def test_sharding(docs, none):
    rows = sharding.shard(docs, 3).collect()
    assert len(rows) == len(ROWS) and len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"eins zwei")}) == 1
    for _, group in pieces_by(rows, "shard"):
        assert sorted(r.slot for r in group) == list(range(len(group)))
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (5, 6)} == {(16, None), (16, 0)} and sharding.shard(none, 3).count() == 0


def test_cuts_are_those_of_all_groups(spark):
    rng = np.random.default_rng(6)
    keys, sizes = np.unique(rng.integers(0, 1 << 60, 5000)), rng.integers(1, 2000, 5000)
    df = spark.createDataFrame([(int(k), int(s)) for k, s in zip(keys, sizes, strict=False)], "group bigint, bytes bigint")
    old, sharding.MOST_RANGES, sharding.FIRST_BITS = (sharding.MOST_RANGES, sharding.FIRST_BITS), 256, 4
    try:
        found = sharding.cuts(df, 7)
    finally:
        sharding.MOST_RANGES, sharding.FIRST_BITS = old
    assert found.capacity == sharding.least_capacity(sizes[: len(keys)], 7) and not found.alone and len(found.starts) <= 7


def test_groups_above_a_fair_share_stand_alone(spark):
    rows = [(i, "x" * 5000 if i < 40 else "y" * 4000 if i < 60 else "z" * (20 + i)) for i in range(200)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), 5).collect()
    by = {s: list(g) for s, g in pieces_by(got, "shard")}
    texts = dict(rows)
    owners = [{texts[r.doc_id][0] for r in g} for g in by.values()]
    assert sorted(map(sorted, owners)) == [["x"], ["y"], ["z"], ["z"], ["z"]]
    sizes = [sum(r.size for r in g) for g, o in zip(by.values(), owners, strict=True) if o == {"z"}]
    assert max(sizes) - min(sizes) <= 2 * 236 and all(sorted(r.slot for r in g) == list(range(len(g))) for g in by.values())


def test_url_rules(spark):
    urls = {
        None: ("", "", None, "allow"), "no scheme/en/": ("", "", None, "allow"), "http://WWW.Example.com/en/x?y#z": ("www.example.com", "/en/x", "www.example.com/en/", "allow"), "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "https://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"), "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"), "http://x.net?/es/": ("x.net", "", None, "allow"), "http://com": ("com", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("tokens", F.lit(1))
    labelled = spark.createDataFrame([], "url string, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labelled).collect()}
    assert got == dict(enumerate(urls.values())) and url_filter.judge(pages.limit(0), labelled).count() == 0


def test_a_mined_rule_turns_a_verdict(spark):
    urls = [*(f"http://a{i % 7}.casino.{d}/x/{i}" for i in range(40) for d in ("com", "org")), *(f"http://b{i % 7}.{d}/x/{i}" for i in range(40) for d in ("com", "org")), "http://" + "a." * 40 + "com/" + "y/" * 3000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    labelled = pages.select("url", F.contains("url", F.lit("casino")).alias("bad"))
    got = {r.page_id: r for r in url_filter.judge(pages, labelled, rules=(("allow", "com", "/"),)).collect()}
    for i, url in enumerate(urls):
        assert got[i].mined == ("casino" in url) and got[i].verdict == ("block" if "casino.org" in url else "allow")
    assert {r.verdict for r in url_filter.judge(pages, labelled.limit(0), rules=(("allow", "com", "/"),)).collect()} == {"allow"}


def test_listed_rules_label_urls(spark):
    pages = spark.createDataFrame([("http://x.net/es/1",), ("http://x.net/en/1",), ("http://x.com/en/1",), (None,)], "url string")
    assert {(r.url, r.bad) for r in url_filter.listed_urls(pages).collect()} == {("http://x.net/es/1", True), ("http://x.net/en/1", False), ("http://x.com/en/1", False)}


def test_mined_rules_equal_counting_all_combinations(spark):
    from itertools import combinations

    rng = np.random.default_rng(9)
    rows = []
    for _ in range(400):
        t = sorted({f"h={rng.integers(0, 4)}", f"p={rng.integers(0, 3)}", f"q={rng.integers(0, 2)}"})
        rows.append((t, bool(rng.random() < (0.9 if "h=1" in t and "p=2" in t else 0.1))))
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    found = {tuple(r.antecedent) for r in url_filter.mine(df, min_support=0.02, min_confidence=0.5, min_lift=1.5).collect()}
    share, want = sum(b for _, b in rows) / len(rows), set()
    for k in (1, 2, 3):
        for c in {c for t, _ in rows for c in combinations(t, k)}:
            n = [b for t, b in rows if set(c) <= set(t)]
            if sum(n) / len(rows) >= 25 / 400 and sum(n) / len(n) >= 0.5 and sum(n) / len(n) / share >= 1.5:
                want.add(c)
    assert found == want and ("h=1", "p=2") in found
    hit = {tuple(r.tokens) for r in url_filter.matched(df.select("tokens").distinct(), url_filter.mine(df, min_support=0.02, min_confidence=0.5)).collect()}
    assert hit == {tuple(t) for t, _ in rows if any(set(c) <= set(t) for c in want)}


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    odd = spark.createDataFrame([(10_001, None, "en", "src1", 0), (10_002, "", "en", None, 0), (10_003, "12 34", None, "src2", 5)], docs.schema)
    kept = corpus_pipeline.language_id(spark, docs.unionByName(odd), sf)
    assert kept.columns == columns and kept.count() == docs.count()
    short = ["The quick brown fox jumps over the lazy dog while Mary quickly packs five dozen jugs of liquor", "Fjord!", "дом стоит на горе и в нём живёт кот, а за домом лес"]
    more = spark.createDataFrame([(20_000 + i, t, None, "s", len(t)) for i, t in enumerate(short)], docs.schema)
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(more), sf).where("doc_id >= 20000").orderBy("doc_id").collect()] == [20_000, 20_001]
    unlabelled = docs.unionByName(odd).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, unlabelled, sf).count() == docs.where("text rlike '\\\\p{L}'").count()
    once = corpus_pipeline.near_dedup(spark, kept, sf)
    sets = {r.doc_id: near_dup.shingles(r.text, 5) for r in docs.collect()}
    left = [r.doc_id for r in once.collect()]
    assert len(left) == len(set(left)) < docs.count()
    for i, a in enumerate(left):
        for b in left[:i]:
            n = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * n < 80 * (len(sets[a]) + len(sets[b]) - n)
    mixed = corpus_pipeline.mixing(spark, once, sf)
    assert mixed.columns == columns and abs(sum(len(r.text.split()) for r in mixed.collect()) - sum(len(r.text.split()) for r in once.collect())) < 100
    assert corpus_pipeline.packing(spark, mixed, sf).count() >= mixed.count()


@pytest.mark.parametrize("rows", [[], [(None, BASE, "en", "a", 1), (None, BASE, "en", "b", 1), (7, BASE + " end", None, None, 2), (7, "quite another text of few words", "en", "a", 3), (8, None, "en", None, 0), (9, "", None, "a", 0)]])
def test_pipeline_runs_on_odd_documents(spark, tmp_path, rows):
    import corpus_pipeline

    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.doc_tokens) for r in found} <= {(7, r.doc_tokens) for r in found} and (len(found) > 0) == bool(rows)


def test_pipeline_equals_its_stages_by_brute_force(spark):
    """All of run() on a small table: what is kept, mixed and packed, from plain sets, the mixing SQL's rules and the tokenizer."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sets = {i: near_dup.shingles(r.text, 5) for i, r in docs.items() if any(map(str.isalpha, r.text or ""))}
    root = {i: i for i in sets}
    linked = True
    while linked:
        linked = False
        for i in sets:
            for j in sets:
                n = len(np.intersect1d(sets[i], sets[j])) if root[i] < root[j] else 0
                if n and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                    root = {k: root[i] if r == root[j] else r for k, r in root.items()}
                    linked = True
    once = [i for i in sets if root[i] == i]
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} <= set(once)
    tokenizer = Tokenizer.from_file(BPE)
    ids = {i: len(tokenizer.encode(docs[i].text, add_special_tokens=False).ids) + 1 for i in once}
    whole = [r for r in rows if r.start == 0]
    assert sum(r.doc_tokens != ids[r.doc_id] for r in whole) <= len({docs[i].source for i in once})  # cut where a source's budget ends
    assert max(collections.Counter(r.doc_id for r in whole).values()) <= 3
    for _, group in pieces_by(rows, "sequence_id"):
        length = sum(r.length for r in group)
        assert length == 4096 or length & (length - 1) == 0
