"""The operators' own algorithms against brute force, without Spark where none is needed."""

import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from lodegraph.llm import ann, common, langid, near_dup, packing, sharding, token_count, vector_dup

TEXTS = ["", " ", "a", "The quick, brown fox's 12 foxes!!", "Ünïcödé straße İstanbul Σας", "漢字 テスト ab", "x" * 300, "🙂🙂 é ﬁ b　c\x1cd", "tab\tand\nline\x0bfeed <|endoftext|>x", "WORD*** re$$$ don't we'll"]


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_counts_equal_a_unigram_tokenizer(byte_fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_count.unigram_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    whole = [("<unk>", 0.0), *vocabulary, *([(f"<0x{i:02X}>", -1.0) for i in range(256)] if byte_fallback else [])]
    tokenizer = Tokenizer(models.Unigram(whole, 0, byte_fallback))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    counts = token_count.WordCounts(vocabulary, byte_fallback)
    for text in TEXTS:
        words = text.split()
        assert sum(counts[w] for w in words) == len(tokenizer.encode(" ".join(words)).ids), text


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_counts_of_whole_texts_equal_a_unigram_tokenizer(byte_fallback):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_count.unigram_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    whole = [("<unk>", 0.0), *vocabulary, *([(f"<0x{i:02X}>", -1.0) for i in range(256)] if byte_fallback else [])]
    tokenizer = Tokenizer(models.Unigram(whole, 0, byte_fallback))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    counts = token_count.WordCounts(vocabulary, byte_fallback)
    spaced = ["\n", "a\nb", "a  b", " a", "a ", "   ", "\ta\r\n\n b", "a▁b", "▁", "▁ a", "a \n 漢\n漢", " ".join(TEXTS), "\n".join(TEXTS)]
    for text in [*TEXTS, *spaced, *pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]:
        assert counts.text(text or "") == len(tokenizer.encode(text or "").ids), text


def test_ties_keep_the_longest_last_piece():
    vocabulary = [("▁", -1.0), ("a", -1.0), ("▁a", -2.0), ("aa", -2.0), ("▁aa", -3.0)]
    assert [token_count.WordCounts(vocabulary)[w] for w in ("a", "aa", "aaa")] == [1, 1, 2]
    for word in ("a", "aa", "aaa", "aaaa"):
        s, best = "▁" + word, {}

        def paths(i, s=s):
            if i == len(s):
                yield 0.0, ()
            for p, score in vocabulary:
                if s.startswith(p, i):
                    for rest, pieces in paths(i + len(p)):
                        yield score + rest, (p, *pieces)

        best = max(score for score, _ in paths(0))
        assert token_count.WordCounts(vocabulary)[word] in {len(p) for score, p in paths(0) if score == best}


@pytest.mark.parametrize("pool, part", [(packing.POOL, packing.PART), (300, 200)])
def test_word_ids_equal_the_tokenizer_on_whole_texts(monkeypatch, pool, part):
    monkeypatch.setattr(packing, "POOL", pool)
    monkeypatch.setattr(packing, "PART", part)
    ids = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = [*TEXTS, " ".join(TEXTS), "a" * 499 + " " + "b" * 501, "x" * 3000 + " y"] * 2
    for text, got in zip(texts, ids.texts([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_parts_of_a_text_are_cut_between_words():
    apart = common.bytes_of(0x20, 0x0A)
    raw = " ".join("w" * (k % 9 + 1) for k in range(300)).encode() + b" " + b"z" * 400 + b"\nend"
    cut = list(common.parts(raw, apart, 50))
    assert b"".join(cut) == raw and all(len(c) <= 50 or b"z" in c for c in cut) and all(apart[c[-1]] for c in cut[:-1])
    assert list(common.parts(b"", apart)) == []


def test_open_sequences_are_bounded_and_leave_no_padding():
    rng, levels, sequences, count = np.random.default_rng(1), packing.Levels(4096, 64), [], 20_000
    for i in range(count):
        n = 3000 if i < count // 2 else int(rng.integers(1400, 4000))
        done = levels.put((i, 0, b"\1\0\0\0" * n, n))
        assert levels.held <= 64 and levels.held == levels.count.sum()
        if done:
            sequences.append([p[:2] + (len(p[2]) // 4, p[3]) for p in done])
    sequences += [[p[:2] + (len(p[2]) // 4, p[3]) for p in s] for s in levels.close()]
    lengths = [sum(p[2] for p in s) for s in sequences]
    assert all(n & (n - 1) == 0 for n in lengths) and sum(n < 4096 for n in lengths) <= 12
    pieces = sorted(p for s in sequences for p in s)
    for i, group in itertools.groupby(pieces, key=lambda p: p[0]):
        at = 0
        for _, start, n, of in group:
            assert start == at
            at += n
        assert at == of
    assert len({p[0] for p in pieces}) == count


@pytest.mark.parametrize("size, count", [(64, 300), (16, 57), (8, 0), (8, 1)])
def test_packing_holds_every_id_once_and_leaves_no_padding(size, count):
    rng, levels, sequences, docs = np.random.default_rng(count), packing.Levels(size), [], []
    for i in range(count):
        ids = rng.integers(0, 99, rng.integers(1, 3 * size)).astype("<u4").tobytes()
        docs.append(ids)
        for start in range(0, len(ids) // 4, size):
            done = levels.put((i, start, ids[4 * start : 4 * (start + size)], len(ids) // 4))
            if done:
                sequences.append(done)
    sequences += levels.close()
    lengths = [sum(len(p[2]) // 4 for p in s) for s in sequences]
    assert all(n == size or n & (n - 1) == 0 for n in lengths) and sum(n < size for n in lengths) < size.bit_length()
    parts = sorted((p for s in sequences for p in s), key=lambda p: p[:2])
    assert [b"".join(p[2] for p in g) for _, g in itertools.groupby(parts, key=lambda p: p[0])] == docs


def test_level_is_the_one_of_least_squares():
    rng, levels = np.random.default_rng(5), packing.Levels(12)
    levels.count[1:12] = rng.integers(0, 3, 11)
    for n in range(1, 12):
        def squares(level, n=n):
            after = levels.count.copy()
            if level:
                after[level] -= 1
            after[level + n] += 1
            return int((after[1:12] ** 2).sum())

        options = [h for h in range(12 - n + 1) if h == 0 or levels.count[h]]
        assert squares(levels.level_for(n)) == min(map(squares, options))


class PlainModel:
    """The model by its definition: a dictionary of contexts, and a walk down from the longest."""

    def __init__(self, texts):
        self.nodes = {}
        for text in texts:
            s = b"\n" * langid.ORDER + text
            for i in range(langid.ORDER, len(s)):
                for k in range(langid.ORDER + 1):
                    node = self.nodes.setdefault(s[i - k : i], {})
                    node[s[i]] = node.get(s[i], 0) + 1

    def bits(self, before, byte):
        out, excluded = 0.0, set()
        for k in range(langid.ORDER, -1, -1):
            left = {b: n for b, n in self.nodes.get(before[len(before) - k :], {}).items() if b not in excluded}
            if left:
                total = sum(left.values()) + len(left)
                if byte in left:
                    return out - np.log2(left[byte] / total)
                out -= np.log2(len(left) / total)
                excluded |= set(left)
        return out + np.log2(256 - len(excluded))

    def text(self, text):
        s = b"\n" * langid.ORDER + text
        return sum(self.bits(s[i - langid.ORDER : i], s[i]) for i in range(langid.ORDER, len(s)))


def scorer_of(texts):
    strings = np.concatenate([langid.grams(np.frombuffer(b"\n" * langid.ORDER + t, np.uint8)) for t in texts])
    return langid.Scorer(["x"], *([a] for a in np.unique(strings, return_counts=True)))


@pytest.mark.parametrize("part", [langid.PART, 7])
def test_ppm_code_lengths_equal_a_plain_model(monkeypatch, part):
    monkeypatch.setattr(langid, "PART", part)
    rng = np.random.default_rng(part)
    for letters in (b"ab \n", b"abcdefgh\t ", bytes(range(256))):
        learnt, asked = ([bytes(rng.choice(list(letters), n)) for n in rng.integers(1, 200, 6)] for _ in range(2))
        asked += [b"", b"xyz xyz", b"a b", b"a \n\n\t  b   ", b"  a b"]
        plain, scorer = PlainModel(learnt), scorer_of(learnt)
        for _ in range(2):  # the second time from the table of strings met before
            assert scorer.lengths(asked)[:, 0] == pytest.approx([plain.text(t) for t in asked])


def test_probabilities_sum_to_one_and_white_space_costs():
    scorer = scorer_of([b"the then this", b"a at the"])
    for before in (b"\n\n\n\n", b" the", b"zzzz", b"is a"):
        strings = np.array([int.from_bytes(before + bytes([b]), "big") for b in range(256)], np.uint64)
        assert (2.0 ** -scorer.trees[0].bits(strings)).sum() == pytest.approx(1)
    a, b, c = scorer.lengths([b"a b", b"a \n\n\t  b   ", b"  a b"])[:, 0]
    assert b > a and c > a
    assert [p[0] for p in scorer.predict(["12 34 !!", None, "", "the"])] == ["und", "und", "und", "x"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_shingles_are_the_sets_of_words():
    texts = [*TEXTS, "a b c a b c a", "A B", "a  b\x0bc\x0cd\re", "a b"]
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
        assert len(near_dup.shingles(t, 3)) == len(sets[-1])
    for (s, t), (a, b) in zip(itertools.combinations(sets, 2), itertools.combinations(texts, 2), strict=True):
        assert len(np.intersect1d(near_dup.shingles(a, 3), near_dup.shingles(b, 3))) == len(s & t)


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 5000):
        assert near_dup.sketch(rng.integers(0, 2**63, n).astype(np.uint64), 192).max() < 1 << 49
    base = rng.integers(0, 2**63, 2000).astype(np.uint64)
    for share in (0.5, 0.9):
        other = np.concatenate([base[: int(2000 * share)], rng.integers(0, 2**63, int(2000 * (1 - share))).astype(np.uint64)])
        real = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
        assert (near_dup.sketch(base, 960) == near_dup.sketch(other, 960)).mean() == pytest.approx(real, abs=0.08)


def test_common_sizes_and_forest():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 90))) for _ in range(20)]
    got = near_dup.common(sets[:12], sets[12:])
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[12 + j])) for i in range(12) for j in range(8))
    links, ids = rng.random((15, 15)) < 0.1, np.arange(15)
    links |= links.T
    joined = vector_dup.forest(links, ids, ids)

    def parts(edges):
        root = list(range(15))
        for a, b in edges:
            ra, rb = root[a], root[b]
            root = [min(ra, rb) if r in (ra, rb) else r for r in root]
        return root

    assert parts(joined) == parts(np.argwhere(links).tolist()) and len(joined) < 15


@pytest.mark.parametrize("seed", range(6))
def test_least_capacity_is_the_best_contiguous_split(seed):
    rng = np.random.default_rng(seed)
    sizes, k = rng.integers(1, 40, 9), 4
    best = min(max(sum(sizes[a:b]) for a, b in itertools.pairwise((0, *cut, 9))) for cut in itertools.combinations(range(1, 9), k - 1))
    capacity = sharding.least_capacity(sizes, k)
    assert capacity == best and len(sharding.walk(sizes, capacity)) <= k
    cut = sharding.even(sizes, capacity, k)
    assert len(cut) <= k and max(sum(sizes[a:b]) for a, b in itertools.pairwise([*cut, 9])) == best


def test_even_cuts_leave_no_shard_short():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes, k = rng.integers(1, 60, rng.integers(300, 600)), int(rng.integers(2, 30))
        capacity = sharding.least_capacity(sizes, k)
        cut = sharding.even(sizes, capacity, k)
        got = [sizes[a:b].sum() for a, b in itertools.pairwise([*cut, len(sizes)])]
        assert len(got) == k and max(got) <= capacity and min(got) >= sizes.sum() / k - 2 * sizes.max()


def test_scan_never_loses_what_it_should_keep_and_abandons_some():
    rng = np.random.default_rng(2)
    q, c = rng.normal(size=(20, 64)), rng.normal(size=(500, 64))
    rotation = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    exact = q @ c.T
    floors = np.sort(exact, axis=1)[:, -20]
    i, j = ann.scan(q, floors, c, rotation)
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    wanted = set(map(tuple, np.argwhere(exact >= floors[:, None]).tolist()))
    assert len(wanted - kept) <= 0.01 * len(wanted) and len(kept) < exact.size / 4


def test_crc_is_of_little_endian_ids():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\1\0\0\0\2\0\0\0")
