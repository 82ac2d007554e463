"""Packing documents into sequences: sum-of-squares online packing.

N[h] is the number of open sequences that are filled to level h. A document goes to
the level (or into a new sequence) that leaves the sum of N[h]^2 least, tracked in
one level array; full sequences leave at once. Sizes that never add up to a full one (all
above half of it, say) leave ever more open, so at MOST_OPEN open sequences the
fullest is filled up from the emptiest, cutting a document, and leaves: that number
bounds what a task holds. Each task packs what it reads as it comes: tokenizing and
packing share the scan's tasks, and nothing is shuffled.

A document longer than a sequence first fills whole sequences of its own. When a
task has read its last document, its open sequences are closed: the fullest are
filled up from the emptiest, cutting documents, and the rest, less than one
sequence, is laid into sequences whose lengths are powers of two. So no padding
is left, and documents are cut only there, at that bound and where they exceed a sequence.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodegraph.llm.common import PART, bounded_arrow, bytes_of, hashed_words, held, parts

SEQUENCE = 4096
END_ID = 2
#: Open sequences that a task holds at most: 32 MB of ids.
MOST_OPEN = 2048
#: Places for words that a Python worker keeps, by the upper bits of their hash, and ids that they may have in all (28 and 16 MB).
PLACES, POOL = 1 << 21, 1 << 22
#: Words of more bytes are tokenized each time.
LONGEST = 64
_APART = bytes_of(0x20, 0x0A)
#: Letters that NFC leaves alone and whose lower case is one letter: a run of these is one word to the tokenizer.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ſ]+\\Z")
#: Signs that follow a word and make one pre-token with each other, but none with the letters before them.
_SIGNS = ".,;:!?*#%$&()[]{}\"-_+=/\\@^~<>|`"


class WordIds:
    """Ids of texts, word by word. The tokenizer drops white space and never joins words, so a
    text's ids are its words' ids; words are cut at space and line feed only. A word's ids
    are kept in the place that its 64-bit hash names, for texts repeat their words."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.whole = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        # Plain words in lower case are what normalization and splitting leave alone.
        self.plain = None, pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.last[i] = piece.endswith("</w>")
        self.shift = np.uint64(65 - PLACES.bit_length())
        self.keys, self.starts, self.sizes = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.int32), np.full(PLACES, -1, np.int16)
        self.pool, self.used = np.zeros(POOL, "<u4"), 0

    def one(self, word: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4")

    def several(self, words: list[str]) -> list[np.ndarray]:
        """Plain words in lower case, in one call: each ends at an id that ends a word."""
        if not words:
            return []
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.plain
        try:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        finally:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.whole
        ends = np.flatnonzero(self.last[ids]) + 1
        return np.split(ids, ends[:-1]) if len(ends) == len(words) else [self.one(w) for w in words]

    def learn(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each of these distinct words."""
        known: dict[str, np.ndarray] = {}
        cut: list[tuple[str, str] | None] = []
        for w in words:
            core = w.rstrip(_SIGNS)
            cut.append((core.lower(), w[len(core) :]) if core and _PLAIN.match(core) else None)
        lower = list({c[0] for c in cut if c})
        known.update(zip(lower, self.several(lower), strict=True))
        tails = {tail: self.one(tail) for tail in {c[1] for c in cut if c}}
        return [self.one(w) if c is None else np.concatenate([known[c[0]], tails[c[1]]]) if c[1] else known[c[0]] for w, c in zip(words, cut, strict=True)]

    def _ids(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids of each word, end of each word) of joined texts."""
        start, end, key = hashed_words(np.frombuffer(raw, np.uint8), _APART)
        place = (key >> self.shift).astype(np.int64)
        absent = np.flatnonzero((self.keys[place] != key) | (self.sizes[place] < 0))
        at, size = self.starts[place].astype(np.int64), self.sizes[place].astype(np.int64)
        source = self.pool
        if len(absent):
            _, first, where = np.unique(key[absent], return_index=True, return_inverse=True)
            which = absent[first]
            found = self.learn([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[which].tolist(), end[which].tolist(), strict=True)])
            sizes = np.array([len(f) for f in found], np.int64)
            short = (end - start)[which] <= LONGEST
            kept = int(sizes[short].sum())
            if self.used + kept > POOL:  # full: what is kept starts anew, this part's known words stay readable
                self.sizes[:] = -1
                source, self.pool, self.used = self.pool, np.zeros(max(POOL, kept), "<u4"), 0
            fresh = np.concatenate(found)
            offset = np.cumsum(sizes) - sizes
            if kept:
                self.pool[self.used : self.used + kept] = fresh[np.repeat(short, sizes)]
                p = place[which[short]]
                self.keys[p], self.sizes[p] = key[which[short]], sizes[short]
                self.starts[p] = self.used + np.cumsum(sizes[short]) - sizes[short]
                # Of words that share a place the last one written has it, key, start and size alike.
                self.used += kept
            at[absent], size[absent] = offset[where] + len(source), sizes[where]
            source = (source, fresh)
        ends = np.cumsum(size)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - size), size)
        if isinstance(source, tuple):
            old, fresh = source
            new = index >= len(old)
            out = old[np.where(new, 0, index)]
            out[new] = fresh[index[new] - len(old)]
        else:
            out = source[index]
        return out, size, end

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if waiting:
                ids, sizes, end = self._ids(b"\n".join(part for _, part in waiting))
                words = np.searchsorted(end, np.cumsum([len(part) + 1 for _, part in waiting]))
                cuts = np.concatenate([[0], np.cumsum(sizes)])[words]
                for (i, _), a, b in zip(waiting, [0, *cuts.tolist()], cuts.tolist(), strict=False):
                    out[i].append(ids[a:b].tobytes())
                waiting.clear()
                size = 0

        for i, raw in enumerate(texts):
            for part in parts(raw, _APART, PART // 2):
                if size + len(part) >= PART // 2:
                    flush()
                waiting.append((i, part))
                size += len(part) + 1
        flush()
        return [b"".join(o) for o in out]


def word_ids(tokenizer_file: str) -> WordIds:
    return held(("packing", tokenizer_file), lambda: WordIds(tokenizer_file))


class Levels:
    """Open sequences by fill level. A piece is (document, first id, ids as bytes, ids of the document)."""

    def __init__(self, size: int = SEQUENCE, most_open: int = MOST_OPEN):
        self.size, self.most_open, self.held = size, most_open, 0
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(size + 1)]

    def level_for(self, n: int) -> int:
        """The level that n ids are put on; 0 starts a sequence. Among equals the fullest."""
        top = self.size - n
        here = self.count[1 : top + 1]
        cost = 2 * (self.count[1 + n : self.size + 1] - here) + 2
        if top:
            cost[-1] = 1 - 2 * here[-1]  # a full sequence counts no more
        cost[here == 0] = np.iinfo(np.int64).max
        best = top - 1 - int(np.argmin(cost[::-1])) if top else -1
        return best + 1 if top and here[best] and cost[best] <= 2 * self.count[n] + 1 else 0

    def put(self, piece: tuple) -> list[tuple] | None:
        """Place a piece of at most the sequence's size; the sequence's pieces, if that filled it."""
        n = len(piece[2]) // 4
        if n == self.size:
            return [piece]
        level = self.level_for(n)
        pieces = self._pop(level) if level else []
        pieces.append(piece)
        if level + n == self.size:
            return pieces
        self._push(level + n, pieces)
        return self._fill() if self.held > self.most_open else None

    def _pop(self, level: int) -> list[tuple]:
        self.count[level] -= 1
        self.held -= 1
        return self.open[level].pop()

    def _push(self, level: int, pieces: list[tuple]) -> None:
        self.count[level] += 1
        self.held += 1
        self.open[level].append(pieces)

    def _fill(self) -> list[tuple]:
        """The fullest open sequence, filled up from the emptiest ones."""
        used = np.flatnonzero(self.count)
        level = int(used[-1])
        pieces = self._pop(level)
        while level < self.size:
            low = int(np.flatnonzero(self.count)[0])
            given = self._pop(low)
            while given and level < self.size:
                doc, start, ids, of = given.pop()
                low -= len(ids) // 4
                room = 4 * (self.size - level)
                if len(ids) > room:
                    given.append((doc, start + room // 4, ids[room:], of))
                    low += (len(ids) - room) // 4
                    ids = ids[:room]
                pieces.append((doc, start, ids, of))
                level += len(ids) // 4
            if given:
                self._push(low, given)
        return pieces

    def close(self) -> Iterator[list[tuple]]:
        """The open sequences, filled up without padding; the last ones are powers of two long."""
        fills = [(h, pieces) for h in range(self.size, 0, -1) for pieces in self.open[h]]
        total = sum(h for h, _ in fills)
        whole = total // self.size
        rest = chain.from_iterable(p for _, p in fills[whole:])
        left: list[tuple] = []

        def take(n: int) -> Iterator[tuple]:
            while n:
                doc, start, ids, of = left.pop() if left else next(rest)
                if len(ids) > 4 * n:
                    left.append((doc, start + n, ids[4 * n :], of))
                    ids = ids[: 4 * n]
                n -= len(ids) // 4
                yield doc, start, ids, of

        for h, pieces in fills[:whole]:
            yield [*pieces, *take(self.size - h)]
        remain = total - whole * self.size
        for power in range(self.size.bit_length(), -1, -1):
            if remain >> power & 1:
                yield list(take(1 << power))
        self.__init__(self.size, self.most_open)


_OUT = pa.schema([("id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])


def pack(docs: DataFrame, tokenizer_file: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents in sequences: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    ids are a piece's ids as little-endian 32-bit integers (left out unless with_ids).
    tokenizer_file is a path that holds on every executor. A null or empty text is its
    end_id alone. Repeated rows are packed each; null ids are kept; an empty table gives
    no pieces; other columns are not read. Sequence ids hold the number of the task that
    made them, and a task that runs again gives the same pieces.
    """
    bounded_arrow(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    out = _OUT if with_ids else pa.schema(list(_OUT)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, levels, end = word_ids(tokenizer_file), Levels(size), np.array([end_id], "<u4").tobytes()
        sequence, done = TaskContext.get().partitionId() << 40, []

        def emit(pieces: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, of in pieces:
                n = len(ids) // 4
                done.append((doc, start, n, zlib.crc32(ids), of, sequence, offset, ids)[: len(out)])
                offset += n
            sequence += 1

        def flush() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), out, strict=True)], schema=out)
            done.clear()
            return batch

        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), words.texts(texts), strict=True):
                ids += end
                of = len(ids) // 4
                for start in range(0, of, size):
                    filled = levels.put((doc, start, ids[4 * start : 4 * (start + size)], of))
                    if filled:
                        emit(filled)
            if done:
                yield flush()
        for pieces in levels.close():
            emit(pieces)
            if len(done) >= 10_000:
                yield flush()
        if done:
            yield flush()

    kinds = ["id bigint", *(f"{f.name} bigint" for f in list(_OUT)[1:7]), *(["ids binary"] if with_ids else [])]
    return rows.mapInArrow(run, ", ".join(kinds)).withColumnRenamed("id", id_col)
