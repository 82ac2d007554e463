"""Language ID by prediction by partial matching.

Each language has a tree of byte contexts of up to ORDER bytes. A byte's probability
in a context is its count over the context's total plus its distinct bytes; the
distinct bytes' share is the escape to the next shorter context, in which bytes seen
longer up are excluded (method C). Behind the empty context all bytes not excluded are
equal. Statistics are frozen after training, and a text's code length in a language
is the exact sum over all its bytes, white space included, each in the bytes before it;
the shortest one names the language. A text stands behind ORDER line feeds.

The bytes of longer contexts are among those of their shorter ones, so what exclusion
takes from a level depends on the longer context alone: every level's escape and total
is a number kept with that context, and a byte's code length is a sum of looked-up
numbers. All of it runs on arrays. Code lengths of byte strings met before stay in
a table of fixed size, in the place that their hash names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import CACHE_BYTES, bounded_arrow, held

ORDER = 4
UNKNOWN = "und"
#: Rows of each language that training takes at most, those with the least hash of their id.
MOST_ROWS = 1500
#: Languages learnt at most, those with the most labelled rows: what is counted reaches the driver.
MOST_LANGUAGES = 64
#: Bytes of texts that are coded at a time.
PART = 1 << 18

_U = np.uint64
_BEFORE = b"\n" * ORDER


def grams(raw: np.ndarray) -> np.ndarray:
    """For each byte behind the first ORDER ones: it (lowest) and the ORDER bytes before it, as one number."""
    wide, n = raw.astype(np.uint64), len(raw) - ORDER
    out = wide[ORDER:].copy()
    for k in range(1, ORDER + 1):
        out |= wide[ORDER - k : ORDER - k + n] << _U(8 * k)
    return out


def _low(x: np.ndarray, bytes_: int) -> np.ndarray:
    return x & _U((1 << 8 * bytes_) - 1)


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted among sorted keys, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Tree:
    """Frozen statistics of one language, from its strings of ORDER + 1 bytes and their counts (some, sorted or not).

    For each order: strings with the logarithm of their count; contexts with the bits of
    their own total (all) and escape (leave), and of their parent's, where this context's
    bytes are excluded: rest, go, and whether any byte is left there.
    """

    def __init__(self, strings: np.ndarray, counts: np.ndarray):
        self.strings, self.logs, self.contexts, self.numbers = [], [], [], []
        shorter = None
        for k in range(ORDER + 1):
            s, where = np.unique(_low(strings, k + 1), return_inverse=True)
            n = np.bincount(where, counts).astype(np.int64)
            c, of = np.unique(s >> _U(8), return_inverse=True)
            total, distinct = np.bincount(of, n), np.bincount(of).astype(np.int64)
            rest, go, some = np.zeros(len(c)), np.zeros(len(c)), np.zeros(len(c), bool)
            if k:
                ps, pn, pc, pt, pd = shorter
                parent = np.searchsorted(pc, _low(c, k - 1))
                taken = np.bincount(of, pn[np.searchsorted(ps, _low(s, k))])
                left = pd[parent] - distinct
                some = left > 0
                rest[some] = np.log2((pt[parent] - taken + left)[some])
                go[some] = rest[some] - np.log2(left[some])
            whole = np.log2(total + distinct)
            self.strings.append(s)
            self.logs.append(np.log2(n))
            self.contexts.append(c)
            self.numbers.append((whole, whole - np.log2(distinct), rest, go, some))
            shorter = (s, n, c, total, distinct)
        self.novel = float(np.log2(max(1, 256 - len(self.strings[0]))))

    def bits(self, wanted: np.ndarray) -> np.ndarray:
        """Code length of each string's last byte in the bytes before it."""
        out, open_, below = np.zeros(len(wanted)), np.ones(len(wanted), bool), np.zeros(len(wanted), bool)
        child = np.zeros(len(wanted), np.int64)
        for k in range(ORDER, -1, -1):
            at, there = _at(self.contexts[k], _low(wanted >> _U(8), k))
            s, seen = _at(self.strings[k], _low(wanted, k + 1))
            first = open_ & ~below & there
            whole, leave = self.numbers[k][:2]
            out += np.where(first & seen, whole[at] - self.logs[k][s], np.where(first, leave[at], 0.0))
            coded = first & seen
            if k < ORDER:
                rest, go, some = (x[child] for x in self.numbers[k + 1][2:])
                later = open_ & below & some
                out += np.where(later & seen, rest - self.logs[k][s], np.where(later, go, 0.0))
                coded |= later & seen
            open_ &= ~coded
            below |= there
            child = np.where(there, at, child)
        return out + np.where(open_, self.novel, 0.0)

    def strange(self) -> float:
        """Code length of a byte the language never has, after another such."""
        return float(self.numbers[0][1][0] + self.novel)


class Scorer:
    """Code lengths of texts in every language of a model."""

    def __init__(self, languages: list[str], strings: list[np.ndarray], counts: list[np.ndarray]):
        self.languages = languages
        self.trees = [Tree(s, n) for s, n in zip(strings, counts, strict=True)]
        self.strange = min((t.strange() for t in self.trees), default=0.0)
        self.shift = 64 - max(10, (CACHE_BYTES // (8 + 8 * max(1, len(languages)))).bit_length() - 1)
        self.keys = np.full(1 << (64 - self.shift), np.iinfo(np.uint64).max, np.uint64)
        self.rows = np.zeros((len(self.keys), len(languages)))

    def _coded(self, wanted: np.ndarray) -> np.ndarray:
        """A row of code lengths for each string."""
        place = ((wanted * _U(0x9E3779B97F4A7C15)) >> _U(self.shift)).astype(np.int64)
        out = self.rows[place]
        absent = np.flatnonzero(self.keys[place] != wanted)
        if len(absent):
            new, where = np.unique(wanted[absent], return_inverse=True)
            rows = np.stack([t.bits(new) for t in self.trees], axis=1)
            out[absent] = rows[where]
            # Of new strings that share a place any may have it: key and row go together.
            _, last = np.unique(place[absent], return_index=True)
            self.keys[place[absent][last]] = wanted[absent][last]
            self.rows[place[absent][last]] = out[absent[last]]
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths, a row for each text and a column for each language."""
        out = np.zeros((len(texts), len(self.languages)))
        parts: list[bytes] = []
        of: list[int] = []
        size = 0

        def add_up() -> None:
            nonlocal size
            if parts:
                sizes = np.array([len(p) for p in parts])
                ends = np.cumsum(sizes)
                rows = self._coded(grams(np.frombuffer(b"".join(parts), np.uint8)))
                # Behind each part's first ORDER bytes to its end; the joined bytes' own first ones made no string.
                cuts = np.stack([ends - sizes, ends - ORDER], axis=1).ravel()
                sums = np.add.reduceat(np.concatenate([rows, np.zeros((1, rows.shape[1]))]), cuts, axis=0)[::2]
                np.add.at(out, of, sums)
                parts.clear()
                of.clear()
                size = 0

        for i, text in enumerate(texts):
            for at in range(0, len(text), PART):
                before = text[at - ORDER : at] if at else _BEFORE
                parts.append(before + text[at : at + PART])
                of.append(i)
                size += len(parts[-1])
                if size >= PART:
                    add_up()
        add_up()
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Of each text the language, its share of the languages' joint probability, and its bits a byte."""
        fine = [bool(self.languages) and t is not None and any(map(str.isalpha, t)) for t in texts]
        raw = [t.encode("utf-8", "surrogatepass") for t, f in zip(texts, fine, strict=True) if f]
        found = iter([])
        if raw:
            bits = self.lengths(raw)
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(raw)), best]
            share = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1)
            found = iter([(self.languages[b], float(s), float(n / len(r))) for b, s, n, r in zip(best, share, least, raw, strict=True)])
        return [next(found) if f else (UNKNOWN, 0.0, 0.0) for f in fine]


def _counts(parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    strings, where = np.unique(np.concatenate(parts), return_inverse=True)
    return strings, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def fit(rows: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = MOST_ROWS, most_languages: int = MOST_LANGUAGES) -> dict:
    """Context statistics of the labelled rows' languages: {"languages": [...], "strings": [...], "counts": [...]}.

    From each language at most about most_rows rows, taken by a hash of id and language, whole
    texts each; rows without a language or text teach nothing. Where there are more than
    most_languages, those with the most rows are learnt (ties by code point). The statistics reach
    the driver as counts of strings of ORDER + 1 bytes, bounded by those rows and languages.
    """
    bounded_arrow(rows.sparkSession)
    draw = (F.xxhash64(rows[id_col].cast("string"), rows[lang_col]).cast("double") + 2.0**63) / 2.0**64
    labelled = rows.where(rows[lang_col].isNotNull() & rows[text_col].isNotNull())
    labelled = labelled.select(rows[lang_col].cast("string").alias("lang"), rows[text_col].cast("string").alias("text"), draw.alias("draw"))
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not sizes:
        return {"languages": [], "strings": [], "counts": []}
    share = F.lit(-1.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, most_rows / n)).otherwise(share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[list, list]] = {}
        waiting = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(_BEFORE + text.encode("utf-8", "surrogatepass"), np.uint8)
                for at in range(ORDER, len(raw), PART):
                    strings, n = np.unique(grams(raw[at - ORDER : at + PART]), return_counts=True)
                    kept = found.setdefault(lang, ([], []))
                    kept[0].append(strings)
                    kept[1].append(n)
                    waiting += len(strings)
                if waiting > 1 << 21:
                    found = {k: tuple([x] for x in _counts(*v)) for k, v in found.items()}
                    waiting = 0
        for lang, kept in found.items():
            strings, n = _counts(*kept)
            for at in range(0, len(strings), 100_000):
                part = slice(at, at + 100_000)
                yield pa.record_batch([pa.array([lang] * len(n[part])), pa.array(strings[part].astype(np.int64)), pa.array(n[part])], ["lang", "gram", "n"])

    sample = labelled.where(F.col("draw") < share).select("lang", "text")
    found = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, strings, counts = (found.column(c) for c in ("lang", "gram", "n"))
    names = sorted(set(lang.unique().to_pylist()))
    of = np.array([names.index(x) for x in lang.unique().to_pylist()], np.int64)[lang.combine_chunks().dictionary_encode().indices.to_numpy()] if names else np.zeros(0, np.int64)
    strings, counts = strings.to_numpy().astype(np.uint64), counts.to_numpy()
    return {"languages": names, "strings": [strings[of == k] for k in range(len(names))], "counts": [counts[of == k] for k in range(len(names))]}


def strangeness(model: dict) -> float:
    """Bits a byte that the model gives to bytes none of its languages has; 0 for a model without languages."""
    return Scorer(**model).strange if model["languages"] else 0.0


def identify(docs: DataFrame, model: dict, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out: tuple[str, str, str] = ("lang_pred", "score", "bits")) -> DataFrame:
    """The columns named in keep, and as out: language, score (0 to 1), bits a byte, for every row, in the scan's own tasks.

    UNKNOWN with score 0 if the text is null, empty or without a letter, or the model
    has no language; ties go to the first language by code point. Texts are read whole,
    repeated rows are judged each, an empty table gives an empty result. Names in out
    must not be in keep.
    """
    if set(keep) & set(out):
        raise ValueError(f"columns {sorted(set(keep) & set(out))} are both kept and made")
    spark = docs.sparkSession
    bounded_arrow(spark)
    shared = spark.sparkContext.broadcast(model)
    name, n = uuid.uuid4().hex, len(keep)
    rows = docs.select(*keep, docs[text_col].cast("string").alias("_langid_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("langid", name), lambda: Scorer(**shared.value))
        for batch in batches:
            found = scorer.predict(batch.column(n).to_pylist())
            made = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.record_batch([*batch.columns[:n], *made], [*keep, *out])

    return rows.mapInArrow(run, f"{kept}, {out[0]} string, {out[1]} double, {out[2]} double")


def held_out(doc_id: Column) -> Column:
    """One document in four, by its id: never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))
