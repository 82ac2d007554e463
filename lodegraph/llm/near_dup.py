"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document is the set of its distinct shingles of words. Its sketch has one
coordinate for each bin: in each of the first rounds a shingle is hashed to a bin and
a value, and in as many rounds again every shingle goes to the round's own bin, so
that every coordinate fills; a coordinate keeps the least (round, value) it got. Once
all are filled, later rounds can't change any, so a document stops there: after about one
round where shingles outnumber the bins. Bands of coordinates bring candidates
together, and a candidate pair is a link only if its full sets say so.

Documents of equal sets are one class; classes, not documents, are compared. In a
band's bucket all classes are first held against one pivot of it, the class with the
most company over all bands, then against a second one. Components of the links so far
are formed after each, and only classes of one bucket that are still in different
components are compared further: in small buckets as pairs, in large ones in blocks
of bounded size that return a forest of the links found and no pairs. So a bucket of
many near copies costs a comparison each, and no candidate pair that could join two
components is left out.

Before full sets move, pairs are held to their sketches: where fewer coordinates
agree than six standard deviations below the threshold's expectation, the pair can't be a link but
once in a thousand million, as with the bands themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import GOLDEN, bounded_arrow, bytes_of, components, discard, hashed_words, let_go, mix, parts, release, settle

#: Classes of a bucket that are compared as pairs at most, and of either side of a block, and shingles of these.
PAIRED, BLOCK, BLOCK_ITEMS = 12, 1024, 1 << 20
#: Bits of the map of ids whose sets are wanted: eight for each, from 8 to 64 MB. It saves moving sets; what it lets through is joined exactly.
LEAST_BITS, MOST_BITS = 26, 29
#: 32 bands of 6 coordinates miss a pair of similarity 0.85 once in 4 million, one of 0.8 once in 17 thousand.
BANDS, ROWS = 32, 6

_MIX2 = np.uint64(0x94D049BB133111EB)
_U = np.uint64
#: Space, tab, line feed, vertical tab, form feed, carriage return.
_SPACE = bytes_of(0x20, *range(0x09, 0x0E))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z in lower case, in order."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    found = [hashed_words(np.frombuffer(part, np.uint8), _SPACE)[2] for part in parts(raw, _SPACE)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of so many words; with fewer words one of all; none without words."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    k = min(size, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * _U(GOLDEN) + words[i : len(words) - k + 1 + i])
    return np.unique(out)


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F))


def sketch(items: np.ndarray, bins: int) -> np.ndarray:
    """One coordinate for each bin: round in the upper, value in the lower bits; items must not be empty."""
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    seeds, n = _seeds(2 * bins), len(items)
    step = max(1, 4 * bins // n)  # small sets take several rounds at a time
    for r in range(0, bins, step):
        rounds = np.arange(r, min(r + step, bins))
        h = mix(items[None, :] ^ seeds[rounds][:, None])
        where = ((h >> _U(40)) * _U(bins)) >> _U(24)
        value = (rounds.astype(np.uint64)[:, None] << _U(40)) | (h & _U((1 << 40) - 1))
        np.minimum.at(out, where.ravel().astype(np.int64), value.ravel())
        if out.max() < np.iinfo(np.uint64).max:
            return out
    for b in np.flatnonzero(out == np.iinfo(np.uint64).max):  # rounds in which all go to bin b
        out[b] = (_U(bins + b) << _U(40)) | (mix(items ^ seeds[bins + b]) & _U((1 << 40) - 1)).min()
    return out


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band."""
    table = coordinates.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _U(GOLDEN)
    for i in range(rows):
        key = mix(key ^ table[:, i] * _MIX2)
    return key


def _signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, tag, n, fp1, fp2, keys, sketch) of each row; fp1 and fp2 are a 128-bit digest of the set, sketch one byte of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        let_go()
        for batch in batches:
            n, fp1, fp2, keys, low = [], [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), size)
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                fp1.append(int.from_bytes(d[:8], "big", signed=True))
                fp2.append(int.from_bytes(d[8:], "big", signed=True))
                coordinates = sketch(s, bands * rows) if len(s) else np.zeros(0, np.uint64)
                keys.append(band_keys(coordinates, bands, rows).view(np.int64) if len(s) else np.zeros(0, np.int64))
                low.append(coordinates.astype(np.uint8).tobytes())
            whole = [pa.array(c, pa.int64()) for c in (n, fp1, fp2)]
            made = [batch.column(0), batch.column(2), *whole, pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary())]
            yield pa.record_batch(made, ["doc_id", "tag", "n", "fp1", "fp2", "keys", "sketch"])

    return docs.select("doc_id", "text", "tag").mapInArrow(run, "doc_id bigint, tag bigint, n bigint, fp1 bigint, fp2 bigint, keys array<bigint>, sketch binary")


def _wanted_map(ids: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hash of an id that is wanted; of bounded size, so it may be broadcast whatever the number of ids."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    buckets = ids.select(place.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("k"))
    rows = buckets.agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m")).collect()
    # Buckets of 32768 bits count from 1, their values from (k - 1) * 32768 + 1.
    out = np.zeros((1 << bits) // 8 + 8192, np.uint8)
    for r in rows:
        out[(r.k) * 4096 : (r.k + 1) * 4096] = np.frombuffer(r.m, np.uint8)
    return out


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, items) of the wanted classes: (node, doc_id, fp1, fp2). Texts stay in the scan's tasks; only wanted sets move."""
    import xxhash  # noqa: F401  (its absence should show here)

    bits = min(MOST_BITS, max(LEAST_BITS, (8 * wanted.count()).bit_length()))
    mask = docs.sparkSession.sparkContext.broadcast(_wanted_map(wanted, bits))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    rows = docs.select("text", F.bitmap_bucket_number(place).alias("k"), F.bitmap_bit_position(place).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        let_go()
        for batch in batches:
            k, b = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            asked = np.flatnonzero(mask.value[k * 4096 + (b >> 3)] >> (b & 7).astype(np.uint8) & 1)
            fp1, fp2, items = [], [], []
            for i in asked.tolist():
                s = shingles(batch.column(0)[i].as_py(), size)
                d = xxhash.xxh3_128_digest(s.tobytes())
                fp1.append(int.from_bytes(d[:8], "big", signed=True))
                fp2.append(int.from_bytes(d[8:], "big", signed=True))
                items.append(s.view(np.int64))
            yield pa.record_batch([pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), pa.array(items, pa.list_(pa.int64()))], ["fp1", "fp2", "items"])

    made = rows.mapInArrow(run, "fp1 bigint, fp2 bigint, items array<bigint>")
    return made.join(wanted.select("node", "fp1", "fp2"), ["fp1", "fp2"]).select("node", "items")


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int, coordinates: int) -> DataFrame:
    """Distinct pairs (a, b) whose sketches don't rule the link out."""
    least = percent / 100 * coordinates - 6 * (percent / 100 * (1 - percent / 100) * coordinates) ** 0.5
    left, right = sketches.toDF("a", "x"), sketches.toDF("b", "y")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, coordinates) for c in (2, 3))
                keep = np.flatnonzero((x == y).sum(axis=1) >= least)
                yield pa.record_batch([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], ["a", "b"])

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(agree, "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among pairs (a, b): percent of the union, at least, in common."""
    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("x", "y")).cast("bigint").alias("i"), (F.size("x") + F.size("y")).cast("bigint").alias("s"))
    return both.where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.col("s") - F.col("i"))).select("a", "b")


def common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of x with each of y, from a product of incidence matrices, some columns at a time."""
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    items = np.concatenate([*x, *y])
    rows = np.concatenate([np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)])
    left = np.arange(len(items)) < nx.sum()
    _, column, times = np.unique(items, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # the others are in one set only
    rows, left, column = rows[shared], left[shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((len(x), len(y)), np.float32)
    wide = int(column.max(initial=-1)) + 1
    for at in range(0, wide, 4096):
        here = (column >= at) & (column < at + 4096)
        a, b = np.zeros((len(x), 4096), np.float32), np.zeros((len(y), 4096), np.float32)
        a[rows[here & left], column[here & left] - at] = 1
        b[rows[here & ~left], column[here & ~left] - at] = 1
        out += a @ b.T
    return out


def _block(percent: int):
    """The links of two parts of a bucket as a forest: (a, b)."""
    from lodegraph.llm.vector_dup import forest

    def join(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            a, b = left.column(0).to_numpy(), right.column(0).to_numpy()
            x, y = ([np.asarray(v.values) for v in t.column(1)] for t in (left, right))
            na, nb = np.array([len(v) for v in x]), np.array([len(v) for v in y])
            both = common(x, y).astype(np.int64)
            linked = (100 * both >= percent * (na[:, None] + nb[None, :] - both)) & (a[:, None] != b[None, :])
            linked &= left.column(2).to_numpy()[:, None] != right.column(2).to_numpy()[None, :]
            out = forest(linked, a, b)
        return pa.table([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], ["a", "b"])

    return join


def _in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of different components c within each bucket: (key, node, c, m members of t shingles)."""
    many = F.expr(f"cast(greatest(ceil(m / {BLOCK}), ceil(t / {BLOCK_ITEMS})) as int)")
    placed = members.withColumn("parts", many).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    placed = placed.join(sets, "node").select("key", "node", "items", "c", "part", "parts")
    left = placed.withColumn("other", F.explode(F.sequence(F.col("part"), F.col("parts") - 1))).select("node", "items", "c", "key", F.col("part").alias("i"), F.col("other").alias("j"))
    right = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("part")))).select(*(F.col(c).alias(f"r_{c}") for c in ("node", "items", "c", "key")), F.col("other").alias("r_i"), F.col("part").alias("r_j"))
    return left.groupBy("key", "i", "j").cogroup(right.groupBy("r_key", "r_i", "r_j")).applyInArrow(_block(percent), "a bigint, b bigint")


def _nodes(signed: DataFrame) -> DataFrame:
    """(node, rep, n, fp1, fp2) of every class: rows of equal sets, rep their least id, node the number it is compared under.

    The node is rep itself; only where an id repeats with another set, or a class has no id,
    it is made from the set's digest, below all ids above -2^62.
    """
    classes = signed.where("n > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    classes = settle(classes, "near-classes")
    shared = classes.where("rep is not null").groupBy(F.col("rep").alias("shared")).agg(F.count("*").alias("times")).where("times > 1")
    made = F.lit(-(1 << 63)) + F.xxhash64("fp1", "fp2").bitwiseAND(F.lit((1 << 62) - 1))
    named = classes.where("rep is not null").join(shared, F.col("rep") == F.col("shared"), "left").withColumn("node", F.when(F.col("times").isNull(), F.col("rep")).otherwise(made))
    return named.select("node", "rep", "n", "fp1", "fp2").unionByName(classes.where("rep is null").select(made.alias("node"), "rep", "n", "fp1", "fp2"))


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, pivots: int = 2) -> DataFrame:
    """(doc_id, tag, n, component, least) for every row: tag is xxhash64 of the text, n the size of its set,
    component the number of its group of near duplicates and least the least id in it (null if it has none); both null where n is 0.
    """
    spark = docs.sparkSession
    bounded_arrow(spark)
    text = docs[text_col].cast("string")
    source = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"))
    signed = settle(_signatures(source, shingle, bands, rows), "near-signatures")
    plain = signed.select("doc_id", "tag", "n", "fp1", "fp2")
    classes = settle(_nodes(plain), "near-nodes")
    # One row's keys and sketch stand for a class: its least id's, or any of those without an id.
    named = classes.where("rep is not null").select("node", "rep", F.col("fp1").alias("f1"), F.col("fp2").alias("f2"))
    first = signed.join(named, F.col("doc_id") == F.col("rep")).where("fp1 = f1 and fp2 = f2").select("node", "doc_id", "n", "fp1", "fp2", "keys", "sketch")
    nameless = signed.where("doc_id is null and n > 0").join(classes.where("rep is null").select("node", "fp1", "fp2"), ["fp1", "fp2"])
    nameless = nameless.groupBy("node", "doc_id", "n", "fp1", "fp2").agg(F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    first = first.unionByName(nameless)
    buckets = first.select("node", "n", F.explode("keys").alias("key"))
    often = buckets.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = buckets.join(often, "key").distinct()
    company = members.groupBy("node").agg(F.sum("m").alias("company"))
    members = settle(members.join(company, "node").select("key", "node", "n", "company"), "near-members")
    met = first.select("node", "doc_id", "fp1", "fp2", "sketch").join(company.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sketches = settle(met, "near-sketches")
    sets = settle(_sets(source, sketches.select("node", "doc_id", "fp1", "fp2"), shingle).dropDuplicates(["node"]), "near-sets")

    links, joined, spent = None, None, [sketches, sets]
    sketches = sketches.select("node", "sketch")
    for step in range(pivots + 1):
        release(spark)
        over = [members] if joined is None else [members, joined]  # what this step is the last to read
        if joined is None:
            now = members.withColumn("c", F.col("node"))
        else:
            found = joined.select(F.col("node").alias("of"), "component")
            now = members.join(found, F.col("node") == F.col("of"), "left").withColumn("c", F.coalesce("component", "node")).drop("of", "component")
        top = F.max(F.struct("company", F.negative("node").alias("p"), "n", "c")).alias("top")
        open_ = now.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("t"), F.min("c").alias("c0"), F.max("c").alias("c1"), top).where("c0 <> c1")
        if step < pivots:
            tried = open_.select("key", F.negative("top.p").alias("pivot"), F.col("top.n").alias("pn"), F.col("top.c").alias("pc"))
            pairs = now.join(tried, "key").where(F.col("c") != F.col("pc")).select("node", "n", F.col("pivot").alias("other"), F.col("pn").alias("on"))
            # A pivot has met its bucket: the next one is another class.
            members = settle(members.join(tried.select("key", "pivot"), "key", "left").where("pivot is null or pivot <> node").drop("pivot"), "near-members")
        else:
            left = settle(now.join(open_.select("key", "m", "t"), "key").select("key", "node", "n", "c", "m", "t"), "near-open")
            over.append(left)
            here = left.where(F.col("m") <= PAIRED).drop("m", "t")
            there = here.select("key", F.col("node").alias("other"), F.col("n").alias("on"), F.col("c").alias("oc"))
            pairs = here.join(there, "key").where("node < other and c <> oc").select("node", "n", "other", "on")
        sized = pairs.where(F.lit(100) * F.least("n", "on") >= F.lit(percent) * F.greatest("n", "on"))
        pairs = sized.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        found = _verified(_likely(pairs, sketches, percent, bands * rows), sets, percent)
        if step == pivots:
            found = found.unionByName(_in_blocks(left.where(F.col("m") > PAIRED), sets, percent))
        found = settle(found, "near-links")
        links = found if links is None else links.unionByName(found)
        spent.append(found)
        joined = components(links, "a", "b")
        discard(*over)
    discard(*spent)  # what follows reads signatures, nodes and the last components

    known = classes.join(joined.select(F.col("node").alias("of"), "component"), F.col("node") == F.col("of"), "left")
    known = known.select("fp1", "fp2", "rep", F.coalesce("component", "node").alias("component"))
    least = known.groupBy(F.col("component").alias("of")).agg(F.min("rep").alias("least"))
    known = known.join(least, F.col("component") == F.col("of")).select("fp1", "fp2", "component", "least")
    return plain.join(known, ["fp1", "fp2"], "left").select("doc_id", "tag", "n", "component", "least")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row.

    Rows are linked whose sets have 100 * intersection >= percent * union; component_id is
    the least id reachable over links, kept whether it is the row's own. A null or empty
    text, or one of white space, has no shingles and is linked with nothing; rows of equal
    sets are in one class. Rows that repeat an id are judged each by its own text. A null id stays null,
    has its group's component (null if that has no id) and isn't kept. An empty table gives an empty
    result. Other columns are not read. Shingles are held as 64-bit hashes. how: near_groups' parameters.
    """
    found = near_groups(docs, id_col=id_col, text_col=text_col, **how)
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(False))
    return found.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs without near duplicates: of each group the row of the least id (null ids last; of rows that share it, the least hash).

    Rows without a word are duplicates of nothing and stay. Of rows that share id and text one stays, the one of the least hash
    of all its columns. Whole rows are shuffled once, when they meet the ids that stay.
    """
    found = near_groups(docs, id_col=id_col, text_col=text_col, **how)
    first = found.where("n > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tag")).alias("k"))
    stay = first.select(F.coalesce("k.doc_id", F.lit(0)).alias("_stay"), F.xxhash64("k.nameless", "k.tag").alias("_tag"))
    text, cols = docs[text_col].cast("string"), docs.columns
    key = F.coalesce(docs[id_col].cast("bigint"), F.lit(0))
    rows = docs.select(F.struct(*cols).alias("_row"), key.alias("_key"), F.xxhash64(docs[id_col].isNull(), F.xxhash64(text)).alias("_hash"), F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("_worded"))
    met = rows.where("_worded").join(stay, (F.col("_key") == F.col("_stay")) & (F.col("_hash") == F.col("_tag")), "left_semi")
    met = met.groupBy("_key", "_hash").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return met.select("_row.*").unionByName(rows.where("not _worded").select("_row.*"))


#: Exact sets and all pairs that share a shingle, for tables that DuckDB can hold that way.
SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM worded),
spread AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM shingled),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM spread a JOIN spread b ON a.item = b.item AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS got FROM documents UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.got),
least AS (SELECT node, min(got) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept FROM shingled s JOIN least l ON l.node = s.doc_id
"""
