"""Near-duplicates by MinHash over word shingles and banding."""

from __future__ import annotations

import bisect
import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.functions import text as T
from corvane.session import stored, unstore

PRIME = 4294967311

#: Words and documents of a chunk, shingles of all chunks in a range of their order, and shingles hashed at a time; they bound a task's memory, not the result.
CHUNK_WORDS, CHUNK_ROWS, RANGE_ROWS, HASH_ROWS = 1 << 20, 20_000, 1 << 20, 1 << 14

#: Blocks of documents whose sets are compared, at least, and bytes of all packed sets that a block stands for.
BLOCKS, BLOCK_BYTES = 10, 1 << 26


def hash_params(n: int) -> list[tuple[int, int]]:
    """Fixed coefficients (a, b) of n hash functions (a row + b) mod PRIME."""
    return [((1103515245 + 2 * i * 12345) % PRIME, (12345 + i * 2654435761) % PRIME) for i in range(n)]


def bands_of(n_hashes: int) -> tuple[int, int]:
    """(bands, rows): 25 bands from 25 hashes on, else a band each."""
    return (25, n_hashes // 25) if n_hashes >= 25 else (n_hashes, 1)


def shingle_table(docs: DataFrame, id_col: str, text_col: str, k: int = 2) -> DataFrame:
    """(doc_id, shingle), the characteristic matrix as a long table."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(T.shingles(F.col(text_col), k)).alias("shingle"))


def dictionary(shingles: DataFrame) -> DataFrame:
    """(shingle, row): places in the global order of distinct shingles, from 0.

    Ranges of the order are counted first, so rows are numbered within ranges
    and no task sees all shingles.
    """
    t = shingles.select("shingle").distinct().withColumn("__p", F.substring("shingle", 1, 3))
    before = t.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(W.partitionBy("__p").orderBy("shingle")) - 1
    return t.withColumn("__w", within).join(before, "__p").select("shingle", (F.col("__before") + F.col("__w")).cast("long").alias("row"))


def _pack(x: np.ndarray) -> bytes:
    """Ascending integers from 0 as compressed byte planes of their differences."""
    if not len(x):
        return b""
    d = np.diff(x, prepend=0)
    width = 4 if d.max() < 1 << 32 else 8
    return bytes([width]) + zlib.compress(d.astype(f"<u{width}").view(np.uint8).reshape(len(d), -1).T.tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(zlib.decompress(b[1:]), np.uint8).reshape(b[0], -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(f"<u{b[0]}").ravel().astype(np.int64))


def _lines(x: pa.Array) -> bytes:
    """Texts without line ends, joined without a Python object for each, behind their length."""
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(pa.binary())), b"\n")[0].as_buffer()
    return text.size.to_bytes(8, "little") + pa.Codec("zstd", 6).compress(text, asbytes=True)


def _unlines(b: bytes) -> pa.Array:
    text = pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True)
    return pc.split_pattern(pa.array([text.decode()], pa.large_string()), "\n").flatten()


def _numbered(lists: pa.ListArray, k: int) -> tuple[pa.Array, list[np.ndarray]]:
    """The sorted distinct k-shingles of lists of words, and each list's shingles as ascending places among them.

    Words hold no character below the blank, so shingles sort as their words do one by one.
    """
    flat, n = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = flat.dictionary_encode()
    by = pc.sort_indices(coded.dictionary).to_numpy(zero_copy_only=False)
    words, code = coded.dictionary.take(pa.array(by)), np.argsort(by)[coded.indices.to_numpy(zero_copy_only=False)] + 1
    count, first = np.where(n > 0, np.maximum(n - k + 1, 1), 0), np.cumsum(n) - n
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    end, base, most = (first + n)[doc], len(words) + 1, len(words) + 1
    place = lambda t, j, e: np.where(t + j < e, code[np.minimum(t + j, max(len(code) - 1, 0))] if len(code) else 0, 0)  # noqa: E731  0: no such word
    key = place(at, 0, end)
    for step in range(1, k):
        if most * base >= 1 << 62:
            seen, key = np.unique(key, return_inverse=True)
            most = len(seen)
        key, most = key * base + place(at, step, end), most * base
    coded = pa.array(key).dictionary_encode()
    by = np.argsort(coded.dictionary.to_numpy(zero_copy_only=False))
    key = np.argsort(by)[coded.indices.to_numpy(zero_copy_only=False)]
    where = np.zeros(len(by), np.int64)
    where[key] = np.arange(len(key))
    parts = [place(at[where], j, end[where]) for j in range(k)]
    texts = pc.binary_join_element_wise(*[words.take(pa.array(c - 1, mask=c == 0)) for c in parts], " ", null_handling="skip") if len(where) else pa.array([], pa.string())
    pairs = np.sort(doc * max(len(where), 1) + key)  # np.unique hashes integers, at many times the cost
    pairs = pairs[np.concatenate([np.ones(min(len(pairs), 1), bool), pairs[1:] != pairs[:-1]])]
    return texts, np.split(pairs % max(len(where), 1), np.searchsorted(pairs, np.arange(1, len(n)) * max(len(where), 1))) if len(n) else []


def _chunks(k: int, kind: pa.DataType, most_words: int, most_rows: int):
    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        texts, places = _numbered(t.column(1).chunk(0), k)
        n, step, chunk = t.num_rows, max(1, len(texts) // 64), uuid.uuid4().int >> 65
        yield pa.RecordBatch.from_arrays(
            [pa.array([False] * n + [True]), pa.array([chunk] * (n + 1), pa.int64()), pa.concat_arrays([t.column(0).chunk(0).cast(kind), pa.nulls(1, kind)]), pa.array([_pack(x) for x in places] + [None], pa.binary()),
             pa.array([None] * n + [len(texts)], pa.int64()), pa.array([None] * n + [_lines(texts)], pa.binary()), pa.array([None] * n + [texts.take(pa.array(np.arange(0, len(texts), step))).to_pylist()], pa.list_(pa.string()))],
            ["head", "chunk", "doc_id", "places", "n", "shingles", "marks"],
        )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, rows = [], 0, 0
        for whole in it:
            for i in range(0, whole.num_rows, min(500, most_rows)):
                b = whole.slice(i, min(500, most_rows))
                held, words, rows = [*held, b], words + len(b.column(1).flatten()), rows + b.num_rows
                if words >= most_words or rows >= most_rows:
                    yield from made(held)
                    held, words, rows = [], 0, 0
        if held:
            yield from made(held)

    return run


def _split(cuts: list[str]):
    """Sorted shingles to the ranges between ``cuts``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for chunk, blob, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not n:
                    continue
                x, at = _unlines(blob), [0]
                for c in cuts:
                    at.append(bisect.bisect_left(range(len(x)), c, at[-1], key=lambda i: x[i].as_py()))
                some = [(r, lo, hi) for r, (lo, hi) in enumerate(zip(at, [*at[1:], len(x)], strict=True)) if lo < hi]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in some], pa.int64()), pa.array([chunk] * len(some), pa.int64()), pa.array([_lines(x.slice(lo, hi - lo)) for _, lo, hi in some], pa.binary())], ["range", "chunk", "shingles"])

    return run


def _ranked(t: pa.Table) -> pa.Table:
    """Of one range: for each chunk the places of its shingles in the order of all distinct ones."""
    lists = [_unlines(b) for b in t.column("shingles").to_pylist()]
    coded = pa.concat_arrays(lists).dictionary_encode()
    place = np.argsort(pc.sort_indices(coded.dictionary).to_numpy(zero_copy_only=False))[coded.indices.to_numpy(zero_copy_only=False)]
    each = np.split(place, np.cumsum([len(x) for x in lists])[:-1])
    return pa.table({"range": t.column("range"), "chunk": t.column("chunk"), "n": pa.array([len(coded.dictionary)] * len(lists), pa.int64()), "places": pa.array([_pack(x) for x in each], pa.binary())})


def _least(row: np.ndarray, places: list[np.ndarray], n_hashes: int) -> np.ndarray:
    """For each document, of which ``places`` are those in ``row``, the least values of the hash functions; zeros for an empty one.

    Documents are taken some at a time, so that a function's values stay in the processor's cache.
    """
    out = np.zeros((len(places), n_hashes), np.int64)
    some = np.array([i for i, x in enumerate(places) if len(x)], np.int64)
    first = np.cumsum([0, *(len(places[i]) for i in some)])
    lo = 0
    while lo < len(some):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + HASH_ROWS, "right")) - 1)
        x, at = row[np.concatenate([places[i] for i in some[lo:hi]])], first[lo:hi] - first[lo]
        for i, (a, b) in enumerate(hash_params(n_hashes)):
            v = a * x + b
            v -= v // PRIME * PRIME
            out[some[lo:hi], i] = np.minimum.reduceat(v, at)
        lo = hi
    return out


def profiles(docs: DataFrame, id_col: str, text_col: str, n_hashes: int = 100, k: int = 2, with_rows: bool = True) -> DataFrame:
    """(doc_id, hashes, rows): the signature, and the document's rows of ``dictionary`` packed for ``packed_jaccard``; without ``with_rows`` (doc_id, hashes).

    Documents are cut into chunks, and each chunk sends each of its shingles once, in
    compressed sorted lists, to the range of the order that numbers it. What comes
    back are the numbers, so a shingle's text never travels with its documents. The
    result is written; what led to it is deleted, the shingles' texts once they are numbered.
    """
    kind = docs.schema[id_col].dataType
    t = docs.select(F.col(id_col).alias("doc_id"), T.words(F.col(text_col)).alias("w"))
    made = stored(t.mapInArrow(_chunks(k, to_arrow_type(kind), CHUNK_WORDS, CHUNK_ROWS), f"head boolean, chunk long, doc_id {kind.simpleString()}, places binary, n long, shingles binary, marks array<string>"), "head")
    heads = made.where("head")
    n = heads.agg(F.sum("n")).first()[0] or 0
    marks = sorted(r[0] for r in heads.select(F.explode("marks").alias("m")).orderBy(F.xxhash64("m"), "m").limit(20_000).collect())
    ranges = max(1, -(-n // RANGE_ROWS))
    cuts = sorted({marks[i * len(marks) // ranges] for i in range(1, ranges)} if marks else ())
    split = heads.select("chunk", "shingles", "n").mapInArrow(_split(cuts), "range long, chunk long, shingles binary")
    numbers = stored(split.groupBy("range").applyInArrow(_ranked, "range long, chunk long, n long, places binary"))
    unstore(made, "head=true")
    before, so_far = {}, 0
    for r in numbers.groupBy("range").agg(F.max("n").alias("n")).orderBy("range").collect():
        before[r["range"]], so_far = so_far, so_far + r["n"]

    def least(mine: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("range")
        row = np.concatenate([np.zeros(0, np.int64), *[_unpack(b) + before[r] for r, b in zip(found.column("range").to_pylist(), found.column("places").to_pylist(), strict=True)]])
        places = [_unpack(b) for b in mine.column("places").to_pylist()]
        hashes = pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1) * n_hashes, pa.int32()), pa.array(_least(row, places, n_hashes).ravel()))
        out = pa.table({"doc_id": mine.column("doc_id"), "hashes": hashes})
        return out.append_column("rows", pa.array([_pack(row[x]) for x in places], pa.binary())) if with_rows else out

    mine = made.where("not head").select("chunk", "doc_id", "places")
    out = stored(mine.groupBy("chunk").cogroup(numbers.select("chunk", "range", "places").groupBy("chunk")).applyInArrow(least, f"doc_id {kind.simpleString()}, hashes array<long>" + ", rows binary" * with_rows), compression="zstd")
    for t in (made, numbers):
        unstore(t)
    return out


@functools.cache
def _jaccard_udf():
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            x, y = _unpack(x), _unpack(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0)
        return pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")


def packed_jaccard(a: Column, b: Column) -> Column:
    """Of two documents' ``rows`` as sets; 1 for two empty ones."""
    return _jaccard_udf()(F.coalesce(a, F.lit(b"")), F.coalesce(b, F.lit(b"")))


def signatures(docs: DataFrame, id_col: str, text_col: str, n_hashes: int = 100, k: int = 2) -> DataFrame:
    """(doc_id, hashes): minima over the document's rows; zeros for a document without words."""
    return profiles(docs, id_col, text_col, n_hashes, k, with_rows=False)


def buckets(sigs: DataFrame, n_bands: int, rows: int) -> DataFrame:
    """(doc_id, band, bucket): the checksum of the band's hashes as a printed tuple; a last band may be shorter."""
    def printed(i: int):
        part = F.slice("hashes", i * rows + 1, rows)
        return F.concat(F.lit(f"({i}, ("), F.array_join(F.transform(part, lambda x: x.cast("string")), ", "), F.when(F.size(part) == 1, F.lit(",))")).otherwise(F.lit("))")))

    each = [F.struct(F.lit(i).alias("band"), F.concat(F.lit(f"{i}:"), F.crc32(F.encode(printed(i), "UTF-8")).cast("string")).alias("bucket")) for i in range(n_bands)]
    return sigs.select("doc_id", F.inline(F.array(*each)))


def band_pairs(sigs: DataFrame, n_bands: int, rows: int) -> DataFrame:
    """(a, b, n_shared_bands) of documents that share a band, a < b.

    Documents with the same whole signature are joined through the least of them
    and expanded at the end, so band buckets hold distinct signatures only.
    """
    groups = stored(sigs.groupBy("hashes").agg(F.min("doc_id").alias("rep"), F.collect_list("doc_id").alias("docs")))
    key = F.inline(F.array(*[F.struct(F.lit(i).alias("band"), F.slice("hashes", i * rows + 1, rows).alias("part")) for i in range(n_bands)]))
    shared = groups.select("rep", key).groupBy("band", "part").agg(F.collect_list("rep").alias("reps")).where(F.size("reps") > 1)
    b = stored(shared.select("band", "part", F.explode("reps").alias("rep")))
    pairs = b.join(b.withColumnRenamed("rep", "rep2"), ["band", "part"]).where("rep < rep2").groupBy("rep", "rep2").agg(F.count(F.lit(1)).alias("n_shared_bands"))
    pairs = pairs.unionByName(groups.where(F.size("docs") > 1).select("rep", F.col("rep").alias("rep2"), F.lit(n_bands).cast("long").alias("n_shared_bands")))
    members = groups.select("rep", F.explode("docs").alias("doc_id"))
    t = pairs.join(members.select(F.col("doc_id").alias("x"), "rep"), "rep").join(members.select(F.col("doc_id").alias("y"), F.col("rep").alias("rep2")), "rep2").where("rep <> rep2 or x < y")
    return t.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n_shared_bands")


def _of(t: DataFrame, pairs: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Rows of ``t`` whose doc_id is in a pair; up to ``most`` identifiers are sent to the rows, more are joined."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    return t.join(F.broadcast(ids) if ids.count() <= most else ids, "doc_id", "left_semi")


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, n_hashes: int = 100, least: float = 0.0, k: int = 2) -> DataFrame:
    """(a, b, n_shared_bands, jaccard) of candidate pairs whose shingles' Jaccard similarity is at least ``least``."""
    bands, rows = bands_of(n_hashes)
    t = profiles(docs, id_col, text_col, n_hashes, k)
    pairs = stored(band_pairs(t.select("doc_id", "hashes"), bands, rows))
    s = _of(t.select("doc_id", "rows"), pairs)
    t = pairs.join(s.select(F.col("doc_id").alias("a"), F.col("rows").alias("sa")), "a").join(s.select(F.col("doc_id").alias("b"), F.col("rows").alias("sb")), "b")
    return t.select("a", "b", "n_shared_bands", packed_jaccard(F.col("sa"), F.col("sb")).alias("jaccard")).where(F.col("jaccard") >= least)


def _overlap(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets; 1 for two empty ones."""
    both = np.concatenate((x, y))
    both.sort()
    n = int(np.count_nonzero(both[1:] == both[:-1]))
    return n / (len(both) - n) if len(both) else 1.0


def _sketch(x: np.ndarray) -> bytes:
    """The size of a set and, at four bits an element or more, which values a hash of its elements takes."""
    m = max(256, 1 << (4 * len(x) - 1).bit_length()) if len(x) else 8
    bits = np.zeros(m, np.uint8)
    bits[((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & (m - 1)] = 1
    return len(x).to_bytes(8, "little") + np.packbits(bits, bitorder="little").tobytes()


def _read_sketch(b: bytes) -> tuple[int, int, int]:
    return (int.from_bytes(b[:8], "little"), int.from_bytes(b[8:], "little"), 8 * len(b) - 64) if b else (0, 0, 8)


def _most_overlap(x: tuple[int, int, int], y: tuple[int, int, int]) -> float:
    """What the Jaccard similarity of two sets can be at most: a value that only one of them takes is an element that the other lacks."""
    (n, u, m), (k, v, w) = x, y
    if not n or not k:
        return float(n == k)
    while m > w:
        m //= 2
        u = (u | u >> m) & ((1 << m) - 1)
    while w > m:
        w //= 2
        v = (v | v >> w) & ((1 << w) - 1)
    same = (u & v).bit_count()
    both = min(n - u.bit_count(), k - v.bit_count()) + same
    return both / (n + k - both)


def _sketches(rows: pa.Array) -> pa.Array:
    made = [_sketch(_unpack(b or b"")) for b in rows.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([int.from_bytes(b[:8], "little") for b in made], pa.int64()), pa.array(made, pa.binary())], ["n", "sketch"])


def _compared(pairs: DataFrame, sets: DataFrame, blocks: int, read, value) -> DataFrame:
    """``pairs`` (a, b, c and others) with ``v``, the ``value`` of what ``read`` makes of the sets (doc_id, set) of a and c; nothing for an ``a`` without a set.

    Documents fall into blocks by a hash, and two blocks meet in a task that gets
    each set once, however many pairs it is in. A set goes to at most as many
    tasks as there are blocks, and to no more than it has pairs.
    """
    at = [F.pmod(F.xxhash64(F.col(x).cast("long")), F.lit(blocks)) for x in "ac"]
    t = pairs.withColumn("cell", F.least(*at) * blocks + F.greatest(*at))
    ids = t.select(F.col("cell").alias("at"), F.explode(F.array(F.col("a").cast("long"), F.col("c").cast("long"))).alias("doc_id")).distinct()
    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in pairs.schema) + ", v double"

    def run(mine: pa.Table, found: pa.Table) -> pa.Table:
        of: dict[int, list] = {}
        for d, x in zip(found.column("doc_id").to_pylist(), found.column("set").to_pylist(), strict=True):
            of.setdefault(d, []).append(read(x or b""))
        none = [read(b"")]
        v = [max((value(x, y) for x in of.get(a, ()) for y in of.get(c, none)), default=None) for a, c in zip(mine.column("a").to_pylist(), mine.column("c").to_pylist(), strict=True)]
        t = mine.drop_columns(["cell"]).append_column("v", pa.array(v, pa.float64()))
        return t.filter(pc.is_valid(t.column("v")))

    return t.groupBy("cell").cogroup(ids.join(sets.select(F.col("doc_id").cast("long").alias("doc_id"), "set"), "doc_id").groupBy("at")).applyInArrow(run, schema)


def quality(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, against: int = 5, k: int = 2, rows: DataFrame | None = None, most: int = 1_000_000) -> DataFrame:
    """One row: pairs, and the share whose Jaccard beats that of ``a`` with each of ``against`` other documents.

    The others are drawn by a hash of the pair, the same on each run, so no
    generator state is needed; a document that isn't there is drawn as empty.
    ``rows`` are those of ``profiles``, where they are there already.

    A draw counts if it is as similar as the pair's own document. Sizes of sets rule
    out most draws and sketches most others, both exactly; sets are compared for the
    pairs and for the draws that are left. Sizes of up to ``most`` documents are sent to the pairs, more are joined.
    """
    s = (profiles(docs, id_col, text_col, 1, k) if rows is None else rows).select("doc_id", "rows")
    n = s.agg(F.min("doc_id").alias("lo"), (F.max("doc_id") - F.min("doc_id") + 1).alias("n"), F.sum(F.length("rows")).alias("bytes"), F.count(F.lit(1)).alias("docs")).first()
    blocks = max(BLOCKS, -(-(n["bytes"] or 0) // BLOCK_BYTES))
    sets = s.select("doc_id", F.col("rows").alias("set"))
    p = stored(pairs.select("a", "b", F.col("b").cast("long").alias("c")).distinct())
    own = stored(_compared(p, _of(sets, p, most), blocks, _unpack, _overlap).select("a", "b", F.col("v").alias("j")))
    sketched = stored(s.select("doc_id", F.arrow_udf(_sketches, "n long, sketch binary")("rows").alias("s")).select("doc_id", "s.n", F.col("s.sketch").alias("set")))
    sizes = sketched.select(F.col("doc_id").cast("long").alias("doc_id"), "n")
    sizes = F.broadcast(sizes) if n["docs"] <= most else sizes
    t = own.join(sizes.select(F.col("doc_id").alias("a_"), F.col("n").alias("na")), F.col("a").cast("long") == F.col("a_")).drop("a_")
    t = t.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(against))))
    t = t.select("a", "b", "j", "na", (F.pmod(F.xxhash64("a", "b", "i"), F.lit(n["n"] or 1)) + (n["lo"] or 0)).cast("long").alias("c"))
    t = t.where(~F.col("c").eqNullSafe(F.col("a").cast("long")) & ~F.col("c").eqNullSafe(F.col("b").cast("long")))
    t = t.join(sizes.select(F.col("doc_id").alias("c"), "n"), "c", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    t = t.where(F.when(F.greatest("n", "na") > 0, F.least("n", "na") / F.greatest("n", "na")).otherwise(F.lit(1.0)) >= F.col("j"))
    t = stored(t.select("a", "b", "c", "j"))
    t = stored(_compared(t, sketched, blocks, _read_sketch, _most_overlap).where("v >= j").drop("v"))
    lost = _compared(t, sets, blocks, _unpack, _overlap).where("v >= j").select("a", "b").distinct().agg(F.count(F.lit(1)).alias("lost"))
    return own.agg(F.count(F.lit(1)).alias("pairs")).crossJoin(lost).select("pairs", F.when(F.col("pairs") > 0, (F.col("pairs") - F.col("lost")) / F.col("pairs")).alias("quality"))
