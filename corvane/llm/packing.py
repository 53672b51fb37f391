"""Best-fit packing into sequences of several permitted lengths.

Pieces are dealt to shards by a hash and each shard is packed on its own. Longest
first, a piece goes to the open bin that it fills best. If none has room, a bin is
opened in the size that costs least per token, judged for all permitted sizes by
what the pieces still to come would fill it with. In the end each bin shrinks to
the smallest permitted size that holds its contents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, narrow
from corvane.llm.mixing import word_count

SIZES = (512, 1024, 2048, 4096)
#: Cost of a sequence besides its length, in tokens.
OVERHEAD = 48
SHARD_PIECES = 4096
#: Rows with the same identifier and length that are dealt out together.
COPIES = 64


class _Lengths:
    """A multiset of lengths; a bit per length present makes 'largest at most x' a shift."""

    def __init__(self) -> None:
        self.n: dict[int, int] = {}
        self.bits = 0

    def add(self, x: int) -> None:
        self.n[x] = self.n.get(x, 0) + 1
        self.bits |= 1 << x

    def drop(self, x: int) -> None:
        self.n[x] -= 1
        if not self.n[x]:
            self.bits &= ~(1 << x)

    def most(self, x: int) -> int:
        """The largest length that is at most x; -1 if there is none."""
        return (self.bits & (1 << x + 1) - 1).bit_length() - 1

    def least(self, x: int) -> int:
        """The smallest length that is at least x; -1 if there is none."""
        rest = self.bits >> x
        return x + (rest & -rest).bit_length() - 1 if rest else -1


def _filled(space: int, coming: _Lengths) -> int:
    """Tokens that the pieces to come would put into ``space``, largest first."""
    got, left, used = 0, space, {}
    x = coming.most(left)
    while x > 0:
        n = min(coming.n[x] - used.get(x, 0), left // x)
        if n > 0:
            used[x] = used.get(x, 0) + n
            got, left = got + n * x, left - n * x
        x = coming.most(min(left, x - 1)) if left else -1
    return got


def pack(lengths: Sequence[int], sizes: Sequence[int] = SIZES, overhead: int = OVERHEAD) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of each length, which must descend and be at most the largest size; size of each bin."""
    sizes = sorted(sizes)
    coming, room = _Lengths(), _Lengths()
    for x in lengths:
        coming.add(x)
    open_: dict[int, list[int]] = {}
    used: list[int] = []
    size: list[int] = []
    places = []
    for x in lengths:
        coming.drop(x)
        left = room.least(x)
        if left >= 0:
            b = open_[left].pop()
            room.drop(left)
        else:
            cost = {c: (c + overhead) / (x + _filled(c - x, coming)) for c in sizes if c >= x}
            b, c = len(size), min(cost, key=lambda c: (cost[c], c))
            size.append(c)
            used.append(0)
        places.append((b, used[b]))
        used[b] += x
        if rest := size[b] - used[b]:
            room.add(rest)
            open_.setdefault(rest, []).append(b)
    return places, [next(c for c in sizes if c >= n) for n in used]


OUT = "shard long, id {}, piece long, start long, length long, bin long, offset long, capacity long"


def _pack_shards(sizes: Sequence[int], overhead: int):
    def done(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        rows.sort(key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
        places, caps = pack([r[4] for r in rows], sizes, overhead)
        cols = [*zip(*rows, strict=True), [b for b, _ in places], [o for _, o in places], [caps[b] for b, _ in places]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = [], None
        for b in it:
            schema = pa.schema([*zip(b.schema.names[:-1], b.schema.types[:-1], strict=True), ("bin", pa.int64()), ("offset", pa.int64()), ("capacity", pa.int64())])
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield done(held, schema)
                    held = []
                held.extend([row[:-1]] * row[-1])
        if held:
            yield done(held, schema)

    return run


def best_fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | str | None = None, sizes: Sequence[int] = SIZES, overhead: int = OVERHEAD, seed: int = 3) -> DataFrame:
    """One row per piece: id, piece, start, length, shard, bin, offset, capacity.

    ``length`` is a document's length: a column of ``df`` by name, as the tokens of
    ``best_fit(token_counts(docs), length="n_tokens")``, or an expression over id
    and text; words by default. One more token ends the document. A document longer
    than the largest size is cut into pieces of that size. A sequence is a (shard,
    bin); ``offset`` is the piece's place in it. Defined cases: a null or empty
    text and a null or negative length are a piece of the end token alone; ids may
    be null or repeat, and rows with equal ids are packed as different documents;
    equal lengths go by id, then piece; an empty table gives no rows; other columns
    are ignored.

    Plan: texts are measured in the scan and not shuffled. Rows that share id and
    length give equal pieces, so they are counted first and dealt out COPIES at a
    time: a mass of rows without id or text is spread like any other. Two narrow
    shuffles, by (id, length) and into shards of about SHARD_PIECES pieces, however
    large a document is.
    """
    if isinstance(length, str):
        docs, length = narrow(df, *dict.fromkeys((id_col, length))), F.col(length)
    else:
        docs = narrow(df, *dict.fromkeys((id_col, text_col)))
        length = word_count(F.col(text_col)) if length is None else length
    store = Scratch(df.sparkSession, "packing")
    most, whole = max(sizes), lambda x: F.lit(x).cast("long")
    t = docs.select(F.col(id_col).alias("id"), (F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)) + 1).cast("long").alias("n"))
    t = t.groupBy("id", "n").agg(F.count(F.lit(1)).alias("m"))
    t = t.select("id", "n", "m", F.explode(F.sequence(whole(0), F.ceil(F.col("m") / COPIES) - 1)).alias("block"))
    t = t.select("id", "n", "block", F.least(whole(COPIES), F.col("m") - F.col("block") * COPIES).alias("m"), F.explode(F.sequence(whole(0), F.ceil(F.col("n") / most) - 1)).alias("piece"))
    start = F.col("piece") * most
    t = t.select(F.xxhash64(F.lit(seed), "id", "n", "block", "piece").alias("h"), "id", "piece", start.alias("start"), F.least(whole(most), F.col("n") - start).alias("length"), "m")
    t = store.table(t, "pieces")
    shards = max(1, -(-(t.agg(F.sum("m")).first()[0] or 0) // SHARD_PIECES))
    t = t.select(F.pmod("h", whole(shards)).alias("shard"), "id", "piece", "start", "length", "m")
    t = t.repartition("shard").sortWithinPartitions("shard").mapInArrow(_pack_shards(sizes, overhead), OUT.format(t.schema["id"].dataType.simpleString()))
    return t.select(F.col("id").alias(id_col), "piece", "start", "length", "shard", "bin", "offset", "capacity")
