"""SimHash fingerprints in DataFrame functions, and a search by permuted block tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import SPACE, narrow

BUCKET_ROWS = 2_000
#: Buckets of neighbouring identifiers; their heads are broadcast, so this bounds that broadcast's rows.
MAX_BUCKETS = 20_000
_PAIR = 0x100000001  # bits j and j + 32 of a hash, as two 32-bit lanes of one long


def votes(terms_: DataFrame, keys: list[str], weight: Column, hashes: list[Column]) -> DataFrame:
    """``keys`` and one long per 64 bits: bit j is set if terms of over half of the weight have it set.

    Two bits share a sum: 32-bit lanes hold the weights of up to 2^32 a text,
    more than a string can hold.
    """
    sums = [F.sum(weight * F.shiftright(h, j).bitwiseAND(F.lit(_PAIR))).alias(f"__s{i}_{j}") for i, h in enumerate(hashes) for j in range(32)]
    t = terms_.groupBy(*keys).agg(F.sum(weight).alias("__w"), *sums)

    def word(i: int) -> Column:
        bits = []
        for j in range(32):
            s = F.col(f"__s{i}_{j}")
            bits.append(F.when(2 * s.bitwiseAND(F.lit(0xFFFFFFFF)) > F.col("__w"), F.lit(1 << j)).otherwise(F.lit(0)))
            high = 1 << (j + 32)
            bits.append(F.when(2 * F.shiftrightunsigned(s, 32) > F.col("__w"), F.lit(high if j < 31 else high - (1 << 64))).otherwise(F.lit(0)))
        return F.coalesce(_or(bits), F.lit(0)).cast("long")

    return t.select(*keys, *[word(i).alias(f"f{i}") for i in range(len(hashes))])


def _or(cols: list[Column]) -> Column:
    while len(cols) > 1:
        cols = [a.bitwiseOR(b) for a, b in zip(cols[::2], cols[1::2], strict=False)] + (cols[-1:] if len(cols) % 2 else [])
    return cols[0]


def fingerprints(docs: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """``keys`` and the two halves f0, f1 of a 128-bit fingerprint of ``text``; ``keys`` must tell texts apart.

    A term is a pair of neighbouring words (the last word also alone), lower-cased.
    It votes with a weight of 1 to 4 by its length, as pairs of short words are
    mostly function words, once for each occurrence.
    """
    w = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACE, " ")), " ")
    t = docs.select(*keys, w.alias("__words"))
    n = F.greatest(F.size("__words") - 1, F.lit(0))
    t = t.select(*keys, F.inline(F.arrays_zip(F.col("__words").alias("a"), F.slice("__words", F.lit(2), n).alias("b"))).alias("__a", "__b"))
    t = t.select(*keys, F.concat_ws(" ", "__a", "__b").alias("__t"))
    size = F.length("__t")
    weight = F.when(size == 0, 0).when(size <= 6, 1).when(size <= 10, 2).when(size <= 15, 3).otherwise(4).cast("long")
    t = t.select(*keys, weight.alias("__v"), F.xxhash64("__t").alias("__h0"), F.xxhash64("__t", F.lit(1)).alias("__h1"))
    return votes(t, keys, F.col("__v"), [F.col("__h0"), F.col("__h1")])


def hexed(f0: Column, f1: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f0), 16, "0"), F.lpad(F.hex(f1), 16, "0")))


def likeness(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Estimated cosine of the texts' term vectors, 0 where it would be negative."""
    d = F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))
    return F.when(d == 0, F.lit(1.0)).when(d >= 64, F.lit(0.0)).otherwise(F.cos(d * 3.141592653589793 / 128))


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """bucket, row, ghost, id, text, next_text: rows in ascending order of id (nulls last), then of text.

    After the last row comes the first. Buckets are ranges of identifiers from
    approximate quantiles. Each bucket also gets a copy (a ghost) of the row that
    follows its last one, so a window within the bucket sees every successor.
    """
    ids = docs.select(F.col(id_col).cast("double").alias("x"))
    n = ids.count()
    want = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    cuts = sorted(set(ids.where("x is not null").approxQuantile("x", [i / want for i in range(1, want)], 0.2 / want))) if want > 1 else []
    inf = float("inf")
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("double"), F.lit(float("nan"))).alias("__x"))
    deal = lambda df: Bucketizer(splits=[-inf, *(cuts or [0.0]), inf], inputCol="__x", outputCol="__b", handleInvalid="keep").transform(df).withColumn("bucket", F.col("__b").cast("int")).drop("__b", "__x")
    t = deal(t)
    least = deal(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("double"), F.lit(float("nan"))).alias("__x"))).groupBy("bucket").agg(F.min("id").alias("__least"))
    heads = t.join(F.broadcast(least.withColumnRenamed("bucket", "__k")), (F.col("bucket") == F.col("__k")) & F.col("id").eqNullSafe(F.col("__least")))
    heads = heads.groupBy("bucket", "id").agg(F.min("text").alias("text"))
    places = least.select("bucket")
    before = places.withColumn("to", F.lag("bucket").over(W.orderBy("bucket")))  # at most MAX_BUCKETS + 1 rows
    last = places.agg(F.max("bucket").alias("__last"))
    before = before.crossJoin(last).select(F.col("bucket").alias("__k"), F.coalesce("to", "__last").alias("to"))
    ghosts = heads.join(F.broadcast(before), F.col("bucket") == F.col("__k")).select("id", "text", F.col("to").alias("bucket"), F.lit(True).alias("ghost"))
    rows = t.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    order = W.partitionBy("bucket").orderBy("ghost", F.col("id").asc_nulls_last(), "text")
    return rows.select("bucket", F.row_number().over(order).alias("row"), "ghost", "id", "text", F.lead("text").over(order).alias("next_text"))


def edit_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", halves: bool = False) -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    ``halves`` adds the fingerprint's two words f0 and f1.

    The edited text has its last half replaced by the start of the next
    document's text. Defined cases: a null text is empty; a text without words
    has fingerprint zero; ids may be null (last) or repeat (then in order of
    text); a single row follows itself; an empty table gives no rows; other
    columns are ignored.

    Plan: one shuffle deals texts to ranges of identifiers; the window, the sums
    of votes and the look at the next fingerprint all keep that partitioning.
    """
    rows = in_order(narrow(df, id_col, text_col), id_col, text_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.when(F.col("ghost"), F.lit(None)).otherwise(F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    keys = ["bucket", "row", "ghost", "id", "n_chars", "edited_sha256"]
    rows = rows.select("bucket", "row", "ghost", "id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), "text", edited.alias("edited"))
    both = rows.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("x")).select(*keys, "x.kind", "x.t")
    f = fingerprints(both.where(~F.col("ghost") | (F.col("kind") == 0)), [*keys, "kind"], F.col("t"))
    order = W.partitionBy("bucket").orderBy("row", "kind")
    f = f.select("*", *[F.lead(f"f{i}", k).over(order).alias(f"{name}{i}") for i in (0, 1) for name, k in (("e", 1), ("x", 2))])
    f = f.where(~F.col("ghost") & (F.col("kind") == 0))
    near = lambda b: likeness(F.col("f0"), F.col("f1"), F.col(f"{b}0"), F.col(f"{b}1"))
    return f.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", hexed(F.col("f0"), F.col("f1")).alias("fingerprint"), hexed(F.col("e0"), F.col("e1")).alias("edited_fingerprint"), near("e").alias("near_edited"), near("x").alias("near_next"), *(["f0", "f1"] if halves else []))


def count_near(rows: DataFrame, queries: Column, radius: int = 3, blocks: int = 5) -> DataFrame:
    """``rows`` (with f0, f1) and n_near: for rows where ``queries`` is true, how many other rows lie within ``radius``.

    Equal fingerprints are one entry of the tables, with their number of rows, so
    a large group of copies is neither paired nor gathered. ``rows`` is read
    several times and should be a written table. Other rows have n_near null.
    """
    entry = F.struct("f0", "f1").alias("id")
    index = rows.groupBy("f0", "f1").agg(F.count(F.lit(1)).alias("n"))
    asked = rows.where(queries).select("f0", "f1").distinct()
    found = search(asked.select(entry, "f0", "f1"), index.select(entry, "f0", "f1"), radius, blocks)
    size = index.select(entry, "n")
    near = found.join(size, "id").groupBy("query_id").agg(F.sum("n").alias("__n"))
    near = near.select(F.col("query_id.f0").alias("__f0"), F.col("query_id.f1").alias("__f1"), "__n", F.lit(True).alias("__q"))
    t = rows.withColumn("__ask", F.coalesce(queries, F.lit(False)))
    t = t.join(near, (F.col("f0") == F.col("__f0")) & (F.col("f1") == F.col("__f1")) & (F.col("__ask") == F.col("__q")), "left")
    return t.select(*rows.columns, (F.col("__n") - 1).alias("n_near"))


def block_tables(radius: int, blocks: int, words: int = 2) -> list[list[list[int]]]:
    """For each table, the blocks moved to the front as its key, each as one mask per 64-bit word.

    Two fingerprints within ``radius`` agree in full on at least blocks - radius
    blocks, so every such pair meets in a table.
    """
    width = 64 * words
    edges = [width * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [[sum(masks[b] for b in chosen) >> (64 * w) & (2**64 - 1) for w in range(words)] for chosen in combinations(range(blocks), blocks - radius)]


def search(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """All (query_id, id, distance) with fingerprints within ``radius``; both sides have id, f0, f1.

    Each row stands once in each permuted block table under that table's key;
    a join on (table, key) finds the candidates, which are then verified. A pair
    that meets in several tables counts in the first one only, so nothing has to
    be made distinct. Rows with a null fingerprint find nothing.
    """
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [[signed(m) for m in t] for t in block_tables(radius, blocks)]

    def tables(df: DataFrame, tag: str) -> DataFrame:
        keys = [F.struct(F.lit(i).alias("t"), F.col("f0").bitwiseAND(F.lit(m[0])).alias("k0"), F.col("f1").bitwiseAND(F.lit(m[1])).alias("k1")) for i, m in enumerate(masks)]
        return df.select(F.col("id").alias(f"{tag}id"), F.col("f0").alias(f"{tag}0"), F.col("f1").alias(f"{tag}1"), F.inline(F.array(*keys)).alias("t", "k0", "k1"))

    q, x = tables(queries, "q"), tables(index, "x")
    d = [F.col(f"q{i}").bitwiseXOR(F.col(f"x{i}")) for i in (0, 1)]
    first = F.coalesce(*[F.when((d[0].bitwiseAND(F.lit(m[0])) == 0) & (d[1].bitwiseAND(F.lit(m[1])) == 0), F.lit(i)) for i, m in enumerate(masks)])
    distance = F.bit_count(d[0]) + F.bit_count(d[1])
    # both sides are many times the rows they come from, which Spark's estimate of a broadcast doesn't see
    return q.join(x.hint("merge"), ["t", "k0", "k1"]).where((distance <= radius) & (first == F.col("t"))).select(F.col("qid").alias("query_id"), F.col("xid").alias("id"), distance.alias("distance"))
