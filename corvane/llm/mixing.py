"""Mixing sources to target weights by Sainte-Laguë apportionment.

All words are cut into blocks of equal size. Sources get blocks by the highest
quotients target / (2 k - 1); the shards of a source share its blocks the same
way by their sizes, so each shard has an integer quota. A shard's documents, in
an order drawn from the seed, form one stream of words; the quota first covers
whole passes over the stream, and the rest picks that many of its blocks by a
seeded permutation of their numbers. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import SPACE, WORD, Scratch, narrow, small

BLOCK = 32
SHARD_WORDS = 1 << 16
#: As many as the draw has numbers for; shards grow in number, not in size, up to 10^12 words a source.
MAX_SHARDS = 1 << 24
MAX_REPEAT = 3
#: A prime above any number of blocks in a shard, so multiplying by it permutes block numbers.
STEP = 2147483629


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _draw(seed: int, *parts: Column) -> Column:
    return F.md5(F.encode(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts]), "UTF-8"))


def _number(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 7), 16, 10).cast("long")


def targets(per_source: DataFrame, weights: int = 3, repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, rank → also target: weights 1..``weights`` in turn, at most ``repeat`` times the size.

    Sources fill up in ascending order of limit over weight, so those at their
    limit are a prefix of that order; the rest share what is left by weight. One
    row a source, so the windows have no key.
    """
    w = F.pmod(F.col("rank") - 1, F.lit(weights)) + 1
    t = per_source.select("source", "source_size", "rank", w.alias("w"), (F.col("source_size") * repeat).alias("cap"))
    order = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("rank"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumns({"num": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)), "den": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))})
    t = t.withColumn("full", F.col("cap") * F.col("den") <= F.col("w") * F.col("num"))
    # the first row that is not full has the largest den
    t = t.withColumn("level", F.max(F.when(~F.col("full"), F.struct("den", "num"))).over(everything))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("w") * F.col("level.num")).cast("double") / F.col("level.den").cast("double"))
    return t.select("source", "source_size", "rank", target.alias("target"))


def apportion(df: DataFrame, votes: str, seats: str, by: list[str], order: list[str], out: str) -> DataFrame:
    """Sainte-Laguë: adds ``out``, the seats of each row among the rows with equal ``by``.

    ``seats`` is the number to give in the group, the same in its rows. Rounding
    votes by a divisor a little too large gives each row seats that it certainly
    gets, and a divisor a little too small all that it could get; only the at
    most 3 n quotients between are ranked. Ties go by ``order``.
    """
    g = W.partitionBy(*by)
    n, v, m, total = F.count(F.lit(1)).over(g), F.col(votes).cast("double"), F.col(seats).cast("double"), F.sum(F.col(votes).cast("double")).over(g)
    bound = lambda x: F.floor(F.when(total > 0, v * F.greatest(x, F.lit(0.0)) / total).otherwise(F.lit(0.0)) + 0.5)
    t = df.withColumns({"__low": bound(m - (n + 1) / 2), "__high": bound(m + (n + 1) / 2)})
    t = t.withColumn("__left", F.col(seats) - F.sum("__low").over(g))
    k = t.select(*by, *order, v.alias("__v"), "__left", F.explode(F.sequence(F.col("__low") + 1, F.col("__high") + 1)).alias("__k"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy((F.col("__v") / (2 * F.col("__k") - 1)).desc(), *order))
    won = k.withColumn("__r", rank).where((F.col("__r") <= F.col("__left")) & (F.col("__v") > 0)).groupBy(*by, *order).agg(F.count(F.lit(1)).alias("__won"))
    keys = [*by, *order]
    won = won.toDF(*[f"__{c}" if c in keys else c for c in won.columns])
    return t.join(won, [t[c].eqNullSafe(won[f"__{c}"]) for c in keys], "left").select(*df.columns, (F.col("__low") + F.coalesce("__won", F.lit(0))).cast("long").alias(out))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken.

    Plan: texts are read once for their sizes, never shuffled. One narrow shuffle
    groups rows by (source, shard); a shard has about ``shard_words`` words, so a
    hot source spreads over as many tasks as it has data for.

    ``taken`` counts the words that the mix takes from the row, repeats counted,
    and is at most 3 times ``size``. Defined cases: a null text has no words; a
    null source is a source of its own, last in order; rows without words have
    taken 0; rows that are equal in identifier, source and size stand next to
    each other in the order, so which of them is taken makes no difference to
    the result; an empty table gives no rows; other columns are ignored. Equal
    input and seed give an equal result however the rows are dealt out.
    """
    rows = _plan(df, id_col, text_col, source_col, (), False, seed, block, shard_words)
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", _taken(block))


def mix_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = (), seed: int = 7, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix itself: id, source, ``carry``, text.

    A row appears once for each whole pass, and once more with the words of its
    picked blocks, joined by spaces (or in full if all are picked). Rows of which
    nothing is taken are left out; that holds for rows without words. Other
    cases are as for ``mix``. Here texts ride along in the shuffle.
    """
    rows = _plan(df, id_col, text_col, source_col, tuple(c for c in dict.fromkeys(carry) if c not in (id_col, text_col, source_col)), True, seed, block, shard_words)
    blocks = F.when(F.coalesce("rest", F.lit(0)) > 0, F.filter(_blocks(block), lambda b: _is_picked(b)))
    rows = rows.where("size > 0").withColumn("blocks", F.coalesce(blocks, F.array().cast("array<long>")))
    text, words = F.col("__c_text"), F.split(F.trim(F.regexp_replace("__c_text", SPACE, " ")), " ")

    def cut(w: Column, b: Column) -> Column:
        lo, hi = F.greatest(F.col("lo"), b * block), F.least(F.col("hi"), (b + 1) * block)
        return F.array_join(F.slice(w, (lo - F.col("lo") + 1).cast("int"), (hi - lo).cast("int")), " ")

    part = F.get(F.transform(F.array(words), lambda w: F.array_join(F.transform("blocks", lambda b: cut(w, b)), " ")), F.lit(0))
    whole = F.size("blocks") == F.size(_blocks(block))
    texts = F.concat(F.array_repeat(text, F.col("passes").cast("int")), F.when(F.size("blocks") == 0, F.array().cast("array<string>")).when(whole, F.array(text)).otherwise(F.array(part)))
    kept = [c for c in rows.columns if c.startswith("__c_") and c != "__c_text"]
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), *[F.col(c).alias(c[4:]) for c in kept], F.explode(texts).alias(text_col))


def _blocks(block: int) -> Column:
    return F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))


def _is_picked(b: Column) -> Column:
    return F.pmod(b * STEP + F.col("start"), F.col("n")) < F.col("rest")


def _taken(block: int) -> Column:
    shared = lambda b: F.least(F.col("hi"), (b + 1) * block) - F.greatest(F.col("lo"), b * block)
    picked = F.aggregate(_blocks(block), F.lit(0).cast("long"), lambda total, b: total + F.when(_is_picked(b), shared(b)).otherwise(F.lit(0)))
    some = F.col("size") * F.col("passes") + F.when(F.col("rest") > 0, picked).otherwise(F.lit(0))
    return F.when(F.col("size") > 0, some).otherwise(F.lit(0)).cast("long").alias("taken")


def _plan(df: DataFrame, id_col: str, text_col: str, source_col: str, carry: tuple[str, ...], texts: bool, seed: int, block: int, shard_words: int) -> DataFrame:
    """Rows with the place lo..hi of their words in their shard's stream and the shard's quota: passes, and rest of n blocks."""
    store = Scratch(df.sparkSession, "mix")
    docs = narrow(df, *dict.fromkeys((id_col, text_col, source_col, *carry)))
    draw = _draw(seed, F.col(id_col))
    measured = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), draw.alias("draw"), *([text_col, *carry] if texts else []))
    sizes = store.table(measured.select("id", "source", "size", "draw"), "sizes")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = targets(per.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))))
    total = F.sum("source_size").over(W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    per = per.withColumn("seats", F.round(total / block).cast("long"))
    per = apportion(per, "target", "seats", [], ["rank"], "blocks")
    shards = F.least(F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)), F.lit(MAX_SHARDS))
    per = small(store.table(per.select(F.col("source").alias("__s"), "rank", "source_size", "target", "blocks", shards.alias("shards")), "sources"))
    join = lambda t: t.join(per, F.col("source").eqNullSafe(F.col("__s"))).withColumn("shard", F.pmod(_number(F.col("draw"), 1), F.col("shards")))
    quota = join(sizes).groupBy("rank", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"))
    quota = apportion(quota, "words", "blocks", ["rank"], ["shard"], "quota").where(F.col("words") > 0)
    quota = small(store.table(quota.select(F.col("rank").alias("__r"), F.col("shard").alias("__h"), "words", "quota"), "shards"))
    if texts:
        sizes = measured.select("*", F.coalesce(text_col, F.lit("")).alias("__c_text"), *[F.col(c).alias(f"__c_{c}") for c in carry]).select("id", "source", "size", "draw", "__c_text", *[f"__c_{c}" for c in carry])
    rows = join(sizes).drop("blocks").join(quota, (F.col("rank") == F.col("__r")) & (F.col("shard") == F.col("__h")), "left")
    upto = F.sum("size").over(W.partitionBy("rank", "shard").orderBy("draw", "id", "size").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("size")).withColumn("n", F.ceil(F.col("words") / block))
    give = F.least(F.col("quota"), F.col("n") * MAX_REPEAT)
    rows = rows.withColumn("passes", F.floor(give / F.col("n"))).withColumn("rest", give - F.col("passes") * F.col("n"))
    return rows.withColumn("start", _number(_draw(seed, F.col("rank"), F.col("shard")), 1))
