"""Near-duplicates by SimHash, linked through a generalised pigeonhole.

Split the bits into m partitions and give partition i a threshold t_i >= -1 with
sum(t_i) = radius - m + 1. Two fingerprints within the radius then differ in at
most t_i bits of some partition i (t_i = -1: that partition is not probed).
Correlated bits go to one partition, and the thresholds come from a dynamic
program over estimated costs, both from statistics of all fingerprints. The
number of partitions follows the same cost: few rows get many short keys, many
rows get long keys with neighbouring keys probed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, narrow, small
from corvane.llm.components import components

RADIUS = 4
SHINGLE = 4
#: For near copies: words in a shingle, radius of the word fingerprints, differing bits of 256 up to which a pair is a
#: candidate (at a Jaccard similarity of 0.8 the expected number is 39, its deviation 6), and the similarity asked for.
WORDS = 5
NEAR_RADIUS = 8
NEAR_BITS = 60
ALIKE = 0.8
#: Shingle sets compared as one block in the exact check.
SET_BLOCK = 1024
#: Fingerprints compared as one block; a larger bucket is split into pairs of blocks.
BLOCK = 4096
#: Estimated seconds for a probed key and for a verified candidate pair.
PROBE_S, PAIR_S = 3e-6, 3e-9


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text in UTF-8."""
    from xxhash import xxh64_intdigest as xxh

    words = (text or b"").lower().split()  # both treat ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n < 2:
        return xxh(joined, 42)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist()
    ends = ends[shingle - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([xxh(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], "<u8")
        votes += np.add.reduce(np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64), axis=0, dtype=np.uint32)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash64(text: pa.Array) -> pa.Array:
    return pa.array([_signed(fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None)) for t in text.cast(pa.large_binary())], pa.int64())


def _majority(h: np.ndarray) -> np.ndarray:
    """One 64-bit word per column of ``h``: bits set in over half of its rows."""
    votes = np.zeros((h.shape[1], 64), np.int64)
    for at in range(0, len(h), 1 << 14):
        bits = np.unpackbits(np.ascontiguousarray(h[at : at + (1 << 14)].T).view(np.uint8), bitorder="little").reshape(h.shape[1], -1, 64)
        votes += np.add.reduce(bits, axis=1, dtype=np.uint32)
    return np.packbits(2 * votes > len(h), axis=1, bitorder="little").view("<u8").ravel()


def _mixed(h: np.ndarray) -> np.ndarray:
    """Four words per hash, by the finalizer of SplitMix64 from four starts."""
    z = h[:, None] + np.array([(0x9E3779B97F4A7C15 * (k + 1)) & (1 << 64) - 1 for k in range(4)], np.uint64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(words: list[bytes], shingle: int = WORDS) -> np.ndarray:
    """The distinct hashes of the word shingles, ascending; of fewer words that of the whole sequence, of none none."""
    from xxhash import xxh64_intdigest as xxh

    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(len(words) - shingle + 1, 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist()
    ends = ends[-n:].tolist()
    return np.unique(np.array([xxh(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64))


def prints(text: bytes | None, shingle: int = WORDS) -> list[int]:
    """The 64-bit fingerprint of a text's distinct words, 256 bits over its distinct word shingles, and a checksum of these, as six signed words.

    A changed word alters one of the first's terms but ``shingle`` of the
    others': the one finds candidates at a small radius, the second leaves out
    those that are far apart. Letters are lowered in ASCII; without words all is zero.
    """
    from xxhash import xxh64_intdigest as xxh

    words = (text or b"").lower().split()
    if not words:
        return [0] * 6
    distinct = np.array([xxh(w, 42) for w in set(words)], np.uint64)
    hashes = shingle_hashes(words, shingle)
    with np.errstate(over="ignore"):
        wide = _majority(_mixed(hashes))
    check = xxh(hashes.tobytes(), 7)
    return [int(x) for x in np.concatenate([_majority(distinct[:, None]), wide, np.array([check], np.uint64)]).view(np.int64)]


def near_prints(text: pa.Array, shingle: int = WORDS) -> pa.Array:
    rows = [prints(t.as_buffer().to_pybytes() if t.is_valid else None, shingle) for t in text.cast(pa.large_binary())]
    cols = np.array(rows, np.int64).reshape(-1, 6).T
    return pa.StructArray.from_arrays([pa.array(c) for c in cols], [f"p{i}" for i in range(6)])


def exact_links(sets: list[np.ndarray], alike: float = ALIKE) -> list[tuple[int, int]]:
    """Index pairs that link whatever is linked: sets (ascending, distinct) of a Jaccard similarity of ``alike`` or more.

    Each set taken up is looked up in an inverted index of those not yet linked,
    which is built anew whenever half of them are.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    free = np.ones(n, bool)
    out, left = [], n

    def index() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        who = np.flatnonzero(free)
        flat, owner = np.concatenate([sets[i] for i in who]), np.repeat(who, size[who])
        order = np.argsort(flat, kind="stable")
        keys, first = np.unique(flat[order], return_index=True)
        return keys, np.append(first, len(order)), owner[order]

    keys = None
    for start in range(n):
        if not free[start]:
            continue
        free[start], left = False, left - 1
        todo = [start]
        while todo and left:
            if keys is None or 2 * left < built:
                (keys, edges, owner), built = index(), left
            q = todo.pop()
            at = np.searchsorted(keys, sets[q])
            at = at[at < len(keys)] if len(keys) else at[:0]
            hit = at[keys[at] == sets[q][: len(at)]]
            lo, hi = edges[hit], edges[hit + 1]
            count = hi - lo
            common = np.bincount(owner[np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())], minlength=n)
            found = np.flatnonzero(free & (common > 0) & (common >= alike * (size[q] + size - common) - 1e-9)).tolist()
            out += [(q, x) for x in found]
            free[found] = False
            left -= len(found)
            todo += found
    return out


def _bit_pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((64, 64)), 0
    for b in it:
        f = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        for at in range(0, len(f), 1 << 15):
            x = np.unpackbits(np.ascontiguousarray(f[at : at + (1 << 15)]).view(np.uint8), bitorder="little").reshape(-1, 64).astype(np.float32)
            total += x.T @ x
        n += len(f)
    if n:
        yield pa.RecordBatch.from_pydict({"k": np.arange(4097), "n": np.append(total.ravel(), n).astype(np.int64)})


def plan(n: int, together: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the cheapest split. together[i, j]: fingerprints with bits i and j set; n: all of them."""
    n1 = max(n, 1)
    p11 = together / n1
    p = np.diag(p11)
    same = p**2 + (1 - p) ** 2  # two random fingerprints agree on the bit
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    joint = p11**2 + p10**2 + p01**2 + (1 - p11 - p10 - p01) ** 2
    given = joint / np.maximum(same[None, :], 1e-12)  # agree on i, given that they agree on j
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((p11 - np.outer(p, p)) / np.outer(spread, spread))
    best: tuple[float, list] = (math.inf, [])
    for m in range(1, radius + 2):
        left, parts = set(range(64)), []
        for i in range(m):
            want = 64 * (i + 1) // m - 64 * i // m
            part = [min(left, key=lambda b: (same[b], b))]  # the most telling bit left
            left.remove(part[0])
            while len(part) < want:
                nxt = max(left, key=lambda b: (corr[b, part].max(), -b))
                part.append(nxt)
                left.remove(nxt)
            parts.append(part)
        cost = []
        for part in parts:
            differ = []  # chance that the bits at 0, 1, ... positions differ
            dist = np.zeros(radius + 2)
            dist[0] = 1
            for k, b in enumerate(part):
                agree = same[b] if k == 0 else min(1.0, max(given[b, part[:k]].max(), same[b]))
                dist[1:] = dist[1:] * agree + dist[:-1] * (1 - agree)
                dist[0] *= agree
                differ.append(agree)
            near = np.cumsum(dist)
            keys = np.cumsum([math.comb(len(part), t) for t in range(radius + 1)])
            cost.append([0.0] + [n * keys[t] * PROBE_S + n * n / 2 * near[t] * (1 if t == 0 else 2) * PAIR_S for t in range(radius + 1)])  # of -1, 0, ...
        need = radius - m + 1
        table = {0: (0.0, [])}  # sum of thresholds → cheapest
        for c in cost:
            nxt: dict[int, tuple[float, list]] = {}
            for s, (v, chosen) in table.items():
                for t in range(-1, radius + 1):
                    x = (v + c[t + 1], [*chosen, t])
                    if x[0] < nxt.get(s + t, (math.inf,))[0]:
                        nxt[s + t] = x
            table = nxt
        if table[need][0] < best[0]:
            best = (table[need][0], list(zip(parts, table[need][1], strict=True)))
    return best[1]


def _probes(parts: list[tuple[list[int], int]]):
    masks = []
    for i, (bits, t) in enumerate(parts):
        if t >= 0:
            flips = [sum(1 << b for b in c) for k in range(t + 1) for c in combinations(bits, k)]
            masks.append((i, np.uint64(sum(1 << b for b in bits)), np.array(flips, np.uint64)))

    def probes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]
            f = cols[0].view(np.uint64)
            for i, mask, flips in masks:
                step = max(1, (1 << 18) // len(flips))
                for at in range(0, len(f), step):
                    keys = ((f[at : at + step] & mask)[:, None] ^ flips[None, :]).ravel()
                    out = {"part": pa.array(np.full(len(keys), i, np.int64)), "key": pa.array(keys.view(np.int64))}
                    yield pa.RecordBatch.from_pydict(out | {n: pa.array(np.repeat(c[at : at + step], len(flips))) for n, c in zip(b.schema.names, cols, strict=True)})

    return probes


def spanning(f: np.ndarray, radius: int, wide: np.ndarray | None = None, bits: int = 0) -> list[tuple[int, int]]:
    """Index pairs that link whatever is linked: fingerprints ``f`` within ``radius`` whose rows of ``wide`` differ in at most ``bits``."""

    def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(wide[a] ^ wide[b]).sum(axis=-1, dtype=np.int64) <= bits

    if len(f) <= 256:
        near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
        x, y = np.nonzero(np.triu(near, 1))
        if len(x) and wide is not None:
            keep = same(x, y)
            x, y = x[keep], y[keep]
        if len(x) <= len(f):
            return list(zip(x.tolist(), y.tolist(), strict=True))
        left = np.unique(np.concatenate([x, y]))
    else:
        left = np.arange(len(f))
    out = []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            q = todo.pop()
            hit = np.bitwise_count(f[left] ^ f[q]) <= radius
            if wide is not None and hit.any():
                hit[hit] = same(left[hit], q)
            if hit.any():
                found = left[hit].tolist()
                out += [(q, x) for x in found]
                todo += found
                left = left[~hit]
    return out


class _Forest:
    """Union-find over the links that one task finds."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for y in path:
            self.up[y] = x
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _links(radius: int, bits: int):
    def links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()

        def done(pieces: list[np.ndarray]) -> None:
            """Rows are the columns: fingerprint, node, and the wide words if there are any."""
            rows = np.concatenate(pieces, axis=1)
            node, at = np.unique(rows[1], return_index=True)
            if len(at) > 1:
                rows = rows[:, at].view(np.uint64)
                wide = np.ascontiguousarray(rows[2:].T) if len(rows) > 2 else None
                for a, b in spanning(rows[0], radius, wide, bits):
                    forest.link(int(node[a]), int(node[b]))

        last, held = None, []
        for b in it:
            cols = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
            keys = cols[:4]
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), cols.shape[1]]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    if (key := keys[:, lo].tobytes()) != last:
                        if held:
                            done(held)
                        last, held = key, []
                    held.append(cols[4:, lo:hi])
        if held:
            done(held)
        pairs = [(a, r) for a in list(forest.up) if (r := forest.root(a)) != a]
        for at in range(0, len(pairs), 1 << 16):
            a, b = zip(*pairs[at : at + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def link(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, bits: int = 0) -> DataFrame:
    """Links (a, b) between nodes that connect whatever fingerprints lie within ``radius``.

    ``fps`` has fp and node, one row a node, and may have wide words: then linked
    nodes also differ in at most ``bits`` bits of those. A bucket of over
    ``block`` rows is cut into blocks, and each pair of blocks becomes a group of
    its own, so no task gathers an unbounded bucket. Within a group only links of
    a spanning forest leave, not all pairs.
    """
    counts = {r["k"]: r["n"] for r in fps.select("fp").mapInArrow(_bit_pairs, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}  # 4097 rows
    n = counts.pop(4096, 0)
    parts = plan(n, np.array([counts.get(k, 0) for k in range(4096)], float).reshape(64, 64), radius)
    names = [c for c in fps.columns if c not in ("fp", "node")]
    fps = fps.select("fp", "node", *names)
    keys = fps.mapInArrow(_probes(parts), "part long, key long, " + ", ".join(f"{c} long" for c in fps.columns))
    hot = keys.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    hot = hot.select(F.col("part").alias("__p"), F.col("key").alias("__k"), F.ceil(F.col("n") / block * 2).alias("__c"))
    hot = Scratch(fps.sparkSession, "hot").table(hot, "keys")  # written, so that the rows of a hot key can be split in the join
    keys = keys.join(hot, (F.col("part") == F.col("__p")) & (F.col("key") == F.col("__k")), "left")
    mine = F.pmod(F.xxhash64("node"), F.col("__c"))
    pair = lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j"))
    pairs = F.when(F.col("__c").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("__c") - 1), pair))
    keys = keys.select("part", "key", F.inline(pairs), *fps.columns)
    keys = keys.repartition("part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j")
    return keys.mapInArrow(_links(radius, bits), "a long, b long")


def near_components(rows: DataFrame, id_col: str, fp: str, wide: tuple[str, ...] = (), radius: int = RADIUS, bits: int = 0, check=None) -> DataFrame:
    """(node, component_id, members) for the distinct fingerprints of ``rows``, which has a column node for them.

    ``check`` makes from the groups (u, root) of the links found the links that count.
    """
    store = Scratch(rows.sparkSession, "simhash")
    agg = [F.first(c).alias(c) for c in (fp, *wide) if c != "node"]  # the same in all rows of a node
    fps = store.table(rows.groupBy("node").agg(F.min(id_col).alias("best"), F.count(F.lit(1)).alias("n"), *agg), "fps")
    edges = link(fps.select(F.col(fp).alias("fp"), "node", *wide), radius, bits=bits)
    roots = store.table(components(edges), "roots")
    if check is not None:
        roots = store.table(components(check(roots)), "checked")
    t = fps.join(roots, F.col("node") == F.col("u"), "left").select("node", "best", "n", F.coalesce("root", "node").alias("root"))
    linked = roots.select("root").distinct()
    t = store.table(t, "fps_roots")
    groups = t.join(linked, "root", "left_semi").groupBy("root").agg(F.min("best").alias("least"), F.sum("n").alias("all")).withColumnRenamed("root", "__root")
    groups = store.table(groups, "groups")
    return t.join(groups, F.col("root") == F.col("__root"), "left").select(F.col("node").alias("__node"), F.coalesce("least", "best").alias("component_id"), F.coalesce("all", "n").alias("members"))


def _sets(shingle: int):
    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [shingle_hashes((x.as_buffer().to_pybytes() if x.is_valid else b"").lower().split(), shingle).view(np.int64) for x in part.column(1).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "set"])

    return sets


def _exact(alike: float):
    def exact(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()

        def done(held: list[tuple[int, np.ndarray]]) -> None:
            node, sets = zip(*{x[0]: x for x in held}.values(), strict=True)
            for a, b in exact_links(list(sets), alike):
                forest.link(node[a], node[b])

        last, held = None, []
        for b in it:
            keys = list(zip(*(c.to_pylist() for c in b.columns[:3]), strict=True))
            for k, node, s in zip(keys, b.column(3).to_pylist(), b.column(4), strict=True):
                if k != last:
                    if len(held) > 1:
                        done(held)
                    last, held = k, []
                held.append((node, s.values.to_numpy(zero_copy_only=False).view(np.uint64)))
        if len(held) > 1:
            done(held)
        pairs = [(a, r) for a in list(forest.up) if (r := forest.root(a)) != a]
        for at in range(0, len(pairs), 1 << 16):
            a, b = zip(*pairs[at : at + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return exact


def exact_check(rows: DataFrame, roots: DataFrame, alike: float = ALIKE, shingle: int = WORDS, block: int = SET_BLOCK) -> DataFrame:
    """Links (a, b) between nodes of one group of ``roots`` (u, root) that connect whatever has shingle sets ``alike`` or more.

    ``rows`` has node and __t, a text of the node. Only members of groups are
    shingled. A group of over ``block`` nodes is cut into blocks, and each pair of
    blocks becomes a group of its own, as in ``link``.
    """
    store = Scratch(rows.sparkSession, "exact")
    members = roots.select("root", F.col("u").alias("__u")).unionByName(roots.select("root", F.col("root").alias("__u")).distinct())
    members = store.table(members, "members")
    size = members.groupBy(F.col("root").alias("__r")).agg(F.count(F.lit(1)).alias("n"))
    size = store.table(size.where(F.col("n") > block).select("__r", F.ceil(F.col("n") / block * 2).alias("__c")), "large")
    texts = rows.join(small(members.select("__u")), F.col("node") == F.col("__u"), "left_semi")
    sets = store.table(texts.select("node", "__t").mapInArrow(_sets(shingle), "node long, set array<long>"), "sets")
    t = members.join(size, F.col("root") == F.col("__r"), "left")
    mine = F.pmod(F.xxhash64("__u"), F.col("__c"))
    pair = lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j"))
    zero = F.lit(0).cast("long")
    pairs = F.when(F.col("__c").isNull(), F.array(F.struct(zero.alias("i"), zero.alias("j")))).otherwise(F.transform(F.sequence(zero, F.col("__c") - 1), pair))
    t = t.select("root", "__u", F.inline(pairs)).join(sets, F.col("__u") == F.col("node")).select("root", "i", "j", "node", "set")
    t = t.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return t.mapInArrow(_exact(alike), "a long, b long")


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), radius: int = RADIUS) -> DataFrame:
    """One row per input row: id, ``carry``, fingerprint (16 hex digits), component_id, component_size.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; the
    component is named by its smallest identifier. Defined cases: a null text is
    empty; texts without words have fingerprint zero and link like others; a null
    identifier never names a component unless all of it are null; repeated rows
    count as members; an empty table gives no rows; other columns are ignored.
    """
    docs = narrow(df, *dict.fromkeys((id_col, text_col, *carry)))
    extra = [c for c in dict.fromkeys(carry) if c != id_col]
    rows = docs.withColumn("node", F.arrow_udf(simhash64, "long")(F.col(text_col)))
    store = Scratch(df.sparkSession, "simhash-rows")
    rows = store.table(rows.select(id_col, *[F.col(c).alias(f"__c_{c}") for c in extra], "node"), "rows")
    found = near_components(rows.select(id_col, "node"), id_col, "node", radius=radius)
    hexed = F.lower(F.lpad(F.hex("node"), 16, "0"))
    return rows.join(found, F.col("node") == F.col("__node"), "left").select(id_col, *[F.col(f"__c_{c}").alias(c) for c in extra], hexed.alias("fingerprint"), "component_id", F.col("members").alias("component_size"))


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), radius: int = NEAR_RADIUS, bits: int = NEAR_BITS, shingle: int = WORDS, alike: float = ALIKE) -> DataFrame:
    """One row per input row: id, ``carry``, component_id, component_size, linking texts whose shingle sets are ``alike`` or more.

    Candidates come from the word fingerprints by the generalised pigeonhole, if
    their 256-bit shingle fingerprints differ in at most ``bits``; within the
    groups of candidates the Jaccard similarity of the shingle sets is exact, so
    no row is linked that has no text ``alike``. Cases are as for
    ``simhash_dedup``; texts with equal sets are one node, those without words
    too. Rows are written once with their prints, so texts are not fingerprinted
    twice.
    """
    docs = narrow(df, *dict.fromkeys((id_col, text_col, *carry)))
    extra = [c for c in dict.fromkeys(carry) if c not in (id_col, text_col)]
    kind = "struct<" + ",".join(f"p{i}:long" for i in range(6)) + ">"
    run = F.arrow_udf(lambda t: near_prints(t, shingle), kind)
    words = [f"__p{i}" for i in range(6)]
    rows = docs.withColumn("__p", run(F.col(text_col))).select(id_col, F.col(text_col).alias("__t"), *[F.col(c).alias(f"__c_{c}") for c in extra], *[F.col(f"__p.p{i}").alias(w) for i, w in enumerate(words)])
    rows = Scratch(df.sparkSession, "near-rows").table(rows.withColumn("node", F.xxhash64(*words)), "rows")
    check = lambda roots: exact_check(rows, roots, alike, shingle)
    found = near_components(rows.select(id_col, "node", *words[:5]), id_col, words[0], tuple(words[1:5]), radius, bits, check)
    kept = [F.col("__t" if c == text_col else f"__c_{c}").alias(c) for c in dict.fromkeys(carry) if c != id_col]
    return rows.join(found, F.col("node") == F.col("__node"), "left").select(id_col, *kept, "component_id", F.col("members").alias("component_size"))
