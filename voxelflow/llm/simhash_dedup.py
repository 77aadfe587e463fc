"""Near-duplicate groups by SimHash: pigeonhole blocks, a join on blocks, verified Hamming distance, components.

Fingerprint: words split at ASCII white space with A-Z lower-cased; shingles of some words with repeats (fewer words: all
of them); XXH64 with seed 42 of each; a bit is 1 if set in over half of the hashes; no words: 0. A `Closeness` says which
documents link: those whose fingerprints over each of its shingle lengths differ in few enough bits. A component is
everything reachable.

- FOUR_BITS: shingles of four words, 4 bits.
- SIMILAR: for texts that share 0.8 or more of their five-word shingles. Each changed word changes five of those but only two
  of two words, so 8 bits over pairs of words find them, and 14 bits over five words tell them from texts that merely use
  the same words.

Exact copies collapse first: only distinct fingerprints are compared, and they carry their least id. The first
fingerprint's 64 bits are cut into blocks, and each fingerprint goes into buckets so that close pairs share one: either
a bucket for every choice of blocks that must be equal, or, for larger distances, for every block its values within a bit or so.
A bucket's fingerprints are compared in one sorted stream, which gives a spanning forest of its links, not all pairs.

A bucket of over `hot` fingerprints is never gathered. For distances up to 4 each of its fingerprints is spread over all
values within half the distance, and the least fingerprint at each value links the others, which combine before the
shuffle; two fingerprints within the distance share such a value, so no link is lost, and a value's link is verified. For
larger distances the bucket is dealt into chunks, and every pair of chunks is compared by itself: bounded tasks, and no pair
of fingerprints goes uncompared. Fingerprints and components that very many documents share are joined without moving
those documents (`join_counted`).

Null or wordless text: fingerprint 0, linked as any other. A null id joins its group; a group of only null ids has a null
component. Equal rows give equal rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import arrow_rows, id_and_text, join_counted, materialize


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned 64-bit SimHash of one whole text."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-shingle] + 1])
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], "<u8")
    set_in = np.zeros(64, np.int64)
    for part in range(0, h.size, 1 << 16):
        bits = np.unpackbits(h[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > h.size, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingles: tuple[int, ...] = (4,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and (fp2, ... for further shingle lengths) the bits of each fingerprint as a signed long, for every row."""
    names = _names(len(shingles))

    def scan(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, prints = [], []
            for i, t in arrow_rows([batch]):
                ids.append(i)
                prints.append([fingerprint(t, s) for s in shingles])
            bits = np.array(prints, np.uint64).reshape(-1, len(shingles)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(np.ascontiguousarray(b)) for b in bits.T)], ["doc_id", *names])

    return id_and_text(docs, id_col, text_col).mapInArrow(scan, ", ".join(["doc_id long", *(f"{n} long" for n in names)]))


def _names(n: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(2, n + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _blocks(n: int) -> list[int]:
    edges = [round(64 * k / n) for k in range(n + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]


def equal_blocks(blocks: int, max_bits: int) -> tuple[tuple[int, int, int], ...]:
    """Buckets (number, mask, flip) of a fingerprint, its value under the mask with flip: one for every choice of blocks - max_bits whole blocks, some of which pairs within max_bits have in common."""
    if blocks <= max_bits:
        raise ValueError("there must be more blocks than differing bits")
    return tuple((k, _signed(sum(m)), 0) for k, m in enumerate(combinations(_blocks(blocks), blocks - max_bits)))


def near_blocks(blocks: int, flips: int, max_bits: int) -> tuple[tuple[int, int, int], ...]:
    """Buckets as in `equal_blocks`: each block's value and all within `flips` bits. Of max_bits differing bits some block has at most 2 * flips, so both sides reach a value between."""
    if max_bits >= blocks * (2 * flips + 1):
        raise ValueError("more differing bits than the blocks' neighbourhoods cover")
    out = []
    for k, mask in enumerate(_blocks(blocks)):
        bits = [1 << b for b in range(64) if mask >> b & 1]
        out += [(k, _signed(mask), _signed(sum(f))) for n in range(flips + 1) for f in combinations(bits, n)]
    return tuple(out)


@dataclass(frozen=True)
class Closeness:
    """Shingle lengths, the most differing bits of each one's fingerprint, the buckets of the first, and the fingerprints above which a bucket is hot."""

    shingles: tuple[int, ...]
    max_bits: tuple[int, ...]
    buckets: tuple[tuple[int, int, int], ...]
    hot: int = 8192


FOUR_BITS = Closeness((4,), (4,), equal_blocks(6, 4))
SIMILAR = Closeness((2, 5), (8, 14), near_blocks(3, 1, 8))


def forest(prints: np.ndarray, bucket: np.ndarray, max_bits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Links (as places) of a spanning forest of each bucket; prints has a row for each shingle length, equal buckets stand together, and no fingerprint is twice in one."""
    x = prints.view(np.uint64)
    n, links = bucket.size, []
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(first, n))
    run = np.repeat(np.arange(first.size), size)
    small = np.repeat((size > 1) & (size <= 32), size)
    top: dict[int, int] = {}

    def find(i: int) -> int:
        while (j := top.get(i, i)) != i:
            top[i] = top.get(j, j)
            i = top[i]
        return i

    for d in range(1, 32):
        at = np.flatnonzero(small[:-d] & (run[:-d] == run[d:])) if d < n else np.empty(0, np.int64)
        if not at.size:
            break
        for row, most in zip(x, max_bits, strict=True):
            at = at[np.bitwise_count(row[at] ^ row[at + d]) <= most]
        for i in at.tolist():
            if (a := find(i)) != (b := find(i + d)):
                top[max(a, b)] = min(a, b)
                links.append((i + d, i))
    for k in np.flatnonzero(size > 32).tolist():
        rest = np.arange(first[k], first[k] + size[k])
        while rest.size:
            queue, rest = [rest[0]], rest[1:]
            while queue and rest.size:
                u = queue.pop()
                near = np.ones(rest.size, bool)
                for row, most in zip(x, max_bits, strict=True):
                    near &= np.bitwise_count(row[rest] ^ row[u]) <= most
                if near.any():
                    links += [(v, u) for v in rest[near].tolist()]
                    queue += rest[near].tolist()
                    rest = rest[~near]
    a, b = zip(*links, strict=True) if links else ((), ())
    return np.array(a, np.int64), np.array(b, np.int64)


def close_links(distinct: DataFrame, by: Closeness = FOUR_BITS) -> DataFrame:
    """Links between distinct fingerprints (fp, fp2, ...), enough to connect all that chains of close ones connect: (a, b), each a fingerprint or, of several, a struct of them."""
    names = _names(len(by.shingles))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(m).alias("m"), F.lit(x).alias("x")) for k, m, x in by.buckets)))
    keyed = distinct.select(*names, each.alias("c")).select(*names, F.xxhash64("c.k", F.col("fp").bitwiseAND(F.col("c.m")).bitwiseXOR(F.col("c.x"))).alias("bucket"))
    crowded = materialize(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > by.hot), "hot-buckets")
    links = _links_in(keyed.join(crowded, "bucket", "left_anti").select(*names, "bucket"), by.max_bits)
    if not crowded.isEmpty():
        members = keyed.join(F.broadcast(crowded) if crowded.count() <= 100_000 else crowded, "bucket")
        links = links.unionByName(hot_links(members, by.max_bits[0]) if len(names) == 1 and by.max_bits[0] <= 4 else chunk_links(members, by))
    return links


def _links_in(keyed: DataFrame, max_bits: tuple[int, ...]) -> DataFrame:
    """The links of each bucket (fp, ..., bucket) by itself."""
    names = _names(len(max_bits))
    ends = [f"{end}_{n}" for end in "ab" for n in names]

    def compare(batches: Iterable) -> Iterator:
        import pyarrow as pa

        def out(prints: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(row[at]) for at in forest(prints, bucket, max_bits) for row in prints], ends)

        kept = np.empty((len(names) + 1, 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([kept, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            bucket = rows[-1]
            last = int(np.flatnonzero(bucket != bucket[-1])[-1]) + 1 if bucket[0] != bucket[-1] else 0
            if last:
                yield out(rows[:-1, :last], bucket[:last])
            kept = rows[:, last:]
        if kept.size:
            yield out(kept[:-1], kept[-1])

    found = keyed.repartition("bucket").sortWithinPartitions("bucket", *names).mapInArrow(compare, ", ".join(f"{e} long" for e in ends))
    end = lambda e: F.col(f"{e}_fp") if len(names) == 1 else F.struct(*(F.col(f"{e}_{n}").alias(n) for n in names))
    return found.select(end("a").alias("a"), end("b").alias("b"))


def chunk_links(members: DataFrame, by: Closeness) -> DataFrame:
    """Links within large buckets (fp, ..., bucket, n): each is dealt into chunks of about by.hot, and every two chunks are compared as a bucket of their own."""
    names = _names(len(by.shingles))
    dealt = members.withColumn("chunks", F.ceil(F.col("n") / by.hot).cast("int")).withColumn("mine", F.pmod(F.xxhash64(*names), F.col("chunks")).cast("int"))
    pairs = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    return _links_in(pairs.select(*names, F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket")), by.max_bits)


def hot_links(members: DataFrame, max_bits: int) -> DataFrame:
    """Links within large buckets (fp, bucket), in work that grows with their members and not with their pairs.

    Every member is spread over the values within half of max_bits; members at one value are linked to the least of
    them, and all of those are within max_bits of each other.
    """
    near = [0, *(_signed(sum(1 << b for b in bits)) for k in range(1, (max_bits + 1) // 2 + 1) for bits in combinations(range(64), k))]
    spread = members.select("fp").distinct().select("fp", F.explode(F.lit(near)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    least = spread.groupBy("at").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return spread.join(least, "at").where(F.col("fp") != F.col("b")).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= max_bits).select(F.col("fp").alias("a"), "b").distinct()


def rooted_groups(docs: DataFrame, by: Closeness = FOUR_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (fp2, ...), root (a fingerprint, or a struct of them, that names the component) and component_id (the least id reachable) of every row of docs; two components share a component_id where rows share that id."""
    names = _names(len(by.shingles))
    prints = materialize(fingerprints(docs, by.shingles, id_col, text_col), "fingerprints")
    distinct = materialize(prints.groupBy(*names).agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "distinct-fingerprints")
    node = F.col("fp") if len(names) == 1 else F.struct(*names)
    roots = materialize(connected_components(close_links(distinct, by)), "roots")
    nodes = distinct.withColumn("node", node)
    linked = materialize(nodes.join(roots, "node"), "linked")
    group = linked.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    of_node = [*names, F.col("n").alias("rows"), "root"]
    placed = join_counted(linked.select(*of_node), group, ["root"], linked.count())
    alone = nodes.join(roots, "node", "left_anti").select(*names, F.col("n").alias("rows"), F.col("node").alias("root"), F.col("least_id").alias("component_id"))
    placed = materialize(placed.unionByName(alone).withColumnRenamed("rows", "n"), "placed")
    return join_counted(prints, placed, names, prints.count()).select("doc_id", *names, "root", "component_id")


def simhash_groups(docs: DataFrame, by: Closeness = FOUR_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (fp2, ...) and component_id (the least id reachable) of every row of docs."""
    return rooted_groups(docs, by, id_col, text_col).drop("root")


def fingerprint_of(text: Column, shingle: int = 4) -> Column:
    """The fingerprint of a text column, as `fingerprints` gives it."""

    @F.arrow_udf("long")
    def scan(texts):  # noqa: ANN001, ANN202
        import pyarrow as pa

        return pa.array([_signed(fingerprint(t.as_py(), shingle)) for t in texts], pa.int64())

    return scan(text)
