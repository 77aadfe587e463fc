"""Benchmark decontamination by an FM-index of each training shard.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Test phrases are the windows of 13
consecutive words of each benchmark item (a shorter item is one window). A shard is what one task has read up to
`shard_words` words: its texts as word numbers over the benchmark's vocabulary. A word outside the vocabulary can't lie
in an occurrence, so it ends a run, and runs shorter than the shortest window are left out of the index. Each shard gets a suffix
order, its Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions; all windows are searched
backward at once, occurrences are located by walking to a sample, and spans that overlap or touch are merged.

Nothing is shuffled: a shard belongs to one task, which rebuilds it if an executor is lost. The phrases are broadcast.
A benchmark over `slice_bytes` is worked off in slices, one after the other: the driver and the executors hold the phrases
of one slice, its spans are written, and those of all slices are merged by distinct text.

Null text has no words. Item ids are taken as strings. Benchmark items with null text have no windows; hits of items with
a null id count, but can't be named; items that share an id are one item. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ALNUM, arrow_rows, free_prefix, id_and_text, join_counted, materialize

SCHEMA = "doc_id long, n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>"
SAMPLE = 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(ALNUM).split()


class Phrases:
    """The windows of one slice of the benchmark: rows of word numbers (from 1), aligned to the right, and the items of each."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int) -> None:
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.items = [sorted(x for x in s if x is not None) for s in found.values()]
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.words = np.zeros((len(found), window), np.int64)
        for row, w in zip(self.words, found, strict=True):
            row[window - len(w) :] = w
        self.shortest = int(self.lengths.min()) if len(found) else 0


class BitRank:
    """Bits with the number of ones before any place: packed words and a count before each."""

    def __init__(self, bits: np.ndarray) -> None:
        self.n = bits.size
        self.packed = np.packbits(np.concatenate([bits, np.zeros(128 - bits.size % 64, bits.dtype)]), bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.packed), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.packed[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Symbols of a sequence, highest bit first; each level is sorted stably by its bit."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.levels, self.zeros, self.bits = [], [], max(1, int(n_symbols - 1).bit_length())
        for level in range(self.bits - 1, -1, -1):
            one = (symbols >> level & 1).astype(np.uint8)
            self.levels.append(BitRank(one))
            self.zeros.append(int(one.size - one.sum()))
            symbols = np.concatenate([symbols[one == 0], symbols[one == 1]])
        self.starts = self.walk(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, zeros, shift in zip(self.levels, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            ones = level.ones(at)
            at = np.where(symbols >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self.walk(symbols, at) - self.starts[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at these places, and how often each stands before."""
        symbols = np.zeros(at.size, np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            bit, ones = level.get(at).astype(np.int64), level.ones(at)
            symbols = symbols << 1 | bit
            at = np.where(bit, zeros + ones, at - ones)
        return symbols, at - self.starts[symbols]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of text in the order of their suffixes, by prefix doubling over what is still tied; each 0 is a separator, less than all after it and than later separators."""
    n = text.size
    key = np.where(text == 0, np.arange(n), text + n)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]]))
    size = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, size)
    tied, step = order[np.repeat(size > 1, size)], 1
    while tied.size:
        old = rank[tied]
        key = old * n + rank[tied + step]
        o = np.argsort(key, kind="stable")
        tied, key, old = tied[o], key[o], old[o]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        group = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        size = np.diff(np.append(first, tied.size))
        within = first - group[np.searchsorted(group, first, "right") - 1]
        rank[tied] = np.repeat(old[first] + within, size)
        tied = tied[np.repeat(size > 1, size)]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


class FMIndex:
    """Backward search and location over a sequence of numbers from 1, in runs that each end with a 0."""

    def __init__(self, text: np.ndarray, n_symbols: int) -> None:
        order = suffix_order(text)
        self.n = text.size
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.tree = WaveletMatrix(text[order - 1], n_symbols)
        marked = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.marks, self.samples = BitRank(marked.astype(np.uint8)), order[marked]

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 row of each pattern (a row of words, aligned to the right)."""
        lo, hi = np.zeros(lengths.size, np.int64), np.full(lengths.size, self.n)
        for step in range(1, words.shape[1] + 1):
            on = np.flatnonzero((lengths >= step) & (lo < hi))
            c = words[on, -step]
            lo[on], hi[on] = self.below[c] + self.tree.rank(c, lo[on]), self.below[c] + self.tree.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence; every run's start is sampled, so no walk leaves its run."""
        rows, places, on, steps = rows.copy(), np.empty(rows.size, np.int64), np.arange(rows.size), 0
        while on.size:
            marked = self.marks.get(rows[on]).astype(bool)
            places[on[marked]] = self.samples[self.marks.ones(rows[on[marked]])] + steps
            on = on[~marked]
            c, before = self.tree.access(rows[on])
            rows[on] = self.below[c] + before
            steps += 1
        return places


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans, sorted by start, as the fewest that cover them."""
    reach = np.maximum.accumulate(ends)
    fresh = np.concatenate([[True], starts[1:] > reach[:-1]])
    at = np.flatnonzero(fresh)
    return starts[at], reach[np.append(at[1:] - 1, ends.size - 1)]


class Shard:
    """Documents of one index, as runs of word numbers."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases, self.words = phrases, 0
        self.docs: list[tuple[int | None, int]] = []
        self.runs: list[np.ndarray] = []
        self.run_doc: list[int] = []
        self.run_at: list[int] = []

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = words_of(text)
        if self.phrases.shortest:
            get = self.phrases.number.get
            ids = np.array([0, *[get(w, 0) for w in words], 0], np.int64)
            edges = np.flatnonzero((ids[1:] == 0) != (ids[:-1] == 0))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a >= self.phrases.shortest:
                    self.runs.append(ids[a + 1 : b + 2])
                    self.run_doc.append(len(self.docs))
                    self.run_at.append(a)
        self.docs.append((doc_id, len(words)))
        self.words += len(words)

    def result(self) -> list[tuple]:
        """A row for each document, in the order in which they came."""
        rows = [[d, n, 0, [], []] for d, n in self.docs]
        if self.runs:
            starts = np.cumsum([0, *(r.size for r in self.runs)])[:-1]
            index = FMIndex(np.concatenate(self.runs), len(self.phrases.number) + 1)
            lo, hi = index.search(self.phrases.words, self.phrases.lengths)
            count = np.maximum(hi - lo, 0)
            pattern = np.repeat(np.arange(count.size), count)
            place = index.locate(np.arange(pattern.size) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count))
            run = np.searchsorted(starts, place, "right") - 1
            doc, start = np.array(self.run_doc, np.int64)[run], np.array(self.run_at, np.int64)[run] + place - starts[run]
            order = np.lexsort((start, doc))
            doc, start, pattern = doc[order], start[order], pattern[order]
            end = start + self.phrases.lengths[pattern]
            cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if doc.size else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                s, e = merged(start[a:b], end[a:b])
                items = set().union(*(self.phrases.items[p] for p in np.unique(pattern[a:b])))
                rows[doc[a]][2:] = int((e - s).sum()), [{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)], sorted(items)
        return [tuple(r) for r in rows]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_words: int = 2_000_000, slice_bytes: int = 16 << 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit (words in occurrences), spans (merged, in words) and items (their ids as strings, sorted)."""
    keyed = id_and_text(docs, id_col, text_col)
    n, items = benchmark_items(benchmark, slice_bytes, item_col, item_text_col)
    if n == 1:
        return _search(keyed, phrases_of(items, 0, 1, window), shard_words)
    return _search_slices(keyed, items, n, window, shard_words).drop("key")


def benchmark_items(benchmark: DataFrame, slice_bytes: int, item_col: str, item_text_col: str) -> tuple[int, DataFrame]:
    """The number of slices of about slice_bytes of text, and the benchmark as (item, text)."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // slice_bytes)), items


def phrases_of(items: DataFrame, k: int, n: int, window: int) -> Phrases:
    """The windows of slice k of n, small enough to send to every executor."""
    return Phrases((tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()), window)


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_words: int = 2_000_000, slice_bytes: int = 16 << 20,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of docs that `is_contaminated` doesn't hold for, with all their columns; a benchmark of one slice needs no shuffle."""
    n, items = benchmark_items(benchmark, slice_bytes, item_col, item_text_col)
    if n > 1:
        own, text = free_prefix(docs.columns), F.col(f"`{text_col}`").cast("string")
        keyed = docs.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"))
        dirty = _search_slices(keyed, items, n, window, shard_words).where(is_contaminated()).select(F.col("key").alias(own + "key")).distinct()
        # a text with very many copies, clean or not, is dealt over 32 places
        dirty = dirty.withColumn(own + "salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
        salted = docs.withColumn(own + "key", F.xxhash64(text)).withColumn(own + "salt", (F.rand(1) * 32).cast("int"))
        return salted.join(dirty, [own + "key", own + "salt"], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    sent = docs.sparkSession.sparkContext.broadcast(phrases_of(items, 0, 1, window))

    def scan(batches: Iterable) -> Iterator:
        shard, held = Shard(sent.value), []

        def out() -> Iterator:
            clean = [not (hit and 20 * hit >= n) for _, n, hit, _, _ in shard.result()]
            for batch in held:
                yield batch.filter(pa.array(clean[: batch.num_rows], pa.bool_()))
                del clean[: batch.num_rows]

        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held.append(part)
                for text in part.column(text_col).cast(pa.string()).to_pylist():
                    shard.add(None, text)
                if shard.words >= shard_words or len(shard.docs) >= 50_000:
                    yield from out()
                    shard, held = Shard(sent.value), []
        yield from out()

    return docs.mapInArrow(scan, docs.schema)


def _search(keyed: DataFrame, phrases: Phrases, shard_words: int) -> DataFrame:
    """A row for each of keyed (doc_id, text, perhaps key)."""
    sent, with_key = keyed.sparkSession.sparkContext.broadcast(phrases), "key" in keyed.columns

    def scan(batches: Iterable) -> Iterator:
        import pyarrow as pa

        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_hit": pa.int64(), "spans": spans, "items": pa.list_(pa.string())} | ({"key": pa.int64()} if with_key else {})
        shard, keys = Shard(sent.value), []

        def out() -> pa.RecordBatch:
            columns = [*zip(*shard.result(), strict=True)] + [keys] * with_key
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

        for doc_id, text, *key in arrow_rows(batches):
            shard.add(doc_id, text)
            keys += key
            if shard.words >= shard_words or len(shard.docs) >= 50_000:
                yield out()
                shard, keys = Shard(sent.value), []
        if shard.docs:
            yield out()

    return keyed.mapInArrow(scan, SCHEMA + (", key long" if with_key else ""))


def _search_slices(keyed: DataFrame, items: DataFrame, n: int, window: int, shard_words: int) -> DataFrame:
    """As `_search` with key, over n slices in turn: each one's result is written, then spans are merged for each distinct text and joined to all its copies."""
    keyed, every, hits = keyed.withColumn("key", F.xxhash64("text")), None, None
    for k in range(n):
        found = materialize(_search(keyed, phrases_of(items, k, n, window), shard_words), f"slice-{k}")
        every = found.select("doc_id", "n_words", "key") if every is None else every
        part = found.where("n_hit > 0").groupBy("key").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))  # copies have the same
        hits = part if hits is None else hits.unionByName(part)
    order, zero = F.array_sort(F.flatten(F.collect_list("spans"))), F.array().cast("array<struct<start:int,end:int>>")  # a row for each slice
    joined = F.aggregate(
        "spans", zero,
        lambda done, s: F.when((F.size(done) > 0) & (s["start"] <= F.element_at(done, -1)["end"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(s))),
    )
    merged = hits.groupBy("key").agg(order.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).withColumn("spans", joined)
    merged = materialize(every.groupBy("key").agg(F.count("*").alias("n")).join(merged, "key", "left"), "merged-spans")
    spans, names = F.coalesce("spans", zero), F.coalesce("items", F.array().cast("array<string>"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    out = join_counted(every, merged, ["key"], every.count()).withColumns({"spans": spans, "items": names})
    return out.select("doc_id", "n_words", hit.alias("n_hit"), "spans", "items", "key")


def is_contaminated() -> Column:
    """Hit words make up a twentieth of the text or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def cut_spans(text: str, spans: list[dict]) -> str:
    """text without the words of the spans and what stands between them."""
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(_LOWER).decode())]
    for s in reversed(spans):
        text = text[: at[s["start"]][0]] + text[at[s["end"] - 1][1] :]
    return text
