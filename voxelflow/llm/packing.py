"""Sequence packing by minimum bin slack over a histogram of lengths.

Texts become token ids and an end id; only a text of over `capacity` ids is cut, into full pieces and a rest. Which pieces
share a sequence depends on their lengths alone, so the driver plans on the histogram, which has at most `capacity`
rows at any input size: for the longest length left, a bitset subset-sum dynamic program over the lengths available
finds the fullest feasible combination, which is then removed as often as the counts allow. Pieces get their rank
among those of equal length (in parallel: ranks within buckets, plus the sizes of earlier buckets), and length and rank
look up the sequence and the offset in the plan.

Null text has no ids, so its piece is the end id alone; a null id stays null; equal rows are packed each; other columns
are not read.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_rows, chunks, id_and_text, materialize

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
MAX_CAPACITY = 1 << 16


class WordIds:
    """Token ids of texts as the library gives them, with each distinct word merged once.

    The vocabulary must lower-case, drop white space before it merges and mark word ends, so that a text's ids are those
    of its runs between white space, and a run's those of its words. Texts of settled characters are lower-cased and split
    here, and the library merges new words many at a time; texts with others (late Unicode, letters whose lower case
    depends on the library, perhaps special strings, U+001C to U+001F, which are white space to Python alone) it encodes whole.
    """

    def __init__(self, path: str, cached_words: int = 800_000) -> None:
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        if self.ids("a \t\n B") != self.ids("a") + self.ids("b"):
            raise ValueError(f"{path} doesn't lower-case and drop white space")
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.late = re.compile("[^\0-՗]").search
        self.merger = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": []}))
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.cached_words = cached_words
        self.words: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.words) > self.cached_words:
            self.words.clear()
        collecting = gc.isenabled()
        gc.disable()  # many short lists and no cycles
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        rows, number, words = [self._runs(t) for t in texts], {}, self.words
        put = number.setdefault  # a block's runs are numbered, so that the large table is asked once for each
        places = [None if r is None else [put(x, len(number)) for x in r] for r in rows]
        parts = [self._words(r) for r in number]
        self._merge([w for w in set().union(*parts) if w not in words])
        ids = [words[p[0]] if len(p) == 1 else words[p[0]] + words[p[1]] if len(p) == 2 else b"".join([words[w] for w in p]) for p in parts]
        return [self.ids(t) if at is None else b"".join(map(ids.__getitem__, at)) for t, at in zip(texts, places, strict=True)]

    def _runs(self, text: str) -> list[str] | None:
        if any(c in text for c in ("\x1c", "\x1d", "\x1e", "\x1f", "<|")):
            return None
        if not text.isascii():
            if "İ" in text or "Σ" in text or self.late(text):
                return None
            text = unicodedata.normalize("NFC", text)
        return text.lower().split()

    def _words(self, run: str) -> list[str] | tuple[str, ...]:
        """The words of a run; letters alone, or with one mark after them, need no pattern."""
        if run.isalpha():
            return (run,)
        if run[-1] in ".,;:!?" and (head := run[:-1]).isalpha():
            return head, run[-1]
        return self.split(run)

    def _merge(self, new: list[str]) -> None:
        """Encode new words as one text; each ends with a token that marks a word's end."""
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            ids = np.array(self.merger.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                raw, stops = ids.tobytes(), (4 * stops).tolist()
                self.words.update((w, raw[a:b]) for w, a, b in zip(part, [0, *stops[:-1]], stops, strict=True))
            else:
                self.words.update((w, self.ids(w)) for w in part)


@lru_cache(2)
def word_ids(vocabulary: str, cached_words: int = 800_000) -> WordIds:
    """One for each worker process; vocabulary is a file name of the public tokenizers, or a path."""
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), cached_words)


def pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str = "word_bpe_49k.json", end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", cached_words: int = 800_000) -> DataFrame:
    """A row of PIECE for each piece of each document; with_ids adds the ids themselves. A worker keeps the ids of about cached_words words (200 bytes each)."""

    def cut(batches: Iterable) -> Iterator:
        import pyarrow as pa

        kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
        kinds |= {"ids": pa.list_(pa.int32())} if with_ids else {}
        encode, end = word_ids(vocabulary, cached_words).encode, np.array([end_id], "<u4").tobytes()
        for block in chunks(arrow_rows(batches), 8 << 20, lambda r: len(r[1] or "")):
            rows = []
            for (doc_id, _), ids in zip(block, encode([t or "" for _, t in block]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] * with_ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    return id_and_text(docs, id_col, text_col).mapInArrow(cut, PIECE + (", ids array<int>" if with_ids else ""))


def fullest(available: dict[int, int], space: int) -> dict[int, int]:
    """How many of each length fill the space as far as can be: bit t of `reach` says that lengths tried so far can sum to t."""
    reach, whole, steps = 1, (1 << space + 1) - 1, []
    for length in sorted((x for x in available if x <= space), reverse=True):
        left, k = min(available[length], space // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << length * k & whole
            left -= k
            k *= 2
        if reach >> space & 1:
            break
    target, taken = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> target & 1:
            taken[length] = taken.get(length, 0) + k
            target -= length * k
    return taken


def minimum_slack_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how many sequences, how many pieces of each length in one of them), until no piece is left."""
    left = {length: n for length, n in counts.items() if n}
    plan = []
    while left:
        longest = max(left)
        taken = {longest: 1}
        if left[longest] == 1:
            others = {x: n for x, n in left.items() if x != longest}
        else:
            others = left | {longest: left[longest] - 1}
        for length, k in fullest(others, capacity - longest).items():
            taken[length] = taken.get(length, 0) + k
        times = min(left[x] // k for x, k in taken.items())
        plan.append((times, taken))
        for x, k in taken.items():
            left[x] -= times * k
            if not left[x]:
                del left[x]
    return plan


class PlanLookup:
    """Sequence and offset by length and rank."""

    def __init__(self, plan: list[tuple[int, dict[int, int]]]) -> None:
        rows, used, sequence = [], {}, 0
        for times, taken in plan:
            offset = 0
            for length, k in sorted(taken.items(), reverse=True):
                rank = used.get(length, 0)
                rows.append((length << 48 | rank, rank, k, sequence, offset))
                used[length] = rank + times * k
                offset += length * k
            sequence += times
        self.keys, self.rank, self.per, self.sequence, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, length << 48 | rank, "right") - 1
        nth = rank - self.rank[at]
        return self.sequence[at] + nth // self.per[at], self.offset[at] + nth % self.per[at] * length


def pack(parts: DataFrame, capacity: int = 2048, per_bucket: int = 50_000) -> DataFrame:
    """parts (PIECE, perhaps with more columns) with sequence_id and offset."""
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must be from 1 to {MAX_CAPACITY}: the histogram of lengths is planned on the driver")
    parts = materialize(parts, "pieces")
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}
    sent = parts.sparkSession.sparkContext.broadcast(PlanLookup(minimum_slack_plan(counts, capacity)))
    split = {x: -(-n // per_bucket) for x, n in counts.items() if n > per_bucket}
    n = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in split.items() for v in kv)), F.col("length").cast("int")), F.lit(1)) if split else F.lit(1)
    spread = parts.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), n))
    sizes = spread.groupBy("length", "__bucket").count()
    before = sizes.select("length", "__bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("__bucket")) - F.col("count")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = spread.withColumn("__within", within).join(before, ["length", "__bucket"]).withColumn("__rank", F.col("__before") + F.col("__within"))

    def place(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sequence, offset = sent.value.find(batch.column("length").to_numpy(), batch.column("__rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kept = parts.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in parts.dtypes) + ", sequence_id long, offset long"
    return ranked.select(*kept, "__rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str = "word_bpe_49k.json", end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", cached_words: int = 800_000) -> DataFrame:
    """PIECE (and ids), sequence_id and offset for every piece of every document."""
    return pack(pieces(docs, capacity, vocabulary, end_id, with_ids, id_col, text_col, cached_words), capacity)
