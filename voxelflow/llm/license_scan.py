"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; shingles are five words (a template of fewer
words is one shingle). A document matches a template if it holds `containment` or more of the template's distinct
shingles, wherever they stand in it.

Retrieval is sure, not likely: a text that lacks at most a share 1 - containment of S shingles is cut into few runs, as
each cut, replaced word or inserted block costs at least four shingles, so one run has `window_width(S)` shingles or more.
All windows of that width (at most MAX_WIDTH) of templates and documents are compared by the minimum of their shingles'
hashes; windows in an unbroken run are equal, have a similarity of 1, and share their minimum, so that one band of one row finds
them with probability 1 (the exceptions are a template's own repeated shingles, which may be lost more often). Documents and
templates that share a minimum are verified: all of the document's shingles are compared with the template's, word for word.

Nothing is shuffled. Templates are configuration; those beyond `slice_bytes` are scanned for in slices, each in a pass of
its own over the texts that the pass before wrote. Null text, or one of fewer words than a template, doesn't match; a null id stays null; equal
rows give equal rows; templates that hold one another, or differ by a version number, match together, and
their containments tell them apart; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_decontam import words_of
from .license_templates import default_templates
from .shared import arrow_rows, chunks, id_and_text, materialize

SHINGLE, MAX_WIDTH = 5, 8
MATCHES = "array<struct<template:string,start:int,end:int,containment:double>>"
_FAR = np.uint64(2**64 - 1)


def window_width(n: int, shingle: int, containment: float) -> int:
    """Shingles that the longest unbroken run has at least, where a text holds the share `containment` of a template's n."""
    lost = int((1 - containment) * n + 1e-9)
    runs = lost // max(1, shingle - 1) + 1
    return max(1, min(MAX_WIDTH, ceil((n - lost) / runs)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def shingle_hashes(words: np.ndarray, shingle: int) -> np.ndarray:
    """A hash of every `shingle` neighbouring word hashes."""
    n = max(0, words.size - shingle + 1)
    h = words[:n].copy()
    for k in range(1, shingle):
        h = h * np.uint64(0x100000001B3) + words[k : n + k]
    return _mix(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


class TemplateIndex:
    """Templates by shingle length and window width, each with the sorted minima of all windows and their templates."""

    def __init__(self, templates: dict[str, str], containment: float) -> None:
        import xxhash

        self.containment, self.digest = containment, xxhash.xxh64_intdigest
        self.names, self.shingles, self.hashes, self.classes = [], [], [], {}
        found: dict[tuple[int, int], set] = {}
        for name, text in sorted(templates.items()):
            words = words_of(text)
            if not words:
                raise ValueError(f"template {name} has no words")
            k = min(SHINGLE, len(words))
            hashes = shingle_hashes(np.array([self.digest(w) for w in words], np.uint64), k)
            width = window_width(hashes.size, k, containment)
            found.setdefault((k, width), set()).update((m, len(self.names)) for m in sliding_min(hashes, width).tolist())
            self.names.append(name)
            self.shingles.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)})
            self.hashes.append(np.unique(hashes))
        for key, pairs in found.items():
            minima, templates_of = zip(*sorted(pairs), strict=True)
            table = np.zeros(1 << 16, bool)
            minima = np.array(minima, np.uint64)
            table[minima >> np.uint64(48)] = True
            self.classes[key] = minima, np.array(templates_of), table

    def candidates(self, hashes: dict[int, np.ndarray], ends: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, template, shingle length) of documents with a window whose minimum is that of a template's."""
        out: set[tuple[int, int, int]] = set()
        for (k, width), (minima, templates, table) in self.classes.items():
            if hashes[k].size < width:
                continue
            m = sliding_min(hashes[k], width)
            at = np.flatnonzero(table[m >> np.uint64(48)])
            lo, hi = np.searchsorted(minima, m[at], "left"), np.searchsorted(minima, m[at], "right")
            for i, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                # a window over a border may have its minimum from either document
                docs = range(int(np.searchsorted(ends, i, "right")), int(np.searchsorted(ends, i + width + k - 2, "right")) + 1)
                out.update((d, int(t), k) for d in docs for t in templates[a:b])
        return sorted(out)

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """Matches of each text: template, its first word and last word + 1 in the text, and the share of its shingles found."""
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        out: list[list] = [[] for _ in texts]
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for x in words for w in x], np.int64)
        of_word = np.array([self.digest(w) for w in number], np.uint64)[ids] if ids.size else np.empty(0, np.uint64)
        hashes = {k: shingle_hashes(of_word, k) for k in {k for k, _ in self.classes}}
        for k, h in hashes.items():
            for back in range(1, k):  # no shingle goes over a document's end
                at = ends[:-1] - back
                h[at[(at >= 0) & (at < h.size)]] = _FAR
        for d, t, k in self.candidates(hashes, ends):
            if d >= len(texts):
                continue
            begin = int(ends[d] - sizes[d])
            mine = hashes[k][begin : max(begin, int(ends[d]) - k + 1)]
            hits = [i for i in np.flatnonzero(np.isin(mine, self.hashes[t])).tolist() if tuple(words[d][i : i + k]) in self.shingles[t]]
            share = len({tuple(words[d][i : i + k]) for i in hits}) / len(self.shingles[t])
            if share >= self.containment:
                out[d].append((self.names[t], hits[0], hits[-1] + k, share))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, slice_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and matches (template, first word, last word + 1, containment; by name) of every row of docs."""
    parts = list(chunks(sorted((templates or default_templates()).items()), slice_bytes, lambda x: len(x[1].encode())))
    rows = id_and_text(docs, id_col, text_col).withColumn("matches", F.array().cast(MATCHES))
    for n, part in enumerate(parts):
        rows = _pass(rows if n == 0 else materialize(rows, "license-pass"), TemplateIndex(dict(part), containment), with_text=n < len(parts) - 1)
    return rows.select("doc_id", "matches")


def _pass(rows: DataFrame, index: TemplateIndex, with_text: bool) -> DataFrame:
    """rows (doc_id, text, matches) with the index's matches added; text is left out after the last pass."""
    sent = rows.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterable) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("template", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))
        for block in chunks(arrow_rows(batches), 1 << 20, lambda r: len(r[1] or "")):
            found = sent.value.scan([t for _, t, _ in block])
            matches = [before + [dict(zip(("template", "start", "end", "containment"), m, strict=True)) for m in ms] for (_, _, before), ms in zip(block, found, strict=True)]
            columns = [pa.array([r[0] for r in block], pa.int64()), *([pa.array([r[1] for r in block], pa.string())] * with_text), pa.array(matches, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *["text"] * with_text, "matches"])

    return rows.mapInArrow(scan, f"doc_id long, {'text string, ' if with_text else ''}matches {MATCHES}")
