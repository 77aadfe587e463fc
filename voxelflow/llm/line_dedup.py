"""Line dedup across documents: hashed lines in range partitions, sorted by document, streamed; results are keep bitmaps.

A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of `min_chars` code points or more that
at least `min_docs` documents hold lose all their lines except those in the largest id. Texts are not shuffled: a
document sends one row for each distinct key, with a 128-bit hash and the places of its lines. Rows are range-partitioned
by hash and then document, so the rows of a very common line spread over many partitions, and each partition is
streamed in the order of hash and descending document. A run that begins inside a partition has its largest document
there, and is decided at its third document. Only a partition's first run (which may have begun before) and the start
of its last one are passed on undecided; their documents are counted by hash with partial sums, and what is joined back is
at most two hashes for each partition.

Null text is one empty line. Rows with a null id keep all lines and don't count as documents. Rows that share an id are
one document; each distinct text of it has its own bitmap, and repeated rows have the same one. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_rows, free_prefix, id_and_text, materialize

BLANK = " \t\n\v\f\r"
LINE = "h1 long, h2 long, doc_id long, text_key long, at array<int>"


def line_rows(text: str, min_chars: int) -> Iterator[tuple[bytes, list[int]]]:
    """16-byte hash and places of each distinct key of a text that is long enough."""
    import xxhash

    found: dict[bytes, list[int]] = {}
    for place, line in enumerate(text.split("\n")):
        if len(line) >= min_chars and len(line := line.strip(BLANK)) >= min_chars:
            found.setdefault(line.encode().lower(), []).append(place)
    for key, at in found.items():
        yield xxhash.xxh3_128_digest(key), at


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def hashed_lines(keyed: DataFrame, min_chars: int) -> DataFrame:
    """Rows of LINE for keyed (doc_id, text, text_key)."""

    def scan(batches: Iterable) -> Iterator:
        sent: set[tuple] = set()  # a row that is repeated within the task sends its lines once
        for batch in batches:
            out = []
            for doc_id, text, key in arrow_rows([batch]):
                if doc_id is not None and (doc_id, key) not in sent:
                    if len(sent) >= 1_000_000:
                        sent.clear()
                    sent.add((doc_id, key))
                    out += [(*_halves(h), doc_id, key, at) for h, at in line_rows(text or "", min_chars)]
                if len(out) >= 20_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return keyed.mapInArrow(scan, LINE)


def _batch(rows: list[tuple], flag: bool = False):
    import pyarrow as pa

    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] + [pa.bool_()] * flag
    names = ["h1", "h2", "doc_id", "text_key", "at"] + ["decided"] * flag
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def stream_runs(rows: Iterable[tuple], min_docs: int) -> Iterator[tuple]:
    """Decisions over one partition's sorted rows (h1, h2, doc_id, text_key, at): rows to drop (decided), and rows of its first and last hash that need the other partitions (undecided; a row without places only tells of its document).

    Held at any time: the rows of the first min_docs - 1 documents of a run. Rows of repeated documents, which stand together, count once.
    """
    run, docs, held, first, last = None, [], [], True, None
    for h1, h2, doc, key, at in rows:
        if (h1, h2, doc, key) == last:
            continue
        last = h1, h2, doc, key
        if (h1, h2) != run:
            if run is not None:
                first = False
            run, docs, held = (h1, h2), [], []
        if first:
            yield h1, h2, doc, key, at, False
            continue
        if (not docs or doc != docs[-1]) and len(docs) < min_docs:
            docs.append(doc)
        if len(docs) < min_docs:
            held.append((h1, h2, doc, key, at))
            continue
        for r in held:
            if r[2] != docs[0]:
                yield *r, True
        held = []
        yield h1, h2, doc, key, at, True
    if run is not None and not first:
        if len(docs) >= min_docs:
            for doc in docs:
                yield *run, doc, 0, [], False
        for r in held:
            yield *r, False


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (XXH64 of the text), n_lines, n_dropped and keep for each distinct row of docs with an id.

    keep is the zlib-compressed bitmap of lines kept, first line in the lowest bit of the first byte; null: all are kept.
    """
    keyed = id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    lines = materialize(hashed_lines(keyed, min_chars), "lines")

    def decide(batches: Iterable) -> Iterator:
        out = []
        for r in stream_runs(arrow_rows(batches), min_docs):
            out.append(r)
            if len(out) >= 20_000:
                yield _batch(out, True)
                out = []
        yield _batch(out, True)

    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("text_key")]
    told = materialize(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(decide, LINE + ", decided boolean"), "line-decisions")
    open_rows = told.where("NOT decided")
    common = open_rows.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("kept_in")).where(F.col("n") >= min_docs).drop("n")
    late = open_rows.join(F.broadcast(common), ["h1", "h2"]).where("doc_id <> kept_in").select("doc_id", "text_key", "at")  # two hashes a partition at most
    drops = told.where("decided").select("doc_id", "text_key", "at").unionByName(late).where(F.size("at") > 0)
    drops = drops.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("at")).alias("at"))
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    counts = keyed.where("doc_id IS NOT NULL").select("doc_id", "text_key", F.coalesce(n_lines, F.lit(1)).cast("long").alias("n_lines")).distinct()
    return counts.join(drops, ["doc_id", "text_key"], "left").select(
        "doc_id", "text_key", "n_lines", F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_dropped"), _bitmap()("n_lines", "at").alias("keep")
    )


def _bitmap():
    @F.pandas_udf("binary")
    def pack(n_lines, at):  # noqa: ANN001, ANN202
        return at.__class__([None if a is None or not len(a) else _pack(int(n), a) for n, a in zip(n_lines, at, strict=True)], dtype=object)

    return pack


def _pack(n: int, dropped: np.ndarray) -> bytes:
    bits = np.ones(n, np.uint8)
    bits[np.asarray(dropped, np.int64)] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes())


def unpack(keep: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n, bitorder="little").astype(bool)


def kept_text(text: str | None, keep: bytes | None) -> str:
    """The text's kept lines, joined by newlines; null text counts as empty."""
    text = text or ""
    if keep is None:
        return text
    lines = text.split("\n")
    return "\n".join(x for x, on in zip(lines, unpack(keep, len(lines)), strict=True) if on)


def drop_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text cut to its kept lines, and n_lines and n_dropped (columns so named are replaced); rows without an id keep all lines."""
    own = free_prefix(docs.columns)
    maps = materialize(keep_bitmaps(docs, min_chars, min_docs, id_col, text_col), "keep-bitmaps")
    maps = maps.select(*(F.col(c).alias(own + c) for c in maps.columns))
    text = F.col(f"`{text_col}`").cast("string")
    joined = docs.withColumn(own + "hash", F.xxhash64(text)).join(maps, (F.col(f"`{id_col}`").cast("long") == F.col(own + "doc_id")) & (F.col(own + "hash") == F.col(own + "text_key")), "left")
    n_lines = F.coalesce(own + "n_lines", F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)))
    kept = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    wide = joined.select(*(F.col(f"`{c}`") for c in kept), text.alias(text_col), n_lines.cast("long").alias("n_lines"), F.coalesce(own + "n_dropped", F.lit(0)).cast("long").alias("n_dropped"), own + "keep")

    def cut(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, keeps = part.column(text_col).to_pylist(), part.column(own + "keep").to_pylist()
                columns = dict(zip(part.schema.names[:-1], part.columns[:-1], strict=True))
                columns[text_col] = pa.array(map(kept_text, texts, keeps), pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return wide.mapInArrow(cut, wide.drop(own + "keep").schema)
