"""Token counts by byte-pair merging with a heap over a linked list.

A text is cut at the vocabulary's special strings and then into pieces; each piece starts as its UTF-8 bytes, and the
adjacent pair of lowest rank is merged until no pair has a rank. The count is initial symbols minus merges: identifiers
of the result are never built. There is no shuffle; each task holds one slice of an Arrow batch and a bounded table of
counts for pieces that it has met.

Null text counts as empty (0 tokens); a null id stays null; equal rows give equal rows; other columns are not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame

from .shared import arrow_rows, id_and_text

SCHEMA = "doc_id long, n_bytes long, n_tokens long"
#: Below this every character's class is the same in all Unicode versions of the libraries involved.
SETTLED = "՗"


class PairMerger:
    """Counts tokens as a byte-level BPE vocabulary in the tokenizers JSON form does."""

    def __init__(self, path: str, cached_pieces: int = 1_000_000) -> None:
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.of_byte = [vocab[c] for c in _byte_characters()]
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        import public_tokenizers

        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.late = regex.compile(f"[^\0-{SETTLED}]").search
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.cached_pieces = cached_pieces
        self.known: dict[str, int] = _Counts(self)

    def count(self, text: str) -> int:
        """Tokens of one whole text; a special string inside it is one token."""
        total = 0
        if self.at_special and any(s in text for s in self.specials):
            total = len(self.at_special.findall(text))
            parts = self.at_special.split(text)
        else:
            parts = (text,)
        for part in parts:
            total += sum(map(self.known.__getitem__, self.split(part)))
        if len(self.known) > self.cached_pieces:
            self.known.clear()
        return total

    def split(self, text: str) -> list[str]:
        """Pieces as the library cuts them. It decides itself on texts with code points that this Python doesn't know as assigned: later Unicode versions class them differently."""
        if self.late(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.pieces(text)

    def merge(self, piece: str) -> int:
        """Symbols left of one piece. The heap holds rank and position of each adjacent pair; an entry whose pair has changed since is passed over."""
        sym = [self.of_byte[b] for b in piece.encode()]
        n = left = len(sym)
        rank, merged = self.rank.get, self.merged
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(sym[i] << 20 | sym[i + 1])) is not None]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if sym[i] < 0 or j >= n or rank(sym[i] << 20 | sym[j]) != r:
                continue
            sym[i], sym[j] = merged[r], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := rank(sym[i] << 20 | sym[k])) is not None:
                    heappush(heap, s << 32 | i)
            if (h := before[i]) >= 0 and (s := rank(sym[h] << 20 | sym[i])) is not None:
                heappush(heap, s << 32 | h)
        return left


class _Counts(dict):
    """Counts by piece, found when first asked for; long pieces aren't kept."""

    def __init__(self, merger: PairMerger) -> None:
        self.merger = merger

    def __missing__(self, piece: str) -> int:
        n = self.merger.merge(piece)
        if len(piece) <= 64:
            self[piece] = n
        return n


def _byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself if printable Latin-1, else the next free one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@lru_cache(2)
def merger(vocabulary: str) -> PairMerger:
    """One for each worker process; vocabulary is a file name of the public tokenizers, or a path."""
    import public_tokenizers

    return PairMerger(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens for every row of docs."""

    def count(batches: Iterable) -> Iterator:
        import pyarrow as pa

        tokens = merger(vocabulary)
        for batch in batches:
            rows = [(i, len((t or "").encode()), tokens.count(t or "")) for i, t in arrow_rows([batch])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], ["doc_id", "n_bytes", "n_tokens"])

    return id_and_text(docs, id_col, text_col).mapInArrow(count, SCHEMA)
