"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as its own hashed embedding and the mean of its character trigrams' embeddings. Windows of `WIDTH` words
overlap by WIDTH - STRIDE; every window of every whole text is scored. A document's logit is half its highest window's and
half its windows' mean, so that neither one toxic passage nor a thin spread of toxic words is lost, and a single odd word in
a long text counts little.

Training: a bounded sample of labelled documents (`max_toxic` and `max_clean` ids with texts of up to `max_bytes`, the first
by a hash). Labels are of documents, so a toxic one is taught by its highest window, at first by the evidence of its
words (log odds of hashed words and trigrams between the classes, which also start the embeddings), then by the network;
clean ones by their highest and by random ones. `NETS` networks are fitted, each without another part of the sample, with their
weights averaged over the last steps; their mean decides. Together the parts that were left out give the cut between the
classes, which gets a score of THRESHOLD. Rows for which `held_out` is true are never learnt from.

A text without words (or null) scores 0; a null id isn't held out and has no label; an id with both labels is toxic; rows
that repeat are each scored; other columns are not read. Without labels of both kinds every score is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ALNUM, arrow_rows, chunks, id_and_text

WIDTH, STRIDE, HIDDEN, PART = 64, 48, 8, 8
WORD_ROWS, CHAR_ROWS = 1 << 16, 1 << 13
THRESHOLD = 0.7
#: Share of words that a batch sees by their characters alone, of a weight that each step takes away, and of a label given to the other class.
HIDE, DECAY, SMOOTH = 0.8, 1e-3, 0.1
#: Networks, parts of the sample (each net leaves one out), and the share of the running mean of weights that a step keeps.
NETS, PARTS, KEEP = 2, 5, 0.98


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(ALNUM).split()


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character embedding for each word, one after the other, and the place where each word's begin."""
    raw = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.int64)
    ends = np.cumsum([len(w) + 2 for w in words])
    code = (raw[:-2] * 65599 + raw[1:-1] * 257 + raw[2:]) * 2654435761 >> 7 & CHAR_ROWS - 1
    inside = np.ones(code.size, bool)
    for k in (1, 2):
        inside[ends[:-1] - k] = False
    counts = ends - np.concatenate([[0], ends[:-1]]) - 2
    return code[inside], np.concatenate([[0], np.cumsum(counts)[:-1]])


def window_starts(n: int) -> range:
    return range(0, max(1, -(-(n - WIDTH) // STRIDE) + 1) * STRIDE, STRIDE)


class Words:
    """Distinct words of some texts, their windows as rows of numbers (0: no word), and the document of each window."""

    def __init__(self, texts: Iterable[list[bytes]]) -> None:
        number: dict[bytes, int] = {}
        rows, self.doc = [], []
        for d, words in enumerate(texts):
            ids = np.array([number.setdefault(w, len(number) + 1) for w in words], np.int32)
            starts = window_starts(len(ids))
            padded = np.zeros(starts[-1] + WIDTH, np.int32)
            padded[: len(ids)] = ids
            rows.append(np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[::STRIDE])
            self.doc += [d] * len(starts)
        self.windows, self.doc = np.concatenate(rows), np.array(self.doc)
        words = list(number)
        self.hashes = np.array([zlib.crc32(w) & WORD_ROWS - 1 for w in words], np.int64)
        self.grams, self.gram_at = trigrams(words) if words else (np.empty(0, np.int64), np.empty(0, np.int64))
        self.gram_n = np.diff(np.append(self.gram_at, self.grams.size))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ToxicityNet:
    """Parameters by name; `a` and `b` of a weight's name stand for the two directions."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        f = lambda *s, k=0.1: rng.normal(0, k, s).astype(np.float32)
        self.p = {"word": f(WORD_ROWS, PART, k=0.02), "char": f(CHAR_ROWS, PART, k=0.02), "v": f(2 * HIDDEN, k=0.3), "u": f(2 * HIDDEN, k=0.3), "bias": np.array([-1.0], np.float32)}
        for d in "ab":
            self.p |= {"W" + d: f(2 * PART, 3 * HIDDEN, k=0.4), "U" + d: f(HIDDEN, 3 * HIDDEN, k=0.3), "c" + d: np.zeros(3 * HIDDEN, np.float32)}

    def inputs(self, w: Words, hidden: np.ndarray | None = None) -> np.ndarray:
        """A row for each distinct word; row 0 is no word. hidden: words without their own embedding."""
        x = np.zeros((len(w.hashes) + 1, 2 * PART), np.float32)
        if len(w.hashes):
            x[1:, :PART] = self.p["word"][w.hashes]
            if hidden is not None:
                x[1:][hidden, :PART] = 0
            x[1:, PART:] = np.add.reduceat(self.p["char"][w.grams], w.gram_at, axis=0) / w.gram_n[:, None]
        return x

    def _run(self, d: str, table: np.ndarray, ids: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of one direction, in the order of the words; keep gets what the backward pass needs."""
        n, U, K = len(ids), self.p["U" + d], HIDDEN
        h, out = np.zeros((n, K), np.float32), np.empty((n, WIDTH, K), np.float32)
        for t in range(WIDTH) if d == "a" else range(WIDTH - 1, -1, -1):
            at = ids[:, t]
            x, g = table[at], h @ U
            zr = sigmoid(x[:, : 2 * K] + g[:, : 2 * K])
            z, r, gn = zr[:, :K], zr[:, K:], g[:, 2 * K :]
            new = np.tanh(x[:, 2 * K :] + r * gn)
            before = h
            h = (new + z * (h - new)) * (at > 0)[:, None]
            out[:, t] = h
            if keep is not None:
                keep.append((t, before, z, r, gn, new))
        return out

    def forward(self, x: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The logit of each window."""
        states = []
        for d in "ab":
            steps = None if keep is None else keep.setdefault(d, [])
            states.append(self._run(d, x @ self.p["W" + d] + self.p["c" + d], ids, steps))
        h = np.concatenate(states, axis=2)
        e = np.where(ids > 0, h @ self.p["v"], -np.inf)
        top = e.max(axis=1, keepdims=True)
        a = np.exp(e - np.where(np.isfinite(top), top, 0))
        a /= np.maximum(a.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,ntk->nk", a, h)
        if keep is not None:
            keep |= {"h": h, "w": a, "pooled": pooled}
        return pooled @ self.p["u"] + self.p["bias"]

    def gradients(self, w: Words, ids: np.ndarray, y: np.ndarray, hidden: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss of windows, and its gradient for every parameter."""
        x, keep = self.inputs(w, hidden), {}
        logit = self.forward(x, ids, keep)
        d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        h, a, g = keep["h"], keep["w"], {}
        g["bias"], g["u"] = np.array([d.sum()], np.float32), keep["pooled"].T @ d
        dp = d[:, None] * self.p["u"]
        da = np.einsum("ntk,nk->nt", h, dp)
        de = a * (da - (a * da).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("nt,ntk->k", de, h)
        dh_all = a[:, :, None] * dp[:, None, :] + de[:, :, None] * self.p["v"]
        dx, K = np.zeros_like(x), HIDDEN
        for k, name in enumerate("ab"):
            U, W = self.p["U" + name], self.p["W" + name]
            carry, at_all, into, through, held = np.zeros((len(ids), K), np.float32), [], [], [], []
            for t, before, z, r, gn, new in reversed(keep[name]):
                dh = (dh_all[:, t, k * K : (k + 1) * K] + carry) * (ids[:, t] > 0)[:, None]
                dn = dh * (1 - z) * (1 - new * new)
                dg = np.concatenate([dh * (before - new) * z * (1 - z), dn * gn * r * (1 - r), dn], axis=1)
                back = dg.copy()
                back[:, 2 * K :] *= r
                carry = dh * z + back @ U.T
                for rows, row in zip((at_all, into, through, held), (ids[:, t], dg, back, before), strict=True):
                    rows.append(row)
            at_all, into = np.concatenate(at_all), np.concatenate(into)
            dU, dtable, order = np.concatenate(held).T @ np.concatenate(through), np.zeros((len(x), 3 * K), into.dtype), np.argsort(at_all, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(at_all[order]) > 0]))
            dtable[at_all[order[first]]] = np.add.reduceat(into[order], first, axis=0)
            g["U" + name], g["W" + name], g["c" + name] = dU, x.T @ dtable, dtable.sum(axis=0)
            dx += dtable @ W.T
        g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        if hidden is not None:
            dx[1:][hidden, :PART] = 0
        np.add.at(g["word"], w.hashes, dx[1:, :PART])
        np.add.at(g["char"], w.grams, np.repeat(dx[1:, PART:] / w.gram_n[:, None], w.gram_n, axis=0))
        return float(np.mean(np.logaddexp(0, logit) - y * logit)), g

    def window_logits(self, w: Words) -> np.ndarray:
        x = self.inputs(w)
        return np.concatenate([self.forward(x, w.windows[i : i + 1024]) for i in range(0, len(w.windows), 1024)])


class ToxicityModel:
    """Networks whose mean logit decides, and the logit that gets THRESHOLD; without networks every score is 0."""

    def __init__(self, nets: list[ToxicityNet], shift: float = 0.0) -> None:
        self.nets, self.shift = nets, shift

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The score of each whole text."""
        if not self.nets or not texts:
            return np.zeros(len(texts))
        w = Words(map(words_of, texts))
        logit = pooled(w, sum(net.window_logits(w) for net in self.nets) / len(self.nets), len(texts))
        return np.round(sigmoid(logit - self.shift + np.log(THRESHOLD / (1 - THRESHOLD))), 6)  # sums of single precision hang on the block of texts


def pooled(w: Words, logits: np.ndarray, n: int) -> np.ndarray:
    """Half the highest and half the mean logit of each document's windows; without words: -inf."""
    logits = logits.astype(float)
    top, total = np.full(n, -np.inf), np.bincount(w.doc, logits, n)
    np.maximum.at(top, w.doc, np.where(w.windows[:, 0] > 0, logits, -np.inf))
    return (top + total / np.maximum(np.bincount(w.doc, minlength=n), 1)) / 2


def evidence(rows: list[np.ndarray], toxic: np.ndarray, n_rows: int) -> np.ndarray:
    """Shrunken log odds of each hashed row between the classes; rows: the distinct ones of each document."""
    n = np.zeros((2, n_rows))
    for r, y in zip(rows, toxic, strict=True):
        n[int(y), r] += 1
    odds = np.log((n[1] + 0.5) / (toxic.sum() + 1)) - np.log((n[0] + 0.5) / ((1 - toxic).sum() + 1))
    return (odds * n.sum(axis=0) / (n.sum(axis=0) + 4)).astype(np.float32)


def train(texts: list[str], toxic: list[int], rounds: int = 4, steps: int = 60, batch: int = 64, seed: int = 5) -> ToxicityModel:
    """The networks fitted to whole texts, and the cut from the documents that each of them hasn't seen."""
    y = np.array(toxic, int)
    if len(y) < 2 or y.min() == y.max():
        return ToxicityModel([])
    words = Words(map(words_of, texts))
    part = np.full(len(y), -1)  # classes of fewer than PARTS documents are in every net's sample
    for c in (0, 1):
        at = np.flatnonzero(y == c)
        part[at] = np.arange(at.size) % PARTS if at.size >= PARTS else -1
    nets, unseen, of = [], [], []
    for k in range(NETS):
        net, logits = fit_net(words, y, part != k, rounds, steps, batch, seed + k)
        left = np.flatnonzero(part == k)
        left = left if len(set(y[left])) == 2 else np.arange(len(y))
        nets.append(net)
        unseen.append(pooled(words, logits, len(y))[left])
        of.append(y[left])
    unseen, of = np.concatenate(unseen), np.concatenate(of)
    return ToxicityModel(nets, best_cut(unseen[np.isfinite(unseen)], of[np.isfinite(unseen)]))


def fit_net(words: Words, y: np.ndarray, fit: np.ndarray, rounds: int, steps: int, batch: int, seed: int) -> tuple[ToxicityNet, np.ndarray]:
    """A network fitted to the documents `fit`, and its logits of all windows. Each batch has an empty window among the clean ones, and hides many words' own embeddings, so that their characters count."""
    net, rng = ToxicityNet(seed + 6), np.random.default_rng(seed)
    seen = _distinct(words, fit)
    word_rows = [np.unique(words.hashes[s - 1]) for s in seen]
    net.p["word"][:, 0] += evidence(word_rows, y[fit], WORD_ROWS) / 4
    spans = [np.unique(np.concatenate([words.grams[a : a + n] for a, n in zip(words.gram_at[s - 1], words.gram_n[s - 1], strict=True)]) if len(s) else np.empty(0, np.int64)) for s in seen]
    net.p["char"][:, 0] += evidence(spans, y[fit], CHAR_ROWS) / 4
    x = net.inputs(words)
    score = (x[:, 0] + 2 * x[:, PART])[words.windows].max(axis=1)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    mean = {k: v.copy() for k, v in net.p.items()}
    by_doc = np.split(np.arange(len(words.doc)), np.flatnonzero(np.diff(words.doc)) + 1)
    used, step = [np.flatnonzero(fit & (y == c)) for c in (0, 1)], 0
    for last in range(rounds - 1, -1, -1):
        top = np.array([i[np.argmax(score[i])] for i in by_doc])
        for _ in range(steps):
            step += 1
            bad, good = rng.choice(used[1], batch // 2), rng.choice(used[0], batch // 2)
            other = [by_doc[d][rng.integers(len(by_doc[d]))] for d in rng.choice(used[0], batch // 2)]
            at = np.concatenate([top[bad], top[good], other])
            part, (ids, hit) = _part(words, at), _local(words, at, len(bad))
            ids[-1] = 0
            _, g = net.gradients(part, ids, hit, rng.random(len(part.hashes)) < HIDE)
            _adam(net.p, g, moment, step)
            for name in net.p:
                if name != "bias":
                    net.p[name] *= 1 - DECAY
                mean[name] += (1 - KEEP) * (net.p[name] - mean[name]) if step > 20 else net.p[name] - mean[name]
        if not last:
            net.p = mean
        score = net.window_logits(words)
    return net, score


def _distinct(words: Words, fit: np.ndarray) -> list[np.ndarray]:
    starts = np.searchsorted(words.doc, np.arange(len(fit) + 1))
    return [u[u > 0] for d in np.flatnonzero(fit) for u in [np.unique(words.windows[starts[d] : starts[d + 1]])]]


def _part(words: Words, at: np.ndarray) -> Words:
    """The words of some windows only."""
    ids = np.unique(words.windows[at])
    ids = ids[ids > 0] - 1
    out = object.__new__(Words)
    out.hashes, out.gram_n = words.hashes[ids], words.gram_n[ids]
    out.gram_at = np.concatenate([[0], np.cumsum(out.gram_n)[:-1]]) if len(ids) else np.empty(0, np.int64)
    out.grams = words.grams[np.repeat(words.gram_at[ids] - out.gram_at, out.gram_n) + np.arange(out.gram_n.sum())]
    return out


def _local(words: Words, at: np.ndarray, n_bad: int) -> tuple[np.ndarray, np.ndarray]:
    windows = words.windows[at]
    ids = np.unique(windows)
    ids = ids[ids > 0]
    y = np.full(len(at), SMOOTH)
    y[:n_bad] = 1 - SMOOTH
    return np.where(windows > 0, np.searchsorted(ids, windows) + 1, 0), y


def _adam(p: dict, g: dict, moment: dict, step: int, rate: float = 0.01) -> None:
    for k, grad in g.items():
        m, v = moment[k]
        at = np.flatnonzero(grad.any(axis=1)) if k in ("word", "char") else slice(None)
        m[at] = 0.9 * m[at] + 0.1 * grad[at]
        v[at] = 0.999 * v[at] + 0.001 * grad[at] ** 2
        p[k][at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.999**step)) + 1e-8)


def best_cut(logits: np.ndarray, y: np.ndarray, resamples: int = 50, seed: int = 3) -> float:
    """The median, over resampled documents, of the middle of the best gap: most toxic less clean documents above it, by their shares, clean ones counted three times."""
    rng, cuts = np.random.default_rng(seed), []
    for n in range(resamples + 1):
        at = rng.integers(0, len(y), len(y)) if n else np.arange(len(y))
        order = at[np.argsort(-logits[at], kind="stable")]
        s, t = logits[order], y[order]
        if n and t.min() == t.max():
            continue
        gain = np.cumsum(t) / max(1, t.sum()) - 3 * np.cumsum(1 - t) / max(1, (1 - t).sum())
        gain[:-1][s[:-1] == s[1:]] = -np.inf
        k = int(np.argmax(gain))
        cuts.append(float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] - 1e-3))
    return float(np.median(cuts))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are for evaluation only."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, max_toxic: int = 2000, max_clean: int = 4000, max_bytes: int = 16 << 10,
    id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic",
) -> ToxicityModel:
    """Trained on the driver on at most max_toxic + max_clean texts of max_bytes each."""
    known = labels.select(F.col(f"`{label_id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).dropna().where(~held_out())
    short = id_and_text(docs, id_col, text_col).where(F.octet_length("text") <= max_bytes)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).join(short.select("doc_id").distinct(), "doc_id")
    ids = [known.where(which).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for which, n in (("y > 0", max_toxic), ("y <= 0", max_clean))]
    picked = F.broadcast(ids[0].unionByName(ids[1]))  # max_toxic + max_clean rows at most
    rows = short.join(picked, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    rows.sort()
    return train([r["text"] for r in rows], [int(r["y"] > 0) for r in rows])


def score_toxicity(docs: DataFrame, net: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def scan(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for block in chunks(arrow_rows(batches), 1 << 20, lambda r: len(r[1] or "")):
            ids, texts = zip(*block, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sent.value.scores(list(texts)))], ["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(scan, "doc_id long, score double")


def toxicity_score(net: ToxicityModel, text: Column) -> Column:
    """The score as a column, for filters that keep the other columns."""
    sent = SparkSession.active().sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(texts):  # noqa: ANN001, ANN202
        parts = [sent.value.scores(b) for b in chunks(texts, 1 << 20, lambda t: len(t or ""))]
        return texts.__class__(np.concatenate(parts) if parts else [], dtype=float)

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels, **options))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
