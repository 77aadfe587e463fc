"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import collections
import functools
import hashlib
import re
import zlib
from dataclasses import replace

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelflow.llm import fm_decontam, kd_sharding, license_scan, license_templates, line_dedup, packing, quality_forest, shared, simhash_dedup, token_counts, toxicity_gru, url_filter

LINE = "This very common line stands in many documents."
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
ITEM = " ".join(WORDS)
TEXTS = [
    (1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "one two three"), (6, f"{LINE}\nunlike 6\n{LINE}"), (7, f"  {LINE.upper()}\r\nunlike 7"), (8, f"unlike 8\n{LINE}\n"),
    (9, ITEM), (10, "before " + ITEM + " after " + "x y z " * 200), (11, "a " * 60_000), (12, "A\x85b\u2003c\x1cd İΣ ſ <|endoftext|> é"), (13, "same text here with several words in it"),
    (14, "same text here with several words in it"), (14, "same text here with several words in it"), (15, "Released under the MIT License."), (16, "x" * 50_000), (None, "no id " + LINE), (None, None), (17, f"{LINE}\nunlike 17"), (17, f"{LINE}\nunlike 17"), (17, f"{LINE}\nother 17"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), 1, 2, "k", 3) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket int, key long, fp string, n_lines long")


def asc_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def expect(f):
    return sorted(((i, *f(t)) for i, t in TEXTS), key=repr)


def test_token_counts(docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert rows(token_counts.token_counts(docs), "doc_id", "n_bytes", "n_tokens") == expect(lambda t: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)))


def slow_print(t, shingle=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", asc_lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints, max_bits=(4,)):
    """The first of each component of prints (tuples of a fingerprint for each of max_bits)."""
    left, out = dict.fromkeys(prints), {}
    for start in left:
        if start in out:
            continue
        out[start], queue = start, [start]
        while queue:
            u = queue.pop()
            for v in left:
                if v not in out and all((x ^ y).bit_count() <= most for x, y, most in zip(u, v, max_bits, strict=True)):
                    out[v] = start
                    queue.append(v)
    return out


signed = lambda p: p - (1 << 64) if p >> 63 else p


@pytest.mark.parametrize("by", [simhash_dedup.FOUR_BITS, replace(simhash_dedup.FOUR_BITS, hot=1), simhash_dedup.SIMILAR, replace(simhash_dedup.SIMILAR, hot=1)])
def test_simhash(docs, by):
    prints = [(i, tuple(slow_print(t, n) for n in by.shingles)) for i, t in TEXTS]
    comp = slow_components([p for _, p in prints], by.max_bits)
    least = {}
    for i, p in prints:
        if i is not None:
            least[comp[p]] = min(i, least.get(comp[p], i))
    expected = sorted(((i, *map(signed, p), least.get(comp[p])) for i, p in prints), key=repr)
    assert rows(simhash_dedup.simhash_groups(docs, by), "doc_id", *["fp", "fp2"][: len(by.shingles)], "component_id") == expected


@pytest.mark.parametrize("by", [simhash_dedup.FOUR_BITS, replace(simhash_dedup.FOUR_BITS, hot=3), simhash_dedup.SIMILAR, replace(simhash_dedup.SIMILAR, hot=3)])
def test_near_fingerprints_connect(spark, by):
    rng = np.random.default_rng(1)
    prints, spread = set(), [n + 3 for n in by.max_bits]
    for base in rng.integers(0, 2**63, (4, len(by.max_bits))).tolist():
        for _ in range(60):
            prints.add(tuple(x ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, n), replace=False)) for x, n in zip(base, spread, strict=True)))
    from voxelflow.llm.components import connected_components

    names = ["fp", "fp2"][: len(by.max_bits)]
    df = spark.createDataFrame([tuple(map(signed, p)) for p in prints], ", ".join(f"{n} long" for n in names))
    key = lambda x: tuple(x) if isinstance(x, tuple) else (x,)
    got = {key(r["node"]): key(r["root"]) for r in connected_components(simhash_dedup.close_links(df, by)).collect()}
    want = slow_components(list(prints), by.max_bits)
    pairs = {(got.get(s := tuple(map(signed, p)), s), want[p]) for p in prints}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) > 3


def test_blocks_meet_for_every_close_pair():
    rng = np.random.default_rng(4)
    for by in (simhash_dedup.FOUR_BITS, simhash_dedup.SIMILAR):
        for _ in range(300):
            a = int(rng.integers(0, 2**63))
            b = a ^ sum(1 << int(k) for k in rng.choice(64, by.max_bits[0], replace=False))
            buckets = [{(k, signed(x % (1 << 64)) & m ^ flip) for k, m, flip in by.buckets} for x in (a, b)]
            assert len(buckets[0]) == len(by.buckets) and buckets[0] & buckets[1]
    for bad in (lambda: simhash_dedup.equal_blocks(4, 4), lambda: simhash_dedup.near_blocks(3, 1, 9)):
        with pytest.raises(ValueError):
            bad()


def test_similar_texts_link_and_others_do_not(spark):
    """Texts with a similarity of 0.8 or more over five words are found nine times of ten; those under 0.4 never link."""
    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(3000)]
    p = 1 / np.arange(1, 3001)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows_in, near, far = [], [], []
    for g in range(150):
        words = rng.choice(vocab, rng.integers(60, 600), p=p / p.sum()).tolist()
        other = list(words)
        for k in rng.choice(len(words), max(1, len(words) // [70, 6][g % 2]), replace=False):
            other[k] = str(rng.choice(vocab))
        share = len(shingles(words) & shingles(other)) / len(shingles(words) | shingles(other))
        rows_in += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
        (near if share >= 0.8 else far if share < 0.4 else []).append(g)
    comp = {r["doc_id"]: r["component_id"] for r in simhash_dedup.simhash_groups(spark.createDataFrame(rows_in, "doc_id long, text string"), simhash_dedup.SIMILAR).collect()}
    linked = {g for g in range(150) if comp[2 * g] == comp[2 * g + 1]}
    assert len(near) > 50 and len(linked & set(near)) >= 0.9 * len(near)
    assert len(far) > 50 and not linked & set(far)
    assert all(comp[i] >= i - 1 for i in comp)


def test_hot_fingerprints_and_components_are_not_gathered(spark):
    """Half of the rows empty, others near copies of one text: no join or aggregate of the last steps deals more than a small share of rows to one task."""
    rng = np.random.default_rng(2)
    body = rng.choice(WORDS, 300).tolist()
    rows_in = [(i, "") for i in range(4000)] + [(4000 + i, " ".join([*body[: i % 290], f"x{i}", *body[i % 290 :]])) for i in range(2000)] + [(6000 + i, " ".join(f"{w}{i}" for w in WORDS)) for i in range(2000)]
    groups = simhash_dedup.simhash_groups(spark.createDataFrame(rows_in, "doc_id long, text string").repartition(8))
    comp = {r["doc_id"]: r["component_id"] for r in groups.collect()}
    assert {comp[i] for i in range(4000)} == {0} and all(comp[i] == i for i in range(6000, 8000))
    counted = spark.range(8000).selectExpr("id", "IF(id < 4000, 0, id) AS k")
    right = counted.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    joined = shared.join_counted(counted, right, ["k"], 8000)
    assert rows(joined, "id", "k", "least") == sorted(((i, 0 if i < 4000 else i, 0 if i < 4000 else i) for i in range(8000)), key=repr)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_hot_links_leave_out_far_pairs(spark):
    links = simhash_dedup.hot_links(spark.createDataFrame([(0, 1), (0b1111, 1), (0b11111, 1), (0b1111100000, 1)], "fp long, bucket long"), 4).collect()
    assert links and all((r["a"] ^ r["b"]).bit_count() <= 4 for r in links)


def test_kd_sharding(docs):
    out = kd_sharding.kd_shards(docs, shards=4, per_bucket=2)
    assert rows(out, "doc_id", "size", "text_crc32") == expect(lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())))
    slots = collections.defaultdict(list)
    for r in out.collect():
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(4)) and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_kd_sharding_balances_and_splits_only_large_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(WORDS, rng.integers(5, 200))), f"src{i % 7}", "en") for i in range(3000)] + [(10_000 + i, "copy " * 150, "src0", "en") for i in range(1500)] + [(20_000 + i, "small group " * 9, f"src{i % 7}", "de") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = [r.asDict() for r in kd_sharding.kd_shards(docs, shards=8).collect()]
    sums = collections.Counter()
    for r in out:
        sums[r["shard"]] += r["size"]
    assert len(out) == len(rows) and max(sums.values()) < 1.05 * min(sums.values())
    assert len({r["shard"] for r in out if r["doc_id"] >= 20_000}) == 1
    assert len({r["shard"] for r in out if 10_000 <= r["doc_id"] < 20_000}) > 1


def slow_tree(points, target):
    """Leaves (as sorted lists of point numbers) of the same rule, by recursion."""
    dims = range(len(points[0]) - 1)
    scale = [max(p[d] for p in points) - min(p[d] for p in points) or 1.0 for d in dims]

    def walk(at):
        spread = [(max(points[i][d] for i in at) - min(points[i][d] for i in at)) / scale[d] for d in dims]
        d, total = spread.index(max(spread)), sum(points[i][-1] for i in at)
        if total <= target or not max(spread):
            return [sorted(at)]
        top = max(points[i][d] for i in at)
        _, cut = min((abs(2 * sum(points[i][-1] for i in at if points[i][d] <= v) - total), v) for v in {points[i][d] for i in at} - {top})
        return walk([i for i in at if points[i][d] <= cut]) + walk([i for i in at if points[i][d] > cut])

    return sorted(walk(list(range(len(points)))))


@pytest.mark.parametrize("bins", [1024, 3])
def test_kd_tree_against_brute_force(spark, monkeypatch, bins):
    monkeypatch.setattr(kd_sharding, "BINS", bins)
    rng = np.random.default_rng(6)
    points = [(float(rng.integers(40)), float(rng.exponential(3) ** 4), float(rng.integers(3)), int(rng.integers(1, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i long, a double, b double, c double, weight long")
    tree, leaves = kd_sharding.grow(df, ["a", "b", "c"], 700)
    found = collections.defaultdict(list)
    for r in df.withColumn("node", tree.node(["a", "b", "c"])).collect():
        found[r["node"]].append(r["i"])
    assert sorted(map(sorted, found.values())) == slow_tree(points, 700)
    assert leaves == {n: sum(points[i][-1] for i in at) for n, at in found.items()}


def test_kd_metadata_ranks_and_hot_groups(spark):
    """Whole strings are told apart, nulls come first, and a group with most rows but few bytes stays whole."""
    rows_in = [(i, "x", ["aaaaaaaaaa1", "aaaaaaaaaa2", None, ""][i % 4], i % 7 - 3) for i in range(400)]
    docs = spark.createDataFrame(rows_in, "doc_id long, text string, source string, lang int")
    ranked = kd_sharding.with_rank(kd_sharding.with_rank(docs, "source", "r", 400), "lang", "q", 400)
    assert {(r["source"], r["r"]) for r in ranked.collect()} == {(None, -1.0), ("", 0.0), ("aaaaaaaaaa1", 1.0), ("aaaaaaaaaa2", 2.0)}
    assert {r["lang"] - r["q"] for r in ranked.collect()} == {-3.0} and ranked.count() == 400
    many = spark.createDataFrame([(i, "", "s", "en") for i in range(6000)] + [(6000 + i, "word " * 300 + str(i), f"s{i % 5}", "en") for i in range(600)], "doc_id long, text string, source string, lang string")
    out = kd_sharding.kd_shards(many, shards=8).collect()
    sums = collections.Counter()
    for r in out:
        sums[r["shard"]] += r["size"]
    assert len(out) == 6600 and len({r["shard"] for r in out if r["doc_id"] < 6000}) == 1 and max(sums.values()) < 1.05 * min(sums.values())


def slow_lines():
    key = lambda x: asc_lower(x.strip(" \t\n\v\f\r"))
    holders = collections.defaultdict(set)
    for i, t in TEXTS:
        if i is not None:
            for x in (t or "").split("\n"):
                holders[key(x)].add(i)
    out = []
    for i, t in TEXTS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup(docs):
    cut = line_dedup.drop_lines(docs)
    assert rows(cut.withColumn("sha", F.sha2("text", 256)), "doc_id", "n_lines", "n_dropped", "sha") == slow_lines()
    assert set(docs.columns) <= set(cut.columns)


@pytest.mark.parametrize("cut", range(12))
def test_runs_over_partition_borders(cut):
    """However sorted rows are cut into partitions, what is decided and what is left open add up to the same."""
    rows = [(1, 1, d, 0, [p]) for d, p in ((9, 0), (7, 0), (7, 1), (3, 0))] + [(2, 2, 5, 0, [0]), (2, 2, 4, 0, [0])] + [(3, 3, d, 0, [0]) for d in (8, 6, 5, 4, 2, 1)]
    told = [r for part in (rows[:cut], rows[cut:]) for r in line_dedup.stream_runs(part, 3)]
    docs = collections.defaultdict(set)
    for r in told:
        if not r[5]:
            docs[r[:2]].add(r[2])
    drops = {(r[0], r[2], p) for r in told if r[5] for p in r[4]}
    drops |= {(r[0], r[2], p) for r in told if not r[5] and len(docs[r[:2]]) >= 3 and r[2] != max(docs[r[:2]]) for p in r[4]}
    assert drops == {(1, 7, 0), (1, 7, 1), (1, 3, 0), *((3, d, 0) for d in (6, 5, 4, 2, 1))}


def test_packing(docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = [r.asDict() for r in packing.pack_documents(docs, with_ids=True).collect()]
    ids = collections.Counter()
    for i, t in TEXTS:
        whole = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(whole), 2048)):
            ids[(i, k, at, tuple(whole[at : at + 2048]))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in out) == ids
    assert all(r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in out)
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_ranks_in_buckets(spark):
    parts = spark.createDataFrame([(i, 0, 0, 3 + i % 2, i) for i in range(200)], packing.PIECE)
    out = packing.pack(parts, 10, per_bucket=7).collect()
    fill = collections.Counter()
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    assert len(out) == 200 and max(fill.values()) <= 10 and len(fill) <= 75


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_feasible_and_tight(seed):
    rng = np.random.default_rng(seed)
    counts = {int(x): int(n) for x, n in zip(rng.choice(np.arange(1, 101), 40, replace=False), rng.integers(1, 50, 40), strict=True)}
    used, sequences = collections.Counter(), 0
    for times, taken in packing.minimum_slack_plan(counts, 100):
        assert sum(x * k for x, k in taken.items()) <= 100
        sequences += times
        for x, k in taken.items():
            used[x] += times * k
    space: list[int] = []  # best-fit decreasing
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [(s, i) for i, s in enumerate(space) if s >= x]
        if fits:
            space[min(fits)[1]] -= x
        else:
            space.append(100 - x)
    assert used == counts and sequences <= 1.01 * len(space) + 1


def test_fullest_is_exact():
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(50):
        available = {int(x): int(n) for x, n in zip(rng.integers(2, 20, 4), rng.integers(1, 4, 4), strict=True)}
        best = max(s for k in product(*(range(n + 1) for n in available.values())) if (s := sum(a * b for a, b in zip(available, k, strict=True))) <= 30)
        taken = packing.fullest(available, 30)
        assert sum(x * k for x, k in taken.items()) == best and all(k <= available[x] for x, k in taken.items())


def slow_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for x in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_quality_rules(spark, docs):
    labels = spark.createDataFrame([(i, i % 2 if i else None, 0) for i, _ in TEXTS], "doc_id long, quality int, toxic int")
    out = quality_forest.quality_verdicts(docs, labels)
    assert rows(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == expect(slow_rules)
    for r in out.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    unlabelled = quality_forest.quality_verdicts(docs, labels.limit(0))
    assert all(r["kept"] == (not r["base_failed"]) for r in unlabelled.collect())


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(1000, 3)), rng.normal(size=(10, 3)) + 8])
    score = quality_forest.IsolationForest(x, 50, 128).score(x)
    assert score[1000:].min() > np.quantile(score[:1000], 0.98)
    assert quality_forest.calibrate(np.array([9.0, 1, 0, 0]), np.array([0, 0, 5, 5.0]), 0.02) == 2 / quality_forest.SCORE_BINS


@functools.cache
def template_shingles(text):
    w = fm_decontam.words_of(text)
    k = min(5, len(w))
    return k, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def slow_licenses(templates, t, containment=0.8):
    """(template, share) by sets of shingles."""
    w, out = fm_decontam.words_of(t), []
    mine = {k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for k in range(1, 6)}
    for name, text in sorted(templates.items()):
        k, whole = template_shingles(text)
        share = len(whole & mine[k]) / len(whole)
        if share >= containment:
            out.append((name, share))
    return out


@pytest.mark.parametrize("slice_bytes", [1 << 24, 20_000])
def test_license_scan(spark, docs, slice_bytes):
    every = license_templates.default_templates()
    mit, bsd = every["MIT"], every["BSD-3-Clause"]
    more = [(100, f"Copyright (c) 2020 A. Nobody\n\n{mit}"), (101, mit + bsd), (101, mit + bsd), (102, mit[: len(mit) // 2]), (103, "x = 1  # SPDX-License-Identifier: MIT"), (None, mit), (104, every["GPL-3.0"].upper()), (105, f"{mit} {mit}"), (106, "SPDX License")]
    mine = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    out = license_scan.scan_licenses(mine, slice_bytes=slice_bytes).collect()
    got = sorted(((r["doc_id"], sorted((m["template"], m["containment"]) for m in r["matches"])) for r in out), key=repr)
    assert got == sorted(((i, slow_licenses(every, t)) for i, t in [*TEXTS, *more]), key=repr)
    names = {r["doc_id"]: {m["template"] for m in r["matches"]} for r in out}
    assert names[15] == {"MIT/line"} and names[100] == {"MIT"} and names[101] == {"MIT", "BSD-2-Clause", "BSD-3-Clause"} and not names[102] and names[103] == {"MIT/tag"} and "GPL-3.0" in names[104]


def test_licenses_survive_edits():
    """Copies with words deleted and replaced and blocks inserted, of up to the template's length, are found whenever they hold 0.8 of its shingles."""
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(200)]
    every = {k: t for k, t in license_templates.default_templates().items() if len(t) < 4000}
    made = {f"t{n}": " ".join(rng.choice(vocab, n)) for n in (5, 9, 12, 40, 150, 400)}
    texts, kinds = [], []
    for name, text in (every | made).items():
        for n in range(30):
            words = text.split()
            for _ in range(rng.integers(0, max(1, len(words) // 26) + 1)):
                at, kind = rng.integers(len(words)), rng.integers(3)
                if kind == 0:
                    words[at] = "zz"
                elif kind == 1 and len(words) > 1:
                    del words[at]
                else:
                    words[at:at] = rng.choice(vocab, rng.integers(1, len(text.split()) + 1)).tolist() if n % 2 else ["qq"]
            texts.append(" ".join([*rng.choice(vocab, rng.integers(0, 99)), *words, *rng.choice(vocab, rng.integers(0, 99))]))
            kinds.append(name)
    index = license_scan.TemplateIndex(every | made, 0.8)
    wanted = found = 0
    for at in range(0, len(texts), 50):
        for t, got in zip(texts[at : at + 50], index.scan(texts[at : at + 50]), strict=True):
            want = slow_licenses(every | made, t)
            assert {(m[0], m[3]) for m in got} <= set(want)
            wanted, found = wanted + len(want), found + len(got)
    assert wanted > 500 and found >= 0.999 * wanted


def test_registered_license_scan_against_brute_force(spark):
    from voxelflow.llm.queries import QUERIES

    every = license_templates.default_templates()
    got = {r["doc_id"]: (r["n_matches"], r["licenses"]) for r in QUERIES["op7_license_scan"](spark, "/root/testdata/sf0.001").collect()}
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: [n for n, _ in slow_licenses(every, r["text"])] for r in texts}
    assert got == {i: (len(n), ",".join(sorted({x.split("/")[0] for x in n}))) for i, n in want.items()} and any(n for n, _ in got.values())


def test_near_dedup_keeps_a_row_of_each_group_of_repeated_ids(spark):
    import corpus_pipeline

    first, second, third = ("".join(f"{w}{k} " for w in WORDS) for k in range(3))
    rows_in = [(1, first), (2, first), (2, second), (3, third), (3, second), (4, third), (5, second + "more"), (7, first + "x"), (7, third + "y"), (None, first)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows_in], "doc_id long, text string, lang string")
    comp = {(r["doc_id"], r["fp"], r["fp2"]): r["root"] for r in simhash_dedup.rooted_groups(docs.where("doc_id IS NOT NULL"), simhash_dedup.SIMILAR).collect()}
    kept = rows(corpus_pipeline.drop_near_copies(spark, docs, ""), "doc_id", "text")
    both = lambda t: tuple(signed(slow_print(t, n)) for n in (2, 5))
    named = [(i, t) for i, t in rows_in if i is not None]
    want = {}
    for i, t in named:
        root = comp[i, *both(t)]
        want[root] = min(want.get(root, (i, both(t), t)), (i, both(t), t))
    assert kept == sorted([(i, t) for i, _, t in want.values()] + [(None, first)], key=repr)
    assert {(1, first), (2, second), (3, third)} <= set(kept)


def test_license_matches_do_not_hang_on_the_block():
    index = license_scan.TemplateIndex(license_templates.NOTICES, 0.8)
    text = "work is licensed under the GNU General Public License, version 3."
    alone, among = index.scan([text])[0], index.scan(["x y z " * 20, text, "x y z " * 20])[1]
    assert alone == among == [("GPL-3.0/line", 0, 11, 7 / 8)] and index.scan([]) == [] and index.scan([None, ""]) == [[], []]


@pytest.mark.parametrize("url, parts", [(None, ("", "")), ("no scheme", ("", "")), ("http://A.Com/En/7?x#y", ("a.com", "/En/7")), ("x://h#f/g", ("h", "")), ("a://b://c/d", ("b:", "//c/d")), ("http://É.org/ES", ("É.org", "/ES")), ("://", ("", ""))])
def test_url_parts(url, parts):
    assert url_filter.split_url(url) == parts


@pytest.mark.parametrize("slice_bytes", [1 << 20, 1])
def test_url_rules(spark, slice_bytes):
    pages = spark.createDataFrame([(1, "http://a.example.com/en/750", "h"), (2, "http://a.com/en/6", "h"), (3, "http://x.example.net/de/8/9", "h"), (4, None, None), (None, "http://org/es/", "h"), (5, "http://myorg/es/", "h"), (1, "http://a.example.com/en/750", "h")], "page_id long, url string, html string")
    out = rows(url_filter.filter_urls(pages, slice_bytes=slice_bytes), "page_id", "rule", "verdict")
    assert out == sorted([(1, "example.com/en/7", "allow"), (2, "com/en/", "block"), (3, "example.net/de/8", "block"), (4, None, "allow"), (None, "org/es/", "block"), (5, None, "allow"), (1, "example.com/en/7", "allow")], key=repr)
    long = spark.createDataFrame([(1, "http://a.com/" + "x/" * 200_000), (2, "http://" + "a." * 100_000 + "org/es/q")], "page_id long, url string")
    assert rows(url_filter.filter_urls(long, slice_bytes=slice_bytes), "page_id", "rule") == [(1, None), (2, "org/es/")]


def slow_hits(items, t, window=13):
    get = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", asc_lower(x))
    w, hit, found = get(t), set(), set()
    for item, text in items:
        b = get(text)
        for k in range(max(1, len(b) - window + 1) if b else 0):
            p = b[k : k + window]
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit |= set(range(i, i + len(p)))
                    found.add(item)
    return len(w), len(hit), sorted(x for x in found if x is not None)


@pytest.mark.parametrize("slice_bytes", [1 << 24, 64])
def test_decontamination(spark, docs, slice_bytes):
    items = [("1", ITEM), ("b2", ""), ("3", None), ("item 4", "same text here"), (None, "unlike 6"), ("10", ITEM.upper()), ("10", "x y"), ("9", "x y z x")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    out = fm_decontam.find_contamination(docs, bench, shard_words=500, slice_bytes=slice_bytes)
    found = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in out.collect()), key=repr)
    assert found == expect(lambda t: slow_hits(items, t))
    clean = fm_decontam.without_contaminated(docs, bench, shard_words=500, slice_bytes=slice_bytes)
    dirty = lambda t: (n := slow_hits(items, t))[1] > 0 and 20 * n[1] >= n[0]
    assert rows(clean, "doc_id", "text") == sorted(((i, t) for i, t in TEXTS if not dirty(t)), key=repr) and clean.columns == docs.columns


def test_index_against_brute_force():
    import random

    random.seed(3)
    for _ in range(60):
        items = [(i, " ".join(random.choice("abc") for _ in range(random.randint(0, 7)))) for i in range(5)]
        shard, texts = fm_decontam.Shard(fm_decontam.Phrases(items, 4)), [" ".join(random.choice("abcd") for _ in range(random.randint(0, 40))) for _ in range(8)]
        for i, t in enumerate(texts):
            shard.add(i, t)
        for t, r in zip(texts, shard.result(), strict=True):
            assert (r[1], r[2], r[4]) == slow_hits(items, t, 4) and sum(s["end"] - s["start"] for s in r[3]) == r[2]


def test_cut_spans():
    assert fm_decontam.cut_spans("One, Two three! four", [{"start": 1, "end": 3}]) == "One, ! four"


def test_toxicity_gradients():
    net = toxicity_gru.ToxicityNet()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    w, y = toxicity_gru.Words([[b"ab", b"cd", b"ab", b"efgh"], [b"x"] * 70]), np.array([1.0, 0, 1])
    _, g = net.gradients(w, w.windows, y)
    for k, v in net.p.items():
        at = np.unravel_index(np.argmax(np.abs(g[k])), v.shape)
        old = v[at]
        v[at] = old + 1e-4
        up = net.gradients(w, w.windows, y)[0]
        v[at] = old - 1e-4
        down = net.gradients(w, w.windows, y)[0]
        v[at] = old
        assert np.isclose((up - down) / 2e-4, g[k][at], rtol=2e-3, atol=1e-6), k


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 500):
        covered = {i for s in toxicity_gru.window_starts(n) for i in range(s, s + toxicity_gru.WIDTH)}
        assert set(range(n)) <= covered


def test_toxicity_edges(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r["score"], r["predicted"]) for r in toxicity_gru.toxicity(docs, empty).collect()} == {(0.0, 0)}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join([*rng.choice(WORDS, 30), *(["venom", "venomous"][i // 2 % 2 : i // 2 % 2 + 1] if i % 2 else []), *rng.choice(WORDS, 30)]), i % 2) for i in range(400)]
    train = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").unionByName(docs.select("doc_id", "text").where("doc_id IS NULL"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (7, 0)], "doc_id long, toxic int")  # 7 has both labels: toxic
    long = " ".join(rng.choice(WORDS, 40_000))
    odd = [(1000, None), (1001, ""), (1002, " \n "), (1003, long), (1003, long), (1004, f"{long[:100_000]} venom venomous venom venomous {long[100_000:]}"), (None, "venom " * 40), (1005, "venom")]
    out = toxicity_gru.toxicity(train.unionByName(spark.createDataFrame(odd, "doc_id long, text string")), labels).collect()
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in out)
    at = collections.defaultdict(list)
    for r in out:
        at[r["doc_id"]].append(r["score"])
    assert at[1000] == at[1001] == at[1002] == [0.0] and len(at[1003]) == 2 and max(at[1003]) - min(at[1003]) < 1e-5 and at[1003][0] < at[1004][0] and at[1003][0] < 0.7
    held = [r for r in out if r["held_out"] and r["doc_id"] < 1000]
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in held) >= 0.95 * len(held)


def test_toxicity_beats_the_best_word():
    """Held-out rows of the largest small table: the network against the highest log odds of a text's words."""
    import duckdb

    known = duckdb.sql("SELECT doc_id, text, max(toxic) FROM '/root/testdata/sf0.1/documents.parquet' JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) WHERE toxic IS NOT NULL GROUP BY ALL ORDER BY text").fetchall()
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in known])
    y, texts = np.array([t for _, _, t in known]), [t for _, t, _ in known]
    learn = [k for k in np.flatnonzero(~held) if len(texts[k].encode()) <= 16 << 10]
    model = toxicity_gru.train([texts[k] for k in learn], y[learn].tolist(), rounds=3)
    seen = [set(toxicity_gru.words_of(t)) for t in texts]
    n = [collections.Counter(w for k in learn if y[k] == c for w in seen[k]) for c in (0, 1)]
    odds = lambda w: (np.log((n[1][w] + 0.5) / (n[0][w] + 0.5)) * (n[0][w] + n[1][w]) / (n[0][w] + n[1][w] + 4)) if w in n[1] else -9.0
    test = np.flatnonzero(held)
    score, word = model.scores([texts[k] for k in test]), np.array([max(map(odds, seen[k]), default=-9.0) for k in test])
    pairs = lambda s: float(np.mean([(s[y[test] == 0] < v).mean() + (s[y[test] == 0] == v).mean() / 2 for v in s[y[test] == 1]]))
    assert pairs(score) > pairs(word) and pairs(score) > 0.96
    assert (score[y[test] == 1] >= 0.7).mean() > 0.8 and (score[y[test] == 0] >= 0.7).mean() < 0.02


def test_empty_tables(spark, docs):
    none, bench = docs.limit(0), spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (token_counts.token_counts(none), simhash_dedup.simhash_groups(none), kd_sharding.kd_shards(none), line_dedup.drop_lines(none), packing.pack_documents(none), quality_forest.quality_verdicts(none, labels), license_scan.scan_licenses(none), fm_decontam.find_contamination(none, bench), toxicity_gru.toxicity(none, labels), url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"))):
        assert df.count() == 0
    assert {r["n_hit"] for r in fm_decontam.find_contamination(docs, bench).collect()} == {0}
