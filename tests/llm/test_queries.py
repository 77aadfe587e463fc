"""Registered corpus queries: DuckDB counterparts row for row, and the pipeline against a plain version of its rules."""

import duckdb
import pytest
import xxhash  # noqa: F401

import corpus_pipeline
from voxelflow.llm import fm_decontam, line_dedup, simhash_dedup, toxicity_gru
from voxelflow.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_every_operator_is_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 11)}


def test_pipeline(spark):
    """Each stage on its predecessor's rows, by plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, {r["doc_id"]: r.asDict() for r in docs.collect()}
    net = toxicity_gru.fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = {i: d for i, d in left.items() if net.scores([d["text"]])[0] < toxicity_gru.THRESHOLD}

    holders = {}
    key = lambda x: x.strip(line_dedup.BLANK).encode().lower().decode()
    for i, d in left.items():
        for x in (d["text"] or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    for i, d in left.items():
        d["text"] = "\n".join(x for x in (d["text"] or "").split("\n") if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i)
        d["n_chars"] = len(d["text"])

    prints = {i: [simhash_dedup.fingerprint(d["text"], n) for n in (2, 5)] for i, d in left.items()}
    seen = set()
    for i in sorted(left):
        if i in seen:
            continue
        queue, seen = [i], seen | {i}
        while queue:
            u = queue.pop()
            for v in sorted(left):
                if v not in seen and all((x ^ y).bit_count() <= most for x, y, most in zip(prints[u], prints[v], (8, 14), strict=True)):
                    seen.add(v)
                    queue.append(v)
                    prints[v, "gone"] = True
    left = {i: d for i, d in left.items() if (i, "gone") not in prints}

    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    windows = set()
    for _, t in bench:
        w = fm_decontam.words_of(t)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12) if w else 0)}
    for i in list(left):
        w = fm_decontam.words_of(left[i]["text"])
        hit = {j for p in {len(p) for p in windows} for k in range(len(w) - p + 1) if tuple(w[k : k + p]) in windows for j in range(k, k + p)}
        if hit and 20 * len(hit) >= len(w):
            del left[i]

    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == columns, name
    assert sorted(tuple(r[c] for c in columns) for r in out.collect()) == sorted(tuple(d[c] for c in columns) for d in left.values())
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == set(left)


def test_stages_without_rows(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none_out = stage(spark, none, SF)
        assert none_out.count() == 0
