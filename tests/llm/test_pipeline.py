from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from meridian.llm import common, secrets
from meridian.llm import queries as corpus
from meridian.llm.tokens import encoder, public_path
from tests.llm.test_scans import strong
from tests.llm.test_texts import brute_components, brute_matches, brute_repeats

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    c = duckdb.connect()
    return [tuple(r) for r in c.execute(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY 1").fetchall()], [tuple(r) for r in c.execute(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()]


def test_stages_against_brute_force(spark, documents):
    rows, items = documents
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = out[name] = common.written(stage(spark, frame, SMALL), name)
    ids = lambda f: {r["doc_id"] for r in f.select("doc_id").collect()}

    def clean(t):
        words = t.encode().split()
        seen = defaultdict(int)
        for i in range(len(words) - 4):
            seen[tuple(words[i : i + 5])] += 1
        cov = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
        longest = 0 if not cov else brute_repeats(words)[1]
        long = 0 if longest < 15 else brute_repeats(words, 15)[0]
        return len(words) >= 10 and len(cov) * 100 <= 20 * len(words) and longest <= 100 and 100 * long <= 10 * len(words)

    rows = [r for r in rows if clean(r[1])]
    assert ids(out["quality"]) == {d for d, _ in rows}
    comp, _ = brute_components(rows, 5, 80)
    rows = [r for r in rows if comp[r[0]] == r[0]]
    assert ids(out["near-duplicates"]) == {d for d, _ in rows}
    hit = {d for d, _ in brute_matches(rows, items)}
    rows = [r for r in rows if r[0] not in hit]
    assert ids(out["decontamination"]) == {d for d, _ in rows} and hit
    masked = {r["doc_id"]: r["text"] for r in out["secrets"].collect()}
    assert set(masked) == {d for d, _ in rows}
    for d, t in rows:
        assert (masked[d] == t) == (not strong(t)) and not strong(masked[d])
    tok = encoder(public_path("byte_bpe_50k.json")).tokenizer
    pieces = defaultdict(list)
    for r in out["packing"].collect():
        pieces[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for d, t in masked.items():
        assert [x for _, p in sorted(pieces[d]) for x in p] == [*tok.encode(t, add_special_tokens=False).ids, 1]
    assert set(pieces) == set(masked)
    assert corpus_pipeline.run(spark, SMALL).groupBy().sum("length").first()[0] == sum(len(p) for x in pieces.values() for _, p in x)


def test_documents_columns_stay(spark):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, SMALL).schema.simpleString() == frame.schema.simpleString()
        assert stage(spark, frame.limit(0), SMALL).count() == 0


@pytest.mark.parametrize("name", sorted(corpus.ORACLES))
def test_queries_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    rel = c.execute(corpus.ORACLES[name])
    cols = [d[0] for d in rel.description]
    want = sorted(map(repr, rel.fetchall()))
    assert sorted(repr(tuple(r[k] for k in cols)) for r in corpus.QUERIES[name](spark, SMALL).collect()) == want


def test_secret_kinds_are_named_once():
    assert len(set(secrets.KINDS)) == len(secrets.KINDS)
