"""The queries with SQL against DuckDB, and the pipeline's stages by what they must keep."""

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from millrace.llm import mixing, registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df, sql = registry.QUERIES[name](spark, sf), duck.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    at = [sql.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in sql.fetchall())


def test_registry_has_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


def test_stages(spark, corpus, sf, tmp_path):
    from tests_shingles import contains_item, similar

    df, rows = corpus
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    leak = "before it " + bench[0]["text"] + " and after"
    docs = df.unionByName(spark.createDataFrame([(900, leak, "a", "s1", 0)], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = [tuple(r) for r in docs.collect()]
        if name == "language_id":
            assert sorted(map(repr, after)) == sorted(repr(r) for r in before if any(c.isalpha() for c in r[1] or ""))
        elif name == "near_dedup":
            kept = [r[1] for r in after]
            assert len(set(kept)) == len(kept) and not any(similar(a, b) for i, a in enumerate(kept) for b in kept[:i])
            assert len(after) == len({r[0] for r in after})
        elif name == "decontaminate":
            assert {repr(r) for r in before} - {repr(r) for r in after} == {repr(r) for r in before if any(contains_item(r[1], b["text"]) for b in bench)} != set()
        elif name == "mix_sources":
            assert set(map(repr, after)) <= set(map(repr, before)) and max(map(after.count, after)) <= 3
            words = lambda rows: Counter(r[3] for r in rows for _ in (r[1] or "").split())
            sources = spark.createDataFrame([(s, n, 1) for s, n in words(before).items()], "source string, size long, n long")
            for r in mixing.fill_targets(sources, 3).collect():
                error = sum(len(x[1].split()) for x in after if x[3] == r["source"]) - r["target"]
                nearest = min((abs(error + d * len(x[1].split())) for x in before if x[3] == r["source"] for d in (1, -1) if 0 <= after.count(x) + d <= 3), default=0)
                assert abs(error) <= max(2, 0.01 * r["target"], nearest), (r, error)
        else:
            rows = docs.collect()
            assert sorted(r.doc_id for r in rows) == sorted(r[0] for r in before)
            per = Counter(r.shard for r in rows)
            assert set(per) <= set(range(corpus_pipeline.SHARDS)) and max(per.values()) - min(per.values()) <= 1
            for s, n in Counter(r[3] for r in before).items():
                own = Counter(r.shard for r in rows if r.source == s)
                assert all(abs(own[k] - n * per[k] / len(rows)) <= 2 for k in per)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS


def test_repeated_ids_keep_their_texts_apart(spark, sf):
    w = [f"w{i}" for i in range(60)]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rows = [(5, "quite another text of some words", "a", "s", 0), (5, " ".join([*w, "tail"]), "a", "s", 0), (3, " ".join(w), "a", "s", 0), (3, " ".join(w), "a", "s", 0), (5, bench + " leak", "a", "s", 0), (None, "no id", "a", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in stages["near_dedup"](spark, docs, sf).collect())
    assert kept == sorted([(5, rows[0][1]), (3, rows[2][1]), (5, rows[4][1]), (0, "no id")])
    clean = sorted((r["doc_id"] or 0, r["text"]) for r in stages["decontaminate"](spark, docs, sf).collect())
    assert clean == sorted((r[0] or 0, r[1]) for r in rows if r is not rows[4])
    mixed = Counter((r["doc_id"], r["text"]) for r in stages["mix_sources"](spark, docs, sf).collect())
    assert sum(len(t.split()) * n for (_, t), n in mixed.items()) == sum(len(r[1].split()) for r in rows) and set(mixed) <= {(r[0], r[1]) for r in rows}


def test_run_and_empty(spark, sf, nothing):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 100
    assert all(stage(spark, nothing, sf).count() == 0 for _, stage in corpus_pipeline.STAGES)
