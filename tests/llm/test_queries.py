"""Registered queries of the operators against SQL, and the pipeline's stages."""

import duckdb
import public_tokenizers
import pytest

import corpus_pipeline
from cases import sorted_rows
from orderloom.llm import queries
from orderloom.llm.pii import Feistel, pseudonymous

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, small, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(d[0] for d in found.description)
    got = queries.QUERIES[name](spark, small)
    assert sorted(got.columns) == columns
    assert sorted_rows(got, *columns) == sorted(map(tuple, found.df()[columns].astype(object).where(lambda d: d.notna(), None).values.tolist()), key=repr)


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_pipeline(spark):
    """Each stage on what the one before kept, and the same decisions by the operators' own tests."""
    folder = "/root/testdata/sf0.01"
    docs = start = queries.table(spark, folder, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert docs.columns == start.columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    everything = {r.doc_id: r.text for r in start.collect()}
    labels = {r.doc_id: r.quality for r in queries.table(spark, folder, "labels").collect()}
    dropped = everything.keys() - kept["quality"].keys()
    assert sum(labels.get(i) == 1 for i in dropped) <= 0.02 * len(labels)
    assert len(dropped & {i for i, q in labels.items() if q == 0}) >= 0.7 * sum(q == 0 for q in labels.values())
    near = kept["near_copies"]
    assert near.keys() <= kept["quality"].keys() and len(set(near.values())) == len(near)
    items = [" ".join(r.text.lower().split()) for r in queries.table(spark, folder, "benchmark").collect()]
    leaks = {i for i, t in near.items() if any(item in " ".join(t.lower().split()) for item in items)}
    assert leaks and near.keys() - kept["decontamination"].keys() >= leaks
    f = Feistel(queries.PII_KEY)
    assert kept["pii"] == {i: pseudonymous(t, f)[0] for i, t in kept["decontamination"].items()}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    import tiktoken

    ranks = corpus_pipeline.bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id: r.ids for r in last.collect()} == {i: library.encode_ordinary(t) for i, t in kept["pii"].items()}


def test_stages_bear_empty_documents(spark, small):
    docs = queries.table(spark, small, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, small), name)
        assert docs.count() == 0
