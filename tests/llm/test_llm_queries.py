"""The registered queries against their SQL, and the pipeline stage by stage."""

import hashlib
import re

import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from check import connection, difference
from skytable.functions.storage import written
from skytable.llm import bpe
from skytable.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, name):
    df = QUERIES[name](spark, SF)
    cur = connection(SF).execute(ORACLE[name])
    want_cols = [d[0] for d in cur.description]
    assert difference([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), want_cols) is None


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if re.match(r"op[0-9]+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_bpe_query_equals_the_library(spark):
    enc = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(corpus_pipeline.RANKS), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op2_byte_bpe"](spark, SF).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pii_query_equals_plain_patterns(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    emails = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    for r in QUERIES["op7_pii_semi_markov"](spark, SF).collect():
        assert r.n_email == len(emails.findall(texts[r.doc_id]))


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] == sizes[1] > sizes[2] >= sizes[3] > 0 < sizes[4]
    enc = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(corpus_pipeline.RANKS), special_tokens={})
    # a document may be taken whole in one epoch and cut in the next
    want = sorted((r.doc_id, enc.encode_ordinary(r.text)) for r in docs.collect())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted((r.doc_id, r.ids) for r in out) == want and all(r.round_trip for r in out)
