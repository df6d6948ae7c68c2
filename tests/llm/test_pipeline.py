"""The registered queries' shapes, and the pipeline stage by stage against brute force."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from recallscope.llm import queries as q
from recallscope.llm.pfair_mix import integer_shares, tempered_targets
from recallscope.llm.tokenizing import encoder
from recallscope.session import fresh_path
from tests.conftest import SF001
from tests.llm.test_jaccard_join import brute as classes
from tests.llm.test_pfair_mix import brute as mixed
from tests.llm.test_substring_dedup import brute as repeats
from tests.llm.util import words

COLUMNS = {
    1: "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    3: "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
       "base_failed boolean, kept boolean",
    5: "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    6: "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    8: "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    9: "page_id bigint, host string, path string, rule string, verdict string",
    10: "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
        "near_next double",
}


def test_every_operator_has_one_query():
    names = list(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 11))
    assert "pipeline" in names and set(q.oracle_sql()) <= set(q.queries())


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_contract_columns(spark, n):
    name = next(k for k in q.queries() if k.startswith(f"op{n}_"))
    types = dict(q.queries()[name](spark, SF001).dtypes)
    for column in COLUMNS[n].split(", "):
        c, t = column.split(" ")
        assert types[c] == t, column


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF001}/documents.parquet'")
    df = q.queries()[name](spark, SF001)
    cur = con.execute(q.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, cur.fetchall()))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    foreign = "Широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства " * 4
    extra = spark.createDataFrame([(10_000, foreign, "en", "src1", len(foreign)), (10_001, None, None, None, None),
                                   (10_002, "", None, "src1", 0)], docs.schema)
    base = fresh_path(spark, "t-pipeline")
    docs.unionByName(extra).write.parquet(f"{base}/documents.parquet")
    at, before = spark.read.parquet(f"{base}/documents.parquet"), None
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = {r.doc_id: r for r in at.collect()}
        stage(spark, at, base).write.parquet(f"{base}/{k}")
        at = spark.read.parquet(f"{base}/{k}")
        rows = at.collect()
        if name != "packing":
            assert at.columns == docs.columns
            after = {r.doc_id: r for r in rows}
            assert len(after) == len(rows)
        if name == "language":
            assert set(before) - set(after) == {10_000, 10_001, 10_002}
            assert all(after[i].text == before[i].text for i in after)
        elif name == "near_duplicates":
            want = {c for _, c, _, _ in classes([(i, r.text) for i, r in before.items()])}
            assert set(after) == want and all(after[i] == before[i] for i in after) and len(after) < len(before)
        elif name == "repeats":
            cut = 0
            for i, n, gone, _ in repeats([(i, r.text) for i, r in before.items()], 50):
                assert (i in after) == (gone < n or n == 0)
                if i in after:
                    assert len(words(after[i].text)) == n - gone
                    assert gone or after[i] == before[i]
                    cut += gone
                    assert not gone or after[i].n_chars == len(after[i].text)
            assert cut
        elif name == "mix":
            assert {tuple(r) for r in rows} == {tuple(r) for r in before.values()}
            targets = tempered_targets(spark.createDataFrame(list(before.values()), docs.schema))
            want = mixed([(r.doc_id, r.text, r.source) for r in before.values()], integer_shares(targets), 8192)
            ordered = at.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
            assert [r.doc_id for r in ordered] == [w[0] for w in sorted(want, key=lambda w: (w[5], w[6], w[0]))]
        else:
            e = encoder(public_tokenizers.path("word_bpe_49k.json"))
            want = {i: len(e.encode([r.text])[0]) + 1 for i, r in before.items()}
            total = {}
            for r in rows:
                assert r.doc_tokens == want[r.doc_id]
                total[r.doc_id] = total.get(r.doc_id, 0) + r.length
            assert total == want
    by_run = pipeline.run(spark, base)
    assert sorted(map(str, by_run.collect())) == sorted(map(str, rows))
    assert pipeline.ORACLE_SQL is None


def test_pipeline_of_an_empty_table(spark):
    base = fresh_path(spark, "t-pipeline-empty")
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    docs.limit(0).write.parquet(f"{base}/documents.parquet")
    assert pipeline.run(spark, base).collect() == []


def test_stages_take_odd_rows(spark):
    from tests.llm.util import odd_docs

    base = fresh_path(spark, "t-pipeline-odd")
    docs = odd_docs(spark, extra=("__node", "kept")).withColumns(
        {"lang": F.when(F.col("doc_id") % 2 == 0, "en"), "source": F.when(F.col("doc_id") % 3 == 0, "s"), "n_chars": F.char_length("text").cast("long")})
    docs.write.parquet(f"{base}/in")
    for name, stage in pipeline.STAGES:  # each on the whole odd table
        out = stage(spark, spark.read.parquet(f"{base}/in"), base)
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
        if name in ("mix",):
            assert len(rows) == docs.count()
    assert np.isfinite(len(rows))
