"""Language identification: held-out accuracy, each kind of evidence, odd input."""

import pytest
from pyspark.sql import functions as F

from recallscope.llm.language_id import OTHER, fit, language_id, page_evidence
from tests.conftest import SF01
from tests.llm.util import empty_docs, odd_docs


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text", "lang", "source")


@pytest.fixture(scope="module")
def fitted(documents):
    return fit(documents.where("doc_id % 4 != 0"), "text", F.col("lang"), sample_rows=300)


def test_held_out_accuracy_from_text_alone(documents, fitted):
    rows = language_id(documents.where("doc_id % 4 = 0"), fitted=fitted).collect()
    assert len(rows) == 250 and fitted[1].shape[0] == 5
    assert sum(r.predicted == r.lang for r in rows) >= 0.97 * len(rows)
    assert sum(r.kept for r in rows) >= 0.97 * len(rows)


def test_all_evidence_keeps_clean_documents(documents):
    rows = language_id(documents, declared=F.col("lang"), host=F.col("source")).collect()
    assert len(rows) == 1000 and sum(r.kept and r.predicted == r.lang for r in rows) >= 990


def test_each_evidence_decides_an_undecided_text(spark, fitted):
    neutral = ""
    rows = [("plain", neutral, None, None, None, None), ("declared", neutral, "fr", None, None, None),
            ("suffix", neutral, None, "de", None, None), ("unknown", neutral, "xx", None, None, None)]
    frame = lambda rows: spark.createDataFrame(rows, "id string, text string, d string, s string, h string, m string")
    identify = lambda rows: {r.id: r for r in language_id(
        frame(rows), declared=F.col("d"), suffix=F.col("s"), host=F.col("h"), domain=F.col("m"), fitted=fitted).collect()}
    got = identify(rows)
    assert got["declared"].predicted == "fr" and got["declared"].kept
    assert got["suffix"].predicted == "de" and got["suffix"].kept
    for name in ("plain", "unknown"):  # an unknown code is no evidence
        assert (got[name].predicted, got[name].kept) == (OTHER, False)
    spanish = "que los de la una ciónado para el con se queasos de la miera"
    rows = [(f"h{i}", spanish + f" {i}", None, None, "es.example.org", "example.org") for i in range(60)]
    rows += [("host", "xyz", None, None, "es.example.org", "example.org"), ("domain", "xyz", None, None, "new.example.org", "example.org")]
    got = identify(rows + [(f"e{i}", "the of and in that with for was edth ing", None, None, "en.example.com", "example.com") for i in range(200)]
                   + [("other", "xyz", None, None, "en.example.com", "example.com")])
    assert got["host"].predicted == got["domain"].predicted == "es"
    assert got["host"].posterior > got["domain"].posterior  # the host says more than its domain
    assert got["other"].predicted == "en"


def test_foreign_scripts_go(spark, fitted):
    texts = ["Широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства " * 3, "天地玄黃宇宙洪荒日月盈昃辰宿列張" * 8]
    rows = language_id(spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("d", F.lit("en")),
                       declared=F.col("d"), fitted=fitted).collect()
    assert [(r.predicted, r.kept) for r in rows] == [(OTHER, False)] * 2


def test_odd_input(spark, documents, fitted):
    docs = odd_docs(spark, extra=("kept", "__host", "lang"))
    rows = language_id(docs, fitted=fitted, declared=F.col("lang")).collect()
    assert len(rows) == docs.count() and all(0 < r.posterior <= 1 + 1e-9 and r.kept is not None for r in rows)
    assert "text" not in rows[0].asDict() and rows[0]["__host"] == "extra"
    assert language_id(empty_docs(spark), fitted=fitted).collect() == []
    # nothing labelled: everything is background
    nothing = language_id(odd_docs(spark), declared=F.lit(None).cast("string")).collect()
    assert {(r.predicted, r.kept) for r in nothing} == {(OTHER, False)}
    assert language_id(empty_docs(spark)).collect() == []


def test_repeated_runs_agree(documents):
    a, b = (sorted(map(tuple, language_id(d, declared=F.col("lang"), host=F.col("source"), sample_rows=200)
                       .select("doc_id", "predicted", "kept").collect())) for d in (documents, documents.repartition(7)))
    assert a == b


def test_page_evidence(spark):
    rows = [("https://Sub.Example.de/x", '<HTML Lang="EN"><script>var a = "<b>";</script><p>Hi <b>you</b><!-- no --></p>'),
            ("http://a.example.com/fr/1?x", "<html><body>text"), ("http://example.com", None), (None, '<html lang=de>'), ("odd", "")]
    got = [(r["__markup"], r["__address"], r["__page_host"], r["__page_domain"], " ".join((r["__page_text"] or "").split()))
           for r in page_evidence(spark.createDataFrame(rows, "url string, html string")).collect()]
    assert got == [("en", "de", "sub.example.de", "example.de", "Hi you"), (None, "fr", "a.example.com", "example.com", "text"),
                   (None, None, "example.com", "example.com", ""), ("de", None, None, None, ""), (None, None, None, None, "")]


def test_rare_languages_and_copies(spark):
    """A language with few texts is fitted beside frequent ones, and copies of a text
    do not take the places of other texts or languages."""
    rows = [(i, "the of and in that with for was edth ing " * 3 + str(i % 700), "en") for i in range(3000)]
    rows += [(4000 + i, f"que los de la una con el se para ciones {i} " * 3, "es") for i in range(12)]
    rows += [(5000 + i, "der die und das ist nicht ein zu den mit " * 3, "de") for i in range(3000)]  # copies of one text
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(5)
    for sample_rows in (1, 20):
        assert fit(docs, "text", F.col("lang"), sample_rows=sample_rows)[0] == ["de", "en", "es"]
    got = language_id(docs, declared=F.col("lang"), sample_rows=20).collect()
    assert len(got) == len(rows) and all(r.kept and r.predicted == r.lang for r in got)
    # the model of copies is that of one text
    one = docs.dropDuplicates(["lang", "text"])
    assert (fit(docs, "text", F.col("lang"), 20)[1] == fit(one, "text", F.col("lang"), 20)[1]).all()
