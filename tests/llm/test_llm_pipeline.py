"""The stages of the pipeline against plain versions, and the registered queries on the smallest tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm_operators import corpus, plain_classes

import corpus_pipeline
from brindle.llm import decontamination, language_id, mixing, shared, sharding
from brindle.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    df = Q.queries()[name](spark, FOLDER)
    assert df.count() > 0 or name == "op5_decontamination"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.columns[:5] == COLUMNS
        kept = {r.doc_id for r in out.collect()}
        assert kept and kept <= ids
        docs, ids = spark.createDataFrame(out.collect(), out.schema), kept


def test_one_of_each_group(spark):
    rows = [(i, t, "en", "s", 0) for i, t in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {d for d, _, c in plain_classes(corpus()) if d == c}
    kept = corpus_pipeline.one_of_each_group(spark, docs, FOLDER).collect()
    assert sorted(r.doc_id for r in kept) == sorted(want)


def test_run(spark):
    df = corpus_pipeline.run(spark, FOLDER)
    assert df.columns == [*COLUMNS, "shard"] and {r.shard for r in df.select("shard").distinct().collect()} <= set(range(16))


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_against_sql(spark, name):
    from oracle import duck, spark_rows

    assert spark_rows(Q.queries()[name](spark, SF)) == duck(Q.oracle_sql()[name], SF)


ODD = "doc_id long, text string, lang string, source string, n_chars long, digest string, chance double, place int, bucket long, entropy string, rejected int, n long, q string, u string, covered int"


def odd_rows():
    """Nulls in every column, empty, very long and repeated texts, rows that share an id, and columns named as those that operators use."""
    more = ("d", 0.5, 1, 2, "e", 3, 4, "q", "u", 5)
    rows = [(i, f"the quiet word number {i} of a plain text about rivers {'and hills ' * (i % 7)}{i}", "en", "s", 9) for i in range(40)]
    rows += [(100, None, None, None, None), (None, "some words without an id", "en", "s", 1), (None, None, None, None, None), (101, "", "de", "s", 0), (102, " \t\n", "de", "s", 0), rows[3], rows[3], (3, "another text with this id", "en", "s", 2)]
    rows += [(103, "long " * 60_000 + "text " * 60_000, "en", "s", 600_000), (104, "x" * 400_000, "en", "s", 400_000), (105, "1 2 3 4 5 6 7 8 9 " * 2000, None, None, None)]
    return [(*r, *(more if i % 5 else [None] * len(more))) for i, r in enumerate(rows)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_takes_odd_and_empty_tables(spark, name):
    stage, docs = dict(corpus_pipeline.STAGES)[name], spark.createDataFrame(odd_rows(), ODD)
    out = stage(spark, docs, FOLDER)
    assert out.columns == [*docs.columns, *(["shard"] if name == "sharding" else [])]
    kept, had = Counter(map(tuple, out.select(docs.columns).collect())), Counter(map(tuple, docs.collect()))
    assert kept and kept <= had and (name != "sharding" or kept == had)
    nothing = stage(spark, docs.limit(0), FOLDER)
    assert nothing.count() == 0 and nothing.columns == out.columns


def test_stages_decide_as_their_operators(spark):
    """Each stage on what the one before it kept; the operators have brute-force tests of their own."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    benchmark, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("benchmark", "labels"))
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())

    def wanted(name, rows):
        if name == "language_id":
            return ids(language_id.predict(rows, language_id.fit(rows, F.lit(True))).where("not rejected"))
        if name == "ngram_jaccard_join":
            texts = [(r.doc_id, r.text) for r in rows.collect()]
            return Counter(d for d, _, c in plain_classes(texts) if d == c)
        if name == "benchmark_decontamination":
            return ids(rows) - ids(decontamination.contaminated(rows, benchmark))
        if name == "source_mixing":
            return ids(mixing.mixture(rows, labels).where("copies > 0"))
        return ids(rows)

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert ids(out) == wanted(name, docs)
        if name == "sharding":
            assert {(r.doc_id, r.shard) for r in out.collect()} == {(r.doc_id, r.shard) for r in sharding.shard_slots(docs).collect()}
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_checkpoints_need_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": lambda self, k, d: d})()

    with pytest.raises(ValueError):
        shared.folder(Session())
