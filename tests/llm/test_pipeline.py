"""The pipeline's stages against plain rules on a small fixture, and its guard."""

import ast
import os

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import rows_of
from tests.llm.test_packing import check_packed
from tickerloom.llm import language_id, simhash

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline

    docs = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(stage(spark, docs[-1], FOLDER).cache())
    return docs


def test_order_and_columns(stages):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    for frame in stages[1:-1]:
        assert frame.columns == stages[0].columns and frame.exceptAll(stages[0]).count() == 0


def test_each_stage_takes_effect_on_its_own_input(spark, stages):
    start, good, known, single, clean, packed = ({r.doc_id: r.text for r in s.select("doc_id", "text").collect()} if "text" in s.columns else s.toPandas() for s in stages)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = [labels[i] for i in good if i in labels]
    gone = [labels[i] for i in start if i in labels and i not in good]
    assert np.mean(kept) > 0.95 and np.mean(gone) < 0.1
    assert set(known) == {i for i, t in good.items() if any(c.isalpha() for c in t)}
    components = simhash.brute_force(list(known), list(known.values()))
    assert set(single) == set(components["component_id"])
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaky = {i for i, t in single.items() if any(x in t for x in items)}
    assert set(clean) == set(single) - leaky
    check_packed(packed, list(clean.items()), 2048)


def test_run_equals_the_stages(spark, stages):
    import corpus_pipeline

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows_of(corpus_pipeline.run(spark, FOLDER), *columns) == rows_of(stages[-1], *columns)


def test_operators_swallow_no_import_errors():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    files = [f"{root}/corpus_pipeline.py", *(f"{root}/tickerloom/llm/{n}" for n in os.listdir(f"{root}/tickerloom/llm") if n.endswith(".py"))]
    for name in files:
        tree = ast.parse(open(name).read())
        assert not any(isinstance(n, ast.Try) for n in ast.walk(tree)), name
    assert os.path.exists(public_tokenizers.path("byte_bpe_50k.json"))


def test_stages_on_odd_rows_and_clashing_names(spark):
    import corpus_pipeline
    from tests.llm.helpers import ODD, documents

    rows = [*ODD, (None, "no id here"), (None, None), (1, "some other words stand here"), (3, None)]
    for given in (rows, []):
        docs = documents(spark, given).selectExpr("*", "1 AS _quality", "2 AS _language_score", "'l' AS _leak", "4 AS _row", "5 AS _row_fp", "map('a', 1) AS m")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, FOLDER).cache()
            assert out.count() <= docs.count() or k == 4
            if k < 4:
                assert out.columns == docs.columns
                docs = out
        assert given or out.count() == 0


def test_language_scores_decide(spark):
    import corpus_pipeline
    from tests.llm.helpers import documents

    plain = {"en": "the house and the garden were with them that day ", "de": "der Hund und die Katze sind nicht auf dem Haus "}
    rows = [(k, plain[lang] * (1 + k % 4), lang) for k, lang in enumerate(("en", "de") * 30)]
    # Half of each: neither language is known.
    mixed = [(100 + k, plain["en"] * k + plain["de"] * k, None) for k in range(1, 9)]
    docs = documents(spark, rows).unionByName(documents(spark, mixed).withColumn("lang", F.lit(None).cast("string")))
    scores = {r.doc_id: r.score for r in language_id.identify(docs).collect()}
    unsure = {i for i, s in scores.items() if s < corpus_pipeline.LEAST_LANGUAGE_SCORE}
    assert unsure and unsure <= {i for i, *_ in mixed}
    kept = {r.doc_id for r in corpus_pipeline.keep_known_language(spark, docs, FOLDER).collect()}
    assert kept == set(scores) - unsure
