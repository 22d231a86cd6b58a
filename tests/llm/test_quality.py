import numpy as np

from tests.llm.helpers import ODD, documents
from tickerloom.llm import quality


def labelled(spark, n=240):
    """Clean prose against repeated words and marked-up words."""
    rng = np.random.default_rng(1)
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "ten", "sho", "pre") for b in ("n", "der", "tion", "kas", "vy", "o")]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words, rng.integers(30, 200)))
        good = i % 3 > 0
        if not good:
            text = text.replace(" ", "$$$ ") if i % 2 else " ".join([text.split(" ")[0]] * 80)
        docs.append((i, text))
        labels.append((i, int(good), 0))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_fold(spark):
    import zlib

    docs, labels = labelled(spark)
    got = quality.classify(documents(spark, docs), labels).toPandas().set_index("doc_id").sort_index()
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index])
    assert (got.held_out.to_numpy() == held).all() and held.sum() > 20
    truth = np.array([i % 3 > 0 for i in got.index])
    assert (got.predicted.to_numpy()[held] == truth[held]).mean() > 0.95
    assert ((got.score >= 0.3).astype(int) == got.predicted).all() and got.score.between(0, 1).all()


def test_held_out_labels_change_nothing(spark):
    docs, labels = labelled(spark)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(string(doc_id)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = (quality.classify(documents(spark, docs), x).orderBy("doc_id").toPandas().score for x in (labels, flipped))
    assert np.allclose(a, b)


def test_odd_rows_and_odd_labels(spark):
    docs, labels = labelled(spark, 60)
    more = spark.createDataFrame([(1, None, None), (None, 1, 0), (2, 1, 0), (2, 0, 0), (999, 1, 0)], labels.schema)
    got = quality.classify(documents(spark, docs + ODD), labels.union(more))
    assert got.count() == len(docs) + len(ODD) and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_no_labels_and_no_documents(spark):
    docs, labels = labelled(spark, 9)
    none = labels.limit(0)
    assert {r.score for r in quality.classify(documents(spark, docs), none).collect()} == {0.5}
    assert quality.classify(documents(spark, []), labels).count() == 0


def test_accepted_keeps_all_columns(spark):
    docs, labels = labelled(spark, 120)
    frame = documents(spark, docs)
    kept = quality.accepted(frame, labels)
    assert kept.columns == frame.columns and 60 < kept.count() < 100
    assert kept.exceptAll(frame).count() == 0


def test_statistics_do_not_depend_on_the_block():
    texts = ["one two two.\nLine", "", "Ö! ä, ñ", "x" * 50, "a b c a b c"]

    def run(group):
        raw = [t.encode() for t in group]
        return quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))

    whole = run(texts)
    assert np.allclose(whole, np.vstack([run([t]) for t in texts])) and (whole[1] == 0).all()


def test_isotonic_pools_violators():
    assert quality.isotonic(np.array([0.0, 1.0, 0.0, 1.0]), np.array([1.0, 1, 1, 2])).tolist() == [0, 0.5, 0.5, 1]
