import public_tokenizers
import sentencepiece

from tests.llm.helpers import ODD, documents, rows_of
from tickerloom.llm import token_counts
from tickerloom.session import scratch_dir

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_equal_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = rows_of(token_counts.token_counts(documents(spark, ODD), PIECES), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for doc, text in ((r[0], r[1] or "") for r in ODD):
        n = len(model.encode(text))
        want.append((doc, len(text.encode()), n, n > 4096))
    assert got == sorted(want, key=repr)


def test_a_second_run_encodes_only_what_is_new(spark, monkeypatch):
    cache = scratch_dir(spark, "cache-test")
    token_counts.token_counts(documents(spark, [(1, "a b"), (2, "a b"), (3, None)]), PIECES, cache).collect()
    first = spark.read.parquet(cache)
    assert first.count() == 2
    got = rows_of(token_counts.token_counts(documents(spark, [(1, "a b"), (9, "new text"), (10, "new text")]), PIECES, cache), "doc_id", "n_tokens")
    assert [g[0] for g in got] == [1, 10, 9] and spark.read.parquet(cache).count() == 3
    # Another tokenizer has its own counts.
    token_counts.token_counts(documents(spark, [(1, "a b")]), BYTES, cache).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == 4 and stored.select("version").distinct().count() == 2


def test_empty_table(spark):
    assert token_counts.token_counts(documents(spark, []), PIECES).count() == 0


def test_many_rows_of_one_content_keep_their_rows(spark):
    docs = documents(spark, [(i, "hot text") for i in range(500)] + [(None, "hot text"), (None, None)])
    got = token_counts.token_counts(docs, PIECES)
    assert got.count() == 502 and got.where("n_tokens > 0").select("n_tokens").distinct().count() == 1
