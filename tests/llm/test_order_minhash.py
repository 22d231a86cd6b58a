import hashlib
import random

from tests.helpers import plan_of
from tests.llm.helpers import ODD, documents
from tickerloom.llm import order_minhash


def edited_texts(rows):
    """Ids without nulls first, then by text, as the operator orders them."""
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        out.append((i, len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()))
    return out


def test_edits_over_several_buckets(spark):
    rows = [(i, t) for i, t in ODD if i is not None] + [(5000 * k + 1, f"text number {k} " * (k + 1)) for k in range(1, 9)]
    got = order_minhash.fingerprint(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(edited_texts(rows))


def test_fingerprints_follow_the_text(spark):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st", "l")]
    base = rng.choices(words, k=300)
    swapped = base[150:] + base[:150]
    few = list(base)
    few[40] = "zzz"
    rows = [(0, " ".join(base)), (1, " ".join(base)), (2, " ".join(few)), (3, " ".join(swapped)), (4, " ".join(rng.choices(words, k=300))), (5, "ab " * 400), (6, "ab " * 390)]
    got = {r.doc_id: r for r in order_minhash.fingerprint(documents(spark, rows)).collect()}
    assert got[0].fingerprint == got[1].fingerprint and got[0].near_next == 1.0
    assert got[1].near_next > 0.7
    # The same k-mers in another order are less alike than a small edit.
    assert got[2].near_next < got[1].near_next and got[3].near_next < 0.1
    assert 0 < got[5].near_next < 1
    assert all(len(r.fingerprint) == 8 * order_minhash.HASHES and 0 <= r.near_edited <= 1 for r in got.values())


def test_odd_rows(spark):
    got = order_minhash.fingerprint(documents(spark, [*ODD, (None, "other"), (None, None)]))
    rows = got.collect()
    assert len(rows) == len(ODD) + 2
    assert len({r.fingerprint for r in rows if r.n_chars == 0}) == 1
    assert order_minhash.fingerprint(documents(spark, [])).count() == 0
    [only] = order_minhash.fingerprint(documents(spark, [(1, "abcdefgh")])).collect()
    assert only.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and only.near_next == 1.0


def test_pool_equals_brute_force(spark):
    """The POOL smallest occurrence-numbered k-mers, from hashes that Spark gives for single values."""
    from pyspark.sql import functions as F

    for text in ("abcdefgh" * 3, "ab " * 200, "one text without any repeat", "x" * 100, "abc"):
        kmers = [text[i : i + order_minhash.K] for i in range(max(len(text) - order_minhash.K + 1, 1))]
        seen, numbered = {}, []
        for i, k in enumerate(kmers):
            numbered.append((i, k, seen.get(k, 0)))
            seen[k] = seen.get(k, 0) + 1
        mark = F.shiftright(F.xxhash64("k"), order_minhash.POSITION_BITS)
        own = F.when(F.col("o") == 0, mark).otherwise(F.shiftright(F.xxhash64(mark, "o"), order_minhash.POSITION_BITS))
        frame = spark.createDataFrame(numbered, "i int, k string, o int").withColumn("h", own).orderBy("h", "i").limit(order_minhash.POOL)
        want = []
        for j in range(order_minhash.HASHES):
            two = frame.withColumn("g", F.shiftright(F.xxhash64("h", F.lit(j)), order_minhash.POSITION_BITS)).orderBy("g", "i").limit(2).orderBy("i")
            want.append(two.agg(F.sort_array(F.collect_list(F.struct("i", "g"))).alias("x")).select(
                F.xxhash64(F.transform("x", lambda t: t["g"])).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).first()[0])
            if j == 2:
                break
        got = order_minhash.with_signature(spark.createDataFrame([(text,)], "text string"), "text", "s").first()["s"]
        assert got[:3] == want


def test_no_python_in_the_plan(spark):
    plan = plan_of(order_minhash.fingerprint(documents(spark, ODD)))
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_likeness_of_texts_of_unequal_length_is_that_of_all_kmers(spark):
    """A text and the same with more text behind it: every k-mer of either counts, however much longer one of them is."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for i in range(60):
        base = "".join(rng.choices(letters, k=600))
        rows += [(i, 1.5, base, base + "".join(rng.choices(letters, k=300))), (i, 2.0, base, base + "".join(rng.choices(letters, k=600)))]
    frame = spark.createDataFrame(rows, "i int, times double, a string, b string").repartition(8)
    frame = order_minhash.with_signature(order_minhash.with_signature(frame, "a", "sa"), "b", "sb")
    got = {r.times: r.x for r in frame.groupBy("times").agg(F.avg(order_minhash.likeness(F.col("sa"), F.col("sb"))).alias("x")).collect()}
    # Both minima of the longer text stand in the shorter one with the square of the share of its k-mers.
    for times, x in got.items():
        share = (600 - order_minhash.K + 1) / (600 * times - order_minhash.K + 1)
        assert abs(x - share**2) < 0.04


def test_batches_equal_data_frame_form(spark):
    rng = random.Random(11)
    letters = "ab é中ñ…"
    rows = [*ODD, (None, "other"), (None, None)]
    rows += [(2000 + i, "".join(rng.choices(letters[: rng.choice((2, 3, 8))], k=rng.choice((1, 3, 7, 8, 9, 20, 500, 6000))))) for i in range(60)]
    rows += [(3000, "中" * 50), (3001, "abcdefg"), (3002, "abcdefgh"), (3003, "abcdefghi" * 1000)]
    want = order_minhash.fingerprint(documents(spark, rows)).collect()
    got = order_minhash.fingerprint_in_batches(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    assert order_minhash.fingerprint_in_batches(documents(spark, [])).count() == 0


def test_kmers_of_wide_characters_equal_plain_python():
    """Code points of four bytes, up to the 32-byte form of the hash, against the reference library of the hash."""
    import numpy as np
    import xxhash

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def of_ints(mark, number):
        h = xxhash.xxh64_intdigest((mark & (1 << 64) - 1).to_bytes(8, "little"), 42)
        return signed(xxhash.xxh64_intdigest(number.to_bytes(4, "little"), h))

    rng = random.Random(2)
    for text in ("😀" * 30, "".join(rng.choices("a😀é中", k=400)), "😀a", "x" * 20):
        seen, want = {}, []
        for i in range(max(1, len(text) - order_minhash.K + 1)):
            mark = signed(xxhash.xxh64_intdigest(text[i : i + order_minhash.K].encode(), 42)) >> order_minhash.POSITION_BITS
            number = seen[mark] = seen.get(mark, -1) + 1
            want.append(of_ints(mark, number) >> order_minhash.POSITION_BITS if number else mark)
        marks = order_minhash.kmer_marks(np.frombuffer(text.encode(), np.uint8))
        assert marks.tolist() == want
        least, where = order_minhash.two_least(marks)
        for j in range(order_minhash.HASHES):
            two = sorted((of_ints(m, j) >> order_minhash.POSITION_BITS, i) for i, m in enumerate(want))[:2]
            assert [(h, i) for h, i in zip(least[j].tolist(), where[j].tolist(), strict=True) if i >= 0] == two
