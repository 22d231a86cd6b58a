import random

import numpy as np

from tests.llm.helpers import ODD, documents, rows_of
from tickerloom.llm import decontaminate


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_subsequence_equals_the_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 90))] for _ in range(2))
        assert decontaminate.common_subsequence(np.array(a), np.array(b))[0] == lcs(a, b)


def corpus(seed=2, n=80):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(800)] + ["the", "of", "and"] * 60
    items = [(k, " ".join(rng.choices(words, k=size))) for k, size in enumerate([6, 13, 14, 20, 30, 45, 70])]
    docs, planted = [], set()
    for i in range(n):
        text = rng.choices(words, k=rng.randint(20, 300))
        if i % 4 == 0:
            k = (i // 4) % len(items)
            own = items[k][1].split(" ")
            if i % 8 == 0 and len(own) >= 20:
                # A paraphrase: every ninth word is another one, one word is left out.
                own = [w if j % 9 != 4 else "other" for j, w in enumerate(own) if j != 11]
            at = rng.randrange(len(text))
            text[at:at] = [w.upper() + "," if j % 5 == 0 else w for j, w in enumerate(own)]
            planted.add((i, k))
        docs.append((i, " ".join(text)))
    return docs, items, planted


def test_planted_items_and_paraphrases_are_found_and_nothing_else(spark):
    docs, items, planted = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(documents(spark, docs), bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == planted
    # More items than are searched at once.
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, docs), bench, items_at_once=3).collect()} == planted
    frame = documents(spark, docs)
    kept = decontaminate.clean(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in planted}


def test_odd_rows(spark):
    docs, items, planted = corpus(n=24)
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "..."), (None, items[5][1])], "item_id long, text string")
    odd = [*docs, *((i and i + 500, t) for i, t in ODD), (None, items[4][1]), (docs[0][0], docs[0][1])]
    found = decontaminate.leaks(documents(spark, odd), bench)
    pairs = [(r.doc_id, r.item_id) for r in found.collect()]
    assert planted <= set(pairs) and (None, 4) in pairs and not {p[1] for p in pairs} & {50, 51, 52}
    assert {d for d, k in pairs if k is None} == {d for d, k in pairs if k == 5}
    assert pairs.count((0, 0)) == 2


def test_empty_tables(spark):
    docs, items, _ = corpus(n=8)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.leaks(documents(spark, []), bench).count() == 0
    assert decontaminate.leaks(documents(spark, docs), bench.limit(0)).count() == 0
    assert decontaminate.clean(documents(spark, docs), bench.limit(0)).count() == 8


def test_sketch_equals_the_matrix_product(spark):
    docs, items, _ = corpus(n=12)
    words = [h for _, _, h, _ in decontaminate.words_of(__import__("pyarrow").array([t for _, t in items]))][0]
    bench = decontaminate.Benchmark([0], [words])
    n, frequency, moment = decontaminate.sketch(documents(spark, docs), bench)
    place = {int(w): i for i, w in enumerate(bench.vocabulary)}
    counts, df = [], np.zeros(len(place))
    for _, text in docs:
        [(_, _, h, _)] = list(decontaminate.words_of(__import__("pyarrow").array([text])))
        for w in set(map(int, h)) & set(place):
            df[place[w]] += 1
        for a in range(0, len(h), decontaminate.PASSAGE):
            row = np.zeros(len(place))
            for w in map(int, h[a : a + decontaminate.PASSAGE]):
                if w in place:
                    row[place[w]] += 1
            counts.append(row)
    c = np.array(counts)
    assert n == len(docs) and (frequency == df).all()
    assert np.allclose(moment, c.T @ (c @ decontaminate.random_matrix(len(place), decontaminate.SKETCH)), atol=1e-2)


def brute_force(words, item):
    """Whether some region of the text is a leak, by the leak rule over every region."""
    answer, n = set(item[-decontaminate.ANSWER_WORDS:]), len(item)
    for s in range(len(words)):
        region = words[s : s + n + 2 * (n // 4 + 2)]
        places = [k for k, w in enumerate(region) if w in set(item)]
        if len(places) >= 0.8 * n and lcs(item, region) / n >= 0.8 and len(answer & set(region[places[0] : places[-1] + 1])) >= 0.6 * len(answer):
            return True
    return False


def test_scattered_insertions_and_omissions_are_found_as_by_brute_force(spark):
    rng = random.Random(8)
    rare, common = [f"r{i}" for i in range(600)], ["the", "of", "and", "to", "in"]
    items = [(k, rng.sample(rare, size) if k % 2 else rng.choices(rare + common * 40, k=size)) for k, size in enumerate([12, 16, 20, 25, 31, 40, 59])]
    other = [w for _, item in items for w in item]
    docs, sure = [], set()
    for k, item in items:
        n = len(item)
        for m, filler in ((2, None), (3, None), (3, other), (4, None), (4, other), (5, None), (5, other)):
            # One word after every m-th: a common subsequence of the whole item.
            text = [x for j, w in enumerate(item) for x in ([w, rng.choice(filler) if filler else "zz"] if j % m == m - 1 else [w])]
            docs.append(text)
            sure.add((len(docs) - 1, k))
        for m in (5, 6, 7):
            # Every m-th word of the item is left out, its last words stay.
            text = [w for j, w in enumerate(item) if j % m != m - 2 or j >= n - 2]
            docs.append(text)
            if len(text) >= 0.8 * n:
                sure.add((len(docs) - 1, k))
        for _ in range(6):
            # Around the bar: words left out, put in and replaced at random.
            docs.append([x for w in item for x in rng.choice([[w]] * 8 + [[], ["zz"], [w, rng.choice(other)]])])
        docs.append(rng.sample(item, n))
    docs = [rng.choices(rare + common * 60, k=rng.randint(0, 40)) + t + rng.choices(rare + common * 60, k=rng.randint(0, 40)) for t in docs]
    want = {(i, k) for i, t in enumerate(docs) for k, item in items if brute_force(t, item)}
    assert sure <= want
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")
    found = decontaminate.leaks(documents(spark, [(i, " ".join(t)) for i, t in enumerate(docs)]), bench).collect()
    found = {(r.doc_id, r.item_id) for r in found}
    # Long items may also be found in part.
    assert want <= found and {p for p in found - want if p[1] < 6} == set()
