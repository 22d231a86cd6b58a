import random

import numpy as np
import xxhash

from tests.llm.helpers import ODD, documents, rows_of
from tickerloom.llm import simhash


def plain_fingerprint(text):
    """The contract's words, without numpy."""
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprint():
    for _, text in ODD:
        assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = [(i, t) for i, t in ODD if i is not None]
    base = [rng.choices(vocabulary, k=120) for _ in range(12)]
    for k in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append((100 + k, " ".join(words)))
    found = simhash.near_duplicates(documents(spark, docs))
    want = simhash.brute_force([d for d, _ in docs], [t for _, t in docs])
    assert rows_of(found, "doc_id", "fingerprint", "component_id") == sorted((tuple(r) for r in want.itertuples(index=False)), key=repr)
    kept = rows_of(simhash.one_of_each(documents(spark, docs)), "doc_id")
    assert kept == sorted({(int(c),) for c in want["component_id"]}, key=repr)


def test_tiles_split_large_cells_without_losing_links(spark):
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    marks = {int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for s in seeds for _ in range(12)}
    signed = np.array(sorted(marks), np.uint64).view(np.int64).tolist()
    prints = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, first_id long")
    groups = {}
    for tile in (4, 8192):
        edges = [(r.a, r.b) for r in simhash.links(prints, tile=tile).collect()]
        parent = {f: f for f in signed}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[root(a)] = root(b)
        sets = {}
        for f in signed:
            sets.setdefault(root(f), set()).add(f)
        groups[tile] = sorted(map(sorted, sets.values()))
    assert groups[4] == groups[8192]


def test_empty_and_null(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    got = rows_of(simhash.near_duplicates(documents(spark, [(5, None), (3, ""), (None, "")])), "doc_id", "fingerprint", "component_id")
    assert got == [(3, "0" * 16, 3), (5, "0" * 16, 3), (None, "0" * 16, 3)]


def test_repeated_rows_are_kept_once(spark):
    docs = documents(spark, [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "quite other words stand here")])
    assert rows_of(simhash.one_of_each(docs), "doc_id") == [(1,), (3,)]


def test_one_of_each_equals_brute_force_on_repeated_ids(spark):
    import random

    rng = random.Random(6)
    texts = [None, "", "a b c d", "quite other words here", "a b c d", "one two three four five six", "one two three four five six", "zz yy xx ww"]
    for seed in range(4):
        rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice(texts)) for _ in range(3 + 6 * seed)]
        marks = [simhash.fingerprint((t or "").encode()) for _, t in rows]
        group = list(range(len(rows)))
        for _ in rows:
            for i in range(len(rows)):
                for j in range(len(rows)):
                    if (marks[i] ^ marks[j]).bit_count() <= simhash.RADIUS:
                        group[i] = group[j] = min(group[i], group[j])
        want = []
        for g in set(group):
            members = [k for k in range(len(rows)) if group[k] == g]
            ids = [rows[k][0] for k in members if rows[k][0] is not None]
            least = min(ids) if ids else None
            signed = lambda m: m - (1 << 64) if m >> 63 else m
            first = min(signed(marks[k]) for k in members if rows[k][0] == least)
            want.append((least, marks[[k for k in members if rows[k][0] == least and signed(marks[k]) == first][0]]))
        frame = documents(spark, rows).selectExpr("*", "'k' AS _row", "'k' AS _row_id", "1 AS _keeper")
        kept = simhash.one_of_each(frame)
        assert kept.columns == frame.columns
        assert sorted(((r.doc_id, simhash.fingerprint((r.text or "").encode())) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert simhash.one_of_each(documents(spark, [])).count() == 0
