import numpy as np

from tests.llm.helpers import ODD, documents, rows_of
from tickerloom.llm import language_id


def two_languages(n=120):
    rng = np.random.default_rng(3)
    parts = {"aa": ["lo", "ki", "ma", "ze"], "bb": ["schr", "üng", "ött", "ein"]}
    return [(i, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(rng.integers(5, 60))), lang) for i in range(n) for lang in [("aa", "bb")[i % 2]]]


def test_held_out_accuracy(spark):
    docs = two_languages()
    got = {r.doc_id: r for r in language_id.identify(documents(spark, docs)).collect()}
    held = [d for d in docs if got[d[0]].held_out]
    assert 20 < len(held) < 60
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.n_agreeing <= r.n_positions for r in got.values())
    assert all(got[i].n_positions == len(t.encode()) for i, t, _ in docs)


def test_unknown_and_odd_rows(spark):
    docs = [*two_languages(60), *((i and i + 1000, t, "aa") for i, t in ODD), (2000, "12 !? 34", "aa"), (2001, None, None), (2002, "text", None)]
    got = language_id.identify(documents(spark, docs))
    assert got.count() == len(docs)
    unknown = {r.doc_id for r in got.where("lang_pred = 'und'").collect()}
    assert unknown == {1001, 1002, 1003, 2000, 2001} and got.where("lang_pred = 'und' AND score <> 0").count() == 0
    kept = language_id.identified(documents(spark, docs))
    assert kept.columns == documents(spark, docs).columns and kept.count() == len(docs) - 5


def test_nothing_to_learn(spark):
    docs = documents(spark, [(1, "text", None), (2, None, None)])
    assert rows_of(language_id.identify(docs), "lang_pred", "score") == [("und", 0.0), ("und", 0.0)]
    assert language_id.identify(documents(spark, [])).count() == 0


def test_windows_cover_every_byte_once():
    for sizes in ([0], [1, 127, 128, 129, 0, 300, 1000]):
        offsets = np.append(0, np.cumsum(sizes))
        owner, start, skip, fill = language_id.windows(offsets)
        seen = np.zeros(offsets[-1], int)
        for o, s, k, f in zip(owner, start, skip, fill):
            assert offsets[o] <= s + k and s + f <= offsets[o + 1]
            seen[s + k : s + f] += 1
        assert (seen == 1).all()


def test_gradients_equal_differences():
    network = language_id.Network(["a", "b", "c"], seed=5)
    rng = np.random.default_rng(0)
    for p in network.parameters():
        p *= 0.5
    codes, answer = rng.integers(0, 256, (6, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, grads = network.gradients(codes, answer)
    for p, g in zip(network.parameters(), grads):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, values = p[at], []
        for step in (1e-2, -1e-2):
            p[at] = old + step
            values.append(network.gradients(codes, answer)[0])
        p[at] = old
        assert abs((values[0] - values[1]) / 2e-2 - g[at]) < 0.05 * abs(g[at]) + 2e-4
