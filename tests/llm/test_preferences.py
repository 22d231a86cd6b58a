from tests.helpers import plan_of
from tests.llm.helpers import rows_of
from tickerloom.llm import preferences

TURNS = "conv_id long, turn long, role string, text string"
ROWS = [
    (0, 0, "system", "s"), (0, 1, "user", "q"), (0, 2, "assistant", "good"), (0, 3, "user", "more"),
    (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "bad"),
    (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", "same"), (3, 1, "assistant", "same"),
    (4, 0, "user", "alone"), (None, 0, "user", "nowhere"),
    (6, 0, None, None), (6, None, "user", "x"), (7, 0, None, None), (7, None, "user", "x"), (7, 0, None, None),
]


def brute_force(rows):
    out, pairs = [], {}
    for c, t, r, x in rows:
        if c is None:
            out.append((None, "unpaired", t, r, False))
        else:
            pairs.setdefault(c // 2, ([], []))[c % 2].append(((t is not None, t or 0), r or "", x or "", t, r))
    for pair, (a, b) in pairs.items():
        a.sort(), b.sort()
        n = 0
        while n < min(len(a), len(b)) and a[n][:3] == b[n][:3]:
            n += 1
        for part, side in (("chosen", a), ("rejected", b)):
            for k, (_, _, _, t, r) in enumerate(side):
                if not a or not b:
                    out.append((pair, "unpaired", t, r, False))
                elif k >= n:
                    out.append((pair, part, t, r, r == "assistant"))
                elif part == "chosen":
                    out.append((pair, "prompt", t, r, False))
    return sorted(out, key=repr)


def formatted(spark, rows):
    turns = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' AS part", "1 AS copy")
    return preferences.format_pairs(preferences.paired(turns))


def test_parts_equal_brute_force(spark):
    assert rows_of(formatted(spark, ROWS), "pair_id", "part", "turn", "role", "trained") == brute_force(ROWS)


def test_segments_join_to_a_sample(spark):
    rows = formatted(spark, ROWS).where("pair_id = 0").orderBy("turn", "copy").collect()
    prompt, chosen, rejected = ("".join(r.segment for r in rows if r.part == p) for p in ("prompt", "chosen", "rejected"))
    assert prompt == "<|system|>\ns<|end|>\n<|user|>\nq<|end|>\n"
    assert chosen == "<|assistant|>\ngood<|end|>\n<|user|>\nmore<|end|>\n" and rejected == "<|assistant|>\nbad<|end|>\n"
    assert [r.segment for r in rows if r.trained] == ["<|assistant|>\ngood<|end|>\n", "<|assistant|>\nbad<|end|>\n"]


def test_a_hot_conversation_and_empty_table(spark):
    rows = [(c, t, "user", f"{t}") for c in (0, 1) for t in range(700)] + [(0, 700, "assistant", "end")]
    found = formatted(spark, rows)
    assert found.where("part = 'prompt'").count() == 700 and found.where("trained").count() == 1
    assert formatted(spark, rows).limit(0).count() == 0 and preferences.format_pairs(preferences.paired(spark.createDataFrame([], TURNS))).count() == 0


def test_no_python_in_the_plan(spark):
    plan = plan_of(preferences.format_pairs(preferences.paired(spark.range(4).selectExpr("id AS conv_id", "id AS turn", "'user' AS role", "'t' AS text"))))
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
