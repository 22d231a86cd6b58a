import hashlib
import random
import re

from tests.helpers import plan_of
from tests.llm.helpers import ODD, documents, rows_of
from tickerloom.llm import personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_of(text):
    spans = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),  # noqa: B023
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,  # noqa: B023
            }[kind]()
            if good:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
    return spans


def noise(seed):
    rng = random.Random(seed)
    parts = ["a", "1", "22", "@", ".", "-", " ", "+", "(", ")", "é", "🙂", "_", "%", "300", "4111 1111 1111 1111", "4111111111111111", "x@y.z", "1.2.3.4", "+1 (555) 555-0100", "\n", "0"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(1, 120)))


TEXTS = [
    "mail a.b+c@d-e.f.g. and é@x.y _q@r.s_t@u.v", "🙂 ip 1.2.3.4.5.6.7.8 300.1.2.3.4 001.02.0.255 256.1.1.1", "4111 1111 1111 1111 12 4111-1111-1111-1111, 5500005555555559",
    "+1 (555) 555-0100 +49 30 901820 +1 2 +12345678901234567 ++33.1.23.45.67.89", "a@b", "@", "+1", "1" * 3000, "a@b." * 3000, "1 " * 3000, "x@y.z " * 700, "1.2.3.4 " * 600,
]


def test_base_equals_brute_force(spark):
    rows = [*ODD, *((100 + k, t) for k, t in enumerate(TEXTS)), *((1000 + k, noise(k)) for k in range(300))]
    got = personal_data.find(documents(spark, rows)).collect()
    want = []
    for i, t in rows:
        spans = base_of(t)
        want.append((i, *(sum(s.startswith(k) for s in spans) for k in PATTERNS), hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=repr) == sorted(want, key=repr)
    texts = dict((k, t) for k, t in rows)
    for r in got:
        spans = [s for s in r.spans.split(",") if s]
        assert set(base_of(texts[r.doc_id])) <= set(spans) and len(spans) == len(set(spans))
        order = [(personal_data.KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in spans)]
        assert order == sorted(order) and r.n_added == len(spans) - r.n_email - r.n_ip - r.n_card - r.n_phone


def test_added_spans(spark):
    cases = [
        ("call me at (555) 321-8877 now", ["phone:11:25"]), ("please pay order 000-000-0000 soon", []), ("my ssn 457-55-5462 ok", ["ssn:7:18"]), ("part 666-45-6789 here", []),
        ("write to joe.bloggs (at) example (dot) com ok", ["email:9:42"]), ("we arrive at noon.After that", []), ("the iban DE89 3704 0044 0532 0130 00 is", ["iban:9:36"]),
        ("serial AB12 CDEF 3456 found", []), ("host 2001:0db8:0000:0000:0000:ff00:0042:8329 up", ["ip:5:44"]), ("card 4111 1111 1111 1111 12 ok", ["card:5:24"]),
        ("mail a@b.cd or call +1 (555) 555-0100", ["email:5:11", "phone:20:37"]), ("nothing to see here, 12 apples and 2020-01-02", []),
    ]
    got = {r.doc_id: r.spans for r in personal_data.find(documents(spark, [(k, t) for k, (t, _) in enumerate(cases)])).collect()}
    assert [got[k] for k in range(len(cases))] == [",".join(w) for _, w in cases]


def test_redacted_texts(spark):
    rows = [(1, "🙂 mail a@b.cd, ip 1.2.3.4!"), (2, None), (3, "plain"), (4, "+4111111111111111 and call (555) 321-8877"), (4, "x@y.z")]
    got = rows_of(personal_data.redact(documents(spark, rows)), "doc_id", "text")
    assert got == sorted([(1, "🙂 mail <email>, ip <ip>!"), (2, None), (3, "plain"), (4, "+<card> and call <phone>"), (4, "<email>")], key=repr)


def test_examples_are_proposed():
    for gen, span, before, after, _ in personal_data.example_rows():
        # Python and Java read these patterns alike, but for the place of the last match.
        pattern = personal_data.GENERATORS[gen][3].replace(r"\G|", "")
        assert span in [m.group() for m in re.finditer(pattern, before + span + after)], (span, personal_data.GENERATORS[gen][0])


def test_empty_table_and_plan(spark):
    assert personal_data.find(documents(spark, [])).count() == 0
    plan = plan_of(personal_data.find(documents(spark, ODD)))
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
