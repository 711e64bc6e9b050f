"""Spans that the method adds, on planted personal data and look-alikes."""

import random

from lattika.llm import pii

SCHEMA = "doc_id long, text string, spans string, b_email string"


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def card(rng, good):
    while True:
        d = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        if luhn(d) == good:
            return d


def test_planted_loose_spans(spark):
    """Recall and precision of the learned classifier on spans that the base patterns can't take."""
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(240):
        d = card(rng, i % 2 == 0)
        dotted = ".".join(d[k : k + 4] for k in range(0, 16, 4))
        own = card(rng, True)
        plain = " ".join(own[k : k + 4] for k in range(0, 16, 4))
        person = f"{rng.choice('abc')}{i} [at] mail{i} [dot] com"
        number = f"({rng.randint(200, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}"
        text = f"my card {plain} or {dotted}, write to {person} or call {number}, version 12.5 of {rng.randint(10, 99)}"
        rows.append((i, text, "x", "y"))
        want[i] = {("email", text.index(person), text.index(person) + len(person)), ("phone", text.index(number), text.index(number) + len(number))}
        if i % 2 == 0:
            want[i].add(("card", text.index(dotted), text.index(dotted) + 19))
    got = {r.doc_id: {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)} for r in pii.pii_digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    base = {i: {("card", t.index("card ") + 5, t.index("card ") + 24)} for i, t, *_ in rows}
    added = {i: got[i] - base[i] for i in got}
    assert all(base[i] <= got[i] for i in got)
    found, right = sum(len(x) for x in added.values()), sum(len(added[i] & want[i]) for i in added)
    assert right >= 0.95 * sum(len(x) for x in want.values()), (right, found)
    assert right >= 0.95 * found, (right, found)


def test_repeated_rows_and_long_texts(spark):
    rows = [(1, "a@b.co", "x", "y"), (1, "a@b.co", "x", "y"), (None, "x " * 200000 + "a@b.co", "x", "y")]
    got = sorted((r.doc_id or 0, r.n_email, r.spans) for r in pii.pii_digest(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 1, "email:400000:400006"), (1, 1, "email:0:6"), (1, 1, "email:0:6")]
