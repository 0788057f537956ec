"""The filter interaction audit against removing documents one filter after another."""

from itertools import permutations

import numpy as np
import pytest

from rillmark.llm import filter_audit as A


def plain(rows, labels):
    """rows (id, text, part), labels (id, quality, toxic): the report by carrying out every order."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}

    def failed(i, text, part):
        w = text.translate(dict.fromkeys(map(ord, "\t\n\x0b\f\r"), " ")).split(" ")
        w = [x for x in w if x]
        again = i is not None and any(j is not None and j < i and t == text for j, t, _ in rows)
        return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": again}

    rows = [(i, t or "", p or "") for i, t, p in rows]
    fails = [(i, p, failed(i, t, p)) for i, t, p in rows]
    out = {}
    for part in {p for _, p, _ in fails}:
        own = [(i, f) for i, p, f in fails if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, letter in enumerate(order):
                gone, stay = [x for x in left if x[1][letter]], [x for x in left if not x[1][letter]]
                redundant = sum(f[letter] for _, f in own) - len(gone)
                unique = sum(f[letter] and sum(f.values()) == 1 for _, f in own)
                out[part, "".join(order), k + 1] = [len(stay), len(gone), redundant, unique, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                shapley[letter] += len(gone)
                left = stay
        for order in permutations("ABCDE"):
            for k, letter in enumerate(order):
                out[part, "".join(order), k + 1].append(shapley[letter])
    return out


def report(df):
    return {(r.part, r.filter_order, r.step): [r[m] for m in A.MEASURES] for r in df.collect()}


def test_audit_equals_applying_every_order(spark, odd):
    rng = np.random.default_rng(5)
    rows = [(r.doc_id, r.text, r.source) for r in odd.filter("doc_id IS NULL OR doc_id NOT IN (9, 10)").collect()]
    for i in range(60):
        n = int(rng.integers(150, 260))
        words = [f"w{rng.integers(0, 60 if i % 3 else 4000)}" for _ in range(n)]
        text = " ".join(words) + (" #" if i % 5 == 0 else "") + (" ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 2 if i % 7 == 0 else "")
        rows += [(100 + i, text, f"s{i % 2}"), *([(200 + i, text, None), (200 + i, text, None)] if i % 4 == 0 else [])]
    labels = [(100 + i, i % 2, int(i % 6 == 0)) for i in range(0, 60, 2)] + [(100, 1, 0), (None, 1, 1), (7, 1, None), (204, None, 1)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, part string, n int")
    got = report(A.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == plain(rows, labels)
    assert {k[0] for k in got} >= {"", "s0", "s1"} and any(v[2] for v in got.values()) and any(v[5] for v in got.values())


def test_audit_of_odd_rows(odd, none, labels):
    got = report(A.filter_audit(odd, labels))
    parts = {r.source or "" for r in odd.collect()}
    assert {k[0] for k in got} == parts and len(got) == 600 * len(parts)
    sizes = {p: sum((r.source or "") == p for r in odd.collect()) for p in parts}
    for (part, order, step), v in got.items():
        if step == 5:
            assert v[0] + sum(got[part, order, s][1] for s in range(1, 6)) == sizes[part]
    assert A.filter_audit(none, labels).collect() == []
    assert all(v[4] == v[5] == 0 for v in report(A.filter_audit(odd, labels.limit(0))).values())


def test_removal_steps_are_the_first_failing_filter():
    steps = A.removal_steps()
    for o, order in enumerate(A.ORDERS):
        for mask in range(A.MASKS):
            failed = [f for k, f in enumerate(A.FILTERS) if mask >> k & 1]
            assert steps[o, mask] == min((order.index(f) for f in failed), default=5)


@pytest.mark.parametrize("copies", [5000])
def test_a_text_of_half_the_table_is_a_few_rows(spark, copies):
    docs = spark.createDataFrame([(i, "same text" if i < copies else f"other {i}", f"s{i % 3}") for i in range(2 * copies)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    got = report(A.filter_audit(docs, labels))
    assert sum(got[f"s{k}", "EABCD", 1][1] for k in range(3)) == copies - 1
    assert sum(got[f"s{k}", "ABCDE", 1][4] for k in range(3)) == 1
