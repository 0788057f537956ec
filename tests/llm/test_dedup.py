"""Deduplication against brute force, and odd rows."""

import hashlib
import random

import numpy as np
import pytest

from rillmark.llm import near_dedup
from rillmark.llm.common import with_ids, without_ids
from rillmark.llm.components import connected_components
from rillmark.llm.exact_dedup import exact_dedup
from rillmark.llm.line_dedup import line_dedup
from rillmark.llm.near_dedup import bands_for, near_duplicates, superminhash

BLANKS = " \t\n\x0b\f\r"


def shingles(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def components(rows, k, num, den):
    """(doc_id, n, component) by comparing all pairs of sets."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(s), root(i)) for i, s in sets)


def variants(seed, n, words=60):
    """Loose and close copies of a few texts, so that links chain."""
    r = random.Random(seed)
    base = [[f"w{r.randrange(500)}" for _ in range(words)] for _ in range(3)]
    out = []
    for i in range(n):
        t = list(r.choice(base))
        for _ in range(r.randrange(0, 7)):
            t[r.randrange(len(t))] = f"v{r.randrange(60)}"
        out.append((i, " ".join(t)))
    return out


@pytest.mark.parametrize("k,num,den", [(3, 85, 100), (5, 4, 5)])
def test_near_duplicates_equal_brute_force(spark, k, num, den):
    rows = variants(k, 150)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=k, num=num, den=den)
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got.collect()) == components(rows, k, num, den)


def test_a_large_group_of_loose_copies_costs_few_pairs(spark, monkeypatch):
    """2000 copies of one text, most of them linked with none or few others: all links are found, without all pairs."""
    r, n, k, num, den = random.Random(5), 2000, 5, 4, 5
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        t = list(base)
        for at in r.sample(range(len(t)), r.randrange(2, 10)):
            t[at] = r.choice([f"v{r.randrange(20)}", f"own{i}x{at}", ""])
        rows.append((i, " ".join(t)))
    sets = [shingles(t, k) for _, t in rows]
    seen: dict = {}
    for s in sets:
        for x in s:
            seen[x] = seen.get(x, 0) + 1
    column = {x: j for j, x in enumerate(x for x, c in seen.items() if c > 1)}
    matrix = np.zeros((n, len(column)), np.float32)
    for i, s in enumerate(sets):
        matrix[i, [column[x] for x in s if x in column]] = 1
    both, size = matrix @ matrix.T, np.array([len(s) for s in sets])
    links = np.argwhere(den * both >= num * (size[:, None] + size[None, :] - both))
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links.tolist():
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    asked = []
    real = near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, *a: asked.append(pairs.count()) or real(pairs, *a))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=k, num=num, den=den).collect()
    assert {x.id: x.component_id for x in got} == {i: root(i) for i in range(n)}
    assert len({root(i) for i in range(n)}) > 500  # most are linked with none, which is what would cost all pairs
    assert asked[1] < 10 * n  # of 2 million


def test_rows_by_ids_through_a_bloom_filter(spark):
    rows = spark.createDataFrame([(i if i % 50 else None, str(i)) for i in range(1000)], "k long, __bits string")
    ids = spark.createDataFrame([(i,) for i in range(0, 5000, 7)], "a long")
    want = {i for i in range(1000) if i % 50 and i % 7 == 0}
    assert {r.k for r in with_ids(rows, "k", ids).collect()} == want
    rest = without_ids(rows, "k", ids).collect()
    assert len(rest) == 1000 - len(want) and not want & {r.k for r in rest}
    assert with_ids(rows, "k", ids.limit(0)).count() == 0 and without_ids(rows, "k", ids.limit(0)).count() == 1000


def test_near_duplicates_of_odd_rows(odd, none):
    got = near_duplicates(odd, shingle_words=3, num=85, den=100).collect()
    assert len(got) == odd.count()
    by = {r.id: r for r in got}
    assert by[2].component_id == 1 and not by[2].kept and by[1].kept
    assert by[7].component_id == 6 and by[3].n_shingles == by[4].n_shingles == by[5].n_shingles == 0
    assert by[4].component_id == 4 and by[None].component_id is None and not by[None].kept
    assert by[9].n_shingles == 1 and by[10].n_shingles == 1
    assert near_duplicates(none).collect() == []


def test_superminhash_estimates_jaccard_and_is_early_stopping_free():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 3000).astype(np.uint64)
    m = 512
    for shared in (100, 500, 900):
        a, b = pool[:1000], np.concatenate((pool[:shared], pool[1000 : 2000 - shared]))
        sig = superminhash(np.concatenate((a, b)), np.array([len(a), len(b)]), m)
        assert abs((sig[0] == sig[1]).mean() - shared / (2000 - shared)) < 0.08
    one = superminhash(pool[:1], np.array([1]), 16)
    assert sorted((one[0] >> np.uint64(44)).tolist()) == list(range(16))  # one element deals each rank once
    assert bands_for(0.85) * 5 <= 130


def test_components_of_a_long_chain(spark):
    n = 300
    links = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5, 5), (None, 3)]
    random.Random(0).shuffle(links)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("digest", ["all", "survivors"])
def test_exact_dedup_of_odd_rows(odd, none, digest):
    bare = lambda t: "".join(c for c in t or "" if c not in BLANKS)
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0, i))
    got = exact_dedup(odd, digest=digest).collect()
    assert len(got) == len(rows)
    for r in got:
        t = next(t for i, t in rows if i == r.id)
        own = groups[bare(t)]
        assert (r.keep_id, r.group_size, r.kept) == (min(own)[3], len(own), min(own)[3] == r.id)
        if digest == "all" or len(own) > 1:
            assert r.full_hash == hashlib.sha256(bare(t).encode()).hexdigest()
    assert exact_dedup(none, digest=digest).collect() == []


def test_line_dedup_against_brute_force(spark, monkeypatch):
    r = random.Random(3)
    rows = []
    for i in range(300):
        host = r.choice(["a", "a", "a", "b", None])
        lines = [r.choice(["hot", "\thot \r", "warm", f"l{r.randrange(200)}", "", "cold"]) for _ in range(r.randrange(0, 6))]
        rows.append((i, host, "\n".join(lines) if i % 50 else None))
    rows += [(i, "c", "the same\npage") for i in range(300, 330)] + [(i, "c", f"one\r\n{i}") for i in range(330, 340)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    ratio, least = 0.2, 3
    pages, total = {}, {}
    for _, h, t in rows:
        total[h or ""] = total.get(h or "", 0) + 1
        for x in {x.strip(BLANKS) for x in (t or "").split("\n")} - {""}:
            pages.setdefault((h or "", x), set()).add(t)
    bad = {k for k, c in pages.items() if len(c) >= least and len(c) > ratio * total[k[0]]}
    assert ("c", "one") in bad and ("c", "page") not in bad and ("a", "hot") in bad
    for rows_broadcast in (None, 3, -1):
        if rows_broadcast is not None:  # the ways beyond the bound: large hosts alone, or none, broadcast
            monkeypatch.setattr("rillmark.llm.line_dedup.BROADCAST_ROWS", rows_broadcast)
        got = {x.doc_id: x for x in line_dedup(df, ratio=ratio, min_pages=least).collect()}
        assert len(got) == len(rows)
        for i, h, t in rows:
            left = [x for x in (t or "").split("\n") if (h or "", x.strip(BLANKS)) not in bad]
            n = len((t or "").split("\n"))
            assert (got[i]["__n_lines"], got[i]["__n_dropped"]) == (n, n - len(left))
            assert got[i].text == (t if n == len(left) else "\n".join(left))


def test_line_dedup_of_odd_rows(odd, none, monkeypatch):
    a = sorted(map(str, line_dedup(odd, ratio=0.2, min_pages=2).collect()))
    assert len(a) == odd.count()
    monkeypatch.setattr("rillmark.llm.line_dedup.BROADCAST_ROWS", -1)  # the way without a broadcast
    assert sorted(map(str, line_dedup(odd, ratio=0.2, min_pages=2).collect())) == a
    assert line_dedup(none).collect() == []
