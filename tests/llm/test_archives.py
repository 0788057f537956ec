"""Packing, archives, mixing and the pipeline."""

import random
import zlib
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rillmark.llm import mixing, packing, quality_rules, warc
from rillmark.llm.near_dedup import near_duplicates
from rillmark.llm.queries import ORACLES, QUERIES, public_bpe

from ..compare import connection, same
from .test_dedup import BLANKS, components
from .test_models import counts as plain_counts


def test_ids_are_those_of_the_tokenizers_library(docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    encode = public_bpe()[0]
    texts = [r.text for r in docs.select("text").collect()] + ["", " ", "  a  b ", "it's 3.14\n\n x", "日本語\U0001f600", "a b", "<|endoftext|>"]
    for t in texts:
        assert encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_packed_ids_are_those_of_the_json_as_it_is(spark, tmp_path):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x.<|endoftext|><|endoftext|>\n y", "<|<|endoftext|>|> <|endoftext|", "no such text", "", "日本語<|endoftext|>\U0001f600 it's"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert any(50256 in ids for ids in want.values())
    rows = QUERIES["op5_packing"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == {i: len(ids) for i, ids in want.items()}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    got = {}
    for r in sorted(corpus_pipeline.packed(spark, docs, "").collect(), key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == want


def cheapest(at, cost, window, smallest=1):
    """All ways to cut, tried one by one; powers of two below smallest are lengths like any other."""
    price = lambda n: 0 if n == window else packing.SHORT if n & (n - 1) == 0 and n >= smallest else window - n
    best = None
    inner = at[1:-1]
    for k in range(len(inner) + 1):
        for c in combinations(range(len(inner)), k):
            cut = [at[0], *(inner[i] for i in c), at[-1]]
            sizes = [b - a for a, b in zip(cut, cut[1:])]
            if max(sizes) <= window:
                total = sum(min(price(n), window - n) for n in sizes) + sum(cost[1:-1][i] for i in c)
                best = total if best is None else min(best, total)
    return best


@pytest.mark.parametrize("all_powers", [True, False])
def test_best_cuts_are_cheapest(all_powers):
    """With all powers of two, as in a partition's last block, and with the three largest alone, as before it."""
    r = random.Random(5)
    for _ in range(200):
        window = r.choice([8, 64, 256])
        smallest = 1 if all_powers else window // 8
        price = lambda n: min(window - n, packing.SHORT if n & (n - 1) == 0 and n >= smallest else window)  # noqa: E731, B023
        at = [0]
        for _ in range(r.randrange(1, 9)):
            at.append(at[-1] + min(window, r.choice([r.randrange(1, window + 1), window // 2, window // 4, window // 8, window // 16 or 1])))
        cost = [0] + [r.choice([0, 2, 24]) for _ in at[1:-1]] + [0]
        cuts = packing.best_cuts(np.array(at), np.array(cost, float), window, *([0] if all_powers else []))
        assert cuts[0] == 0 and cuts[-1] == at[-1] and set(cuts) <= set(at)
        total = sum(price(b - a) for a, b in zip(cuts, cuts[1:])) + sum(cost[at.index(c)] for c in cuts[1:-1])
        assert total == pytest.approx(cheapest(at, cost, window, smallest))


def check_packing(rows, texts, encode, window=2048):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    ids = {}
    for i, t in texts:
        ids.setdefault(i, []).append([*encode(t or "").tolist(), 1])
    assert sum(r.length for r in rows) == sum(len(x) for v in ids.values() for x in v)
    for (i, n), own in by_doc.items():
        whole = next(x for x in ids[i] if len(x) == n)
        for r in own:
            piece = np.array(whole[r.start : r.start + r.length], "<u4")
            assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32
    sizes = [sum(r.length for r in own) for own in by_seq.values()]
    return sum(0 if n & (n - 1) == 0 else window - n for n in sizes), sum(sizes)


def test_packing_round_trip(docs):
    rows = packing.pack(docs, public_bpe, with_ids=True).collect()
    pad, total = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], public_bpe()[0])
    assert pad < 0.02 * total and all(len(r.ids) == r.length for r in rows)


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack(odd, public_bpe).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in odd.collect()], public_bpe()[0])
    assert [r.length for r in rows if r.id == 3] == [1]
    assert packing.pack(none, public_bpe).collect() == []


def test_loser_tree_merges():
    r = random.Random(2)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((r.randrange(20), i, j) for j in range(r.randrange(0, 30))) for i in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


def pages_of(spark):
    big = "<p>" + "x" * 300 + "</p>"
    nasty = ["a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + big, big + "\r\n", big + "\r\n\r\n", "\r\n\r\n" + big, big + "\r\n\r\n\r\nWARC/1.1\r\n"]
    rows = [(i, f"http://h{i % 3}.example.com/p?q={i}#f", t) for i, t in enumerate([big, big, None, "", "short", "short", "é" * 99, "日" * 99, *nasty, *nasty])]
    return spark.createDataFrame([(*r, "x", "y") for r in [*rows, (7, None, big), (7, None, big), (None, "u", "n" * 200)]], "page_id long, url string, html string, id string, date string")


def test_archive_round_trip(spark, tmp_path):
    import hashlib

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several runs to merge
    pages = pages_of(spark)
    when = F.timestamp_seconds(F.lit(1_704_067_200) - F.col("page_id"))
    out = warc.archive_round_trip(pages.repartition(5), str(tmp_path / "w"), when)
    got = sorted(map(tuple, out.select("id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, b in rows:
        if i is not None:
            first[b] = min(first.get(b, i), i)
    want = []
    for i, b in rows:
        revisit = len(b) >= 100 and i is not None and first[b] != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first[b] if revisit else None))
    assert got == sorted(want, key=str)
    index = warc.capture_index(warc.read_archives(spark, str(tmp_path / "w"))).orderBy("place").collect()
    order = [(r.url_key, r.date) for r in index]
    assert order == sorted(order) and len({r.file for r in index}) > 1
    assert [r.place for r in index] == list(range(len(rows)))
    cut = warc.capture_index(warc.read_archives(spark, str(tmp_path / "w")), partitions=5).orderBy("place").collect()
    assert [(r.place, r.url_key, r.date, r.id) for r in cut] == [(r.place, r.url_key, r.date, r.id) for r in index]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert order[-1][0].startswith("u)") and any(k.startswith("com,example,h0)/p?q=") for k, _ in order)


def test_archives_of_nothing(spark, tmp_path):
    out = warc.archive_round_trip(pages_of(spark).limit(0), str(tmp_path / "w"), F.timestamp_seconds(F.lit(0)))
    assert out.count() == 0


def test_raking_meets_targets(spark):
    r = random.Random(1)
    cells = spark.createDataFrame([(a, b, r.randrange(50, 100)) for a in "xyz" for b in "pq"], "a string, b string, tokens long")
    total = sum(c.tokens for c in cells.collect())
    out = mixing.rake(cells, {"a": None, "b": {"p": 3.0, "q": 1.0}}, 0.3, 1e-9).collect()
    assert out[0].residual <= 1e-6 and all(0 < c.keep <= c.tokens for c in out)
    for a in "xyz":
        assert sum(c.keep for c in out if c.a == a) == pytest.approx(0.1 * total, rel=1e-6)
    assert sum(c.keep for c in out if c.b == "p") == pytest.approx(0.225 * total, rel=1e-6)
    ratios = {c.b: out_c for c in out for out_c in [c.keep / c.tokens] if c.a == "x"}
    for a in "yz":  # fitted cells keep the odds they had
        own = {c.b: c.keep / c.tokens for c in out if c.a == a}
        assert own["p"] / own["q"] == pytest.approx(ratios["p"] / ratios["q"], rel=1e-5)


def test_raking_within_bounds(spark):
    """A class that has too little is kept whole, what it lacks goes to the others, and no cell is kept more than whole."""
    rows = [("big", "p", 900), ("big", "q", 700), ("mid", "p", 300), ("mid", "q", 50), ("small", "p", 20), ("small", "q", 5)]
    cells = spark.createDataFrame(rows, "a string, b string, tokens long")
    out = mixing.rake(cells, {"a": None, "b": {"p": 1.0, "q": 1.0}}, 0.4, 1e-6).collect()
    assert all(c.keep <= c.tokens for c in out) and out[0].residual < 0.01
    assert sum(c.keep for c in out if c.a == "small") == pytest.approx(25, rel=0.01)
    want = (0.4 * 1975 - 25) / 2
    assert want > 350  # mid is kept whole as well
    assert sum(c.keep for c in out if c.a == "mid") == pytest.approx(350, rel=0.01)
    assert sum(c.keep for c in out) == pytest.approx(0.4 * 1975, rel=0.01)
    alike = mixing.rake(cells, {"a": 1.0}, 0.4).collect()
    assert all(c.keep == pytest.approx(0.4 * c.tokens) for c in alike)


@pytest.mark.parametrize("small", [True, False])
def test_raking_says_where_targets_contradict_each_other(spark, monkeypatch, small):
    """Both of x and p want half of the tokens, but stand in different cells than they would need."""
    monkeypatch.setattr(mixing, "SMALL_CELLS", 10 if small else 0)
    cells = spark.createDataFrame([("x", "p", 100), ("y", "q", 900)], "a string, b string, tokens long")
    out = mixing.rake(cells, {"a": {"x": 1.0, "y": 1.0}, "b": {"p": 1.0, "q": 7.0}}, 0.1).collect()
    assert out[0].residual > 0.1 and all(c.keep <= c.tokens for c in out)


def test_targets_of_very_many_classes(spark):
    """Classes that are kept whole one after another, far more than any number of steps."""
    sizes = [(f"c{i}", 1.03**i) for i in range(300)]
    cells = spark.createDataFrame([(c, int(1000 * s)) for c, s in sizes], "a string, tokens long")
    has = {r.a: r.tokens for r in cells.collect()}
    budget = 0.5 * sum(has.values())
    got = {r.a: r.t_a for r in mixing._class_targets(cells, "a", None, budget).collect()}
    scale = max(got.values())
    assert sum(got.values()) == pytest.approx(budget) and all(got[c] == pytest.approx(min(has[c], scale)) for c in has)
    none = mixing._class_targets(cells, "a", {"c0": 0.0, "other": 0.0}, budget).collect()
    assert all(r.t_a == 0 for r in none)


def test_documents_of_many_cells_are_not_shuffled(spark, monkeypatch):
    """Cells come by broadcast in parts; no exchange holds a text."""
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 100)
    monkeypatch.setattr(mixing, "SMALL_CELLS", 100)
    docs = spark.createDataFrame([(i, f"text {i}", f"s{i % 250}") for i in range(500)], "doc_id long, text string, source string")
    out = mixing.mix(docs, {"source": None}, {"source": F.col("source")})
    assert out.filter("__p IS NULL").count() == 0 and out.count() == 500
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_mixing_of_odd_rows(odd, none):
    lang = F.col("lang")
    assert mixing.topic_words(none, lang) == [] and isinstance(mixing.topic_words(odd, lang), list)
    dims = {"source": F.col("source"), "topic": mixing.topic(F.col("text"), ["delta", "alpha"])}
    targets = {"source": None, "topic": {"delta": 1.0, "other": 0.5}}
    out = mixing.mix(odd, targets, dims).collect()
    assert len(out) == odd.count() and all(0 <= r["__p"] <= 1 and r["__tokens"] >= 1 for r in out)
    assert mixing.mix(none, targets, dims).collect() == []


def test_topics_are_what_a_text_says_most_often(spark):
    rows = [(1, "alpha beta beta gamma"), (2, "Alpha, alpha; beta"), (3, "none of these"), (4, None), (5, "BETA alpha")]
    df = spark.createDataFrame(rows, "id long, text string")
    assert [r.t for r in df.select("id", mixing.topic(F.col("text"), ["alpha", "beta"]).alias("t")).orderBy("id").collect()] == ["beta", "alpha", "other", "other", "alpha"]
    many = spark.createDataFrame([(i, "the " + ("special words here" if i < 3 else "plain")) for i in range(40)], "id long, text string")
    assert mixing.topic_words(many, F.lit("en"), k=5) == ["special", "words"]
    assert mixing.topic_words(many, F.when(F.col("id") == 0, "a"), k=1) == ["special"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    same(QUERIES[name](spark, sf), connection(sf), ORACLES[name])


def test_pipeline_stages_keep_what_they_should(spark, docs, odd):
    sf = "/root/testdata/sf0.001"
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf).cache()
        assert out.columns == docs.columns
        before, after = {r.doc_id: r for r in now.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and after
        if name == "line dedup":
            assert set(after) == set(before) and all(len(r.text) == r.n_chars for r in after.values())
        if name == "near dedup":
            left = near_duplicates(out).filter("NOT kept").count()
            assert left == 0
        now = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in now.collect()}
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, sf).count()
        stage(spark, odd.limit(0), sf).count()


def test_pipeline_equals_brute_force(spark, docs, labels):
    """Every stage of a run against a plain loop, or the mixing's SQL, over what the stage before kept."""
    sf = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    rules = quality_rules.fit_rules(docs, labels)
    now = docs.collect()
    stats = {r.doc_id: r for r in quality_rules.with_counts(docs, "text").select("row.doc_id", *(c.alias(f) for f, c in quality_rules.features().items())).collect()}

    def good(r):
        n, _, _, _, again = plain_counts(r.text or "")
        x = {f: np.array([float(stats[r.doc_id][f])]) for f in quality_rules.RATIOS}
        return n >= 50 and 100 * again <= 50 * n and not any(rule.holds(x)[0] for rule in rules)

    out = stages["quality rules"](spark, docs, sf)
    kept = [r for r in now if good(r)]
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in kept)

    total, pages = {}, {}
    for r in kept:
        total[r.source or ""] = total.get(r.source or "", 0) + 1
        for x in {x.strip(BLANKS) for x in (r.text or "").split("\n")} - {""}:
            pages.setdefault((r.source or "", x), set()).add(r.text)
    bad = {k for k, c in pages.items() if len(c) >= 3 and len(c) > 0.01 * total[k[0]]}
    text = {r.doc_id: "\n".join(x for x in r.text.split("\n") if (r.source or "", x.strip(BLANKS)) not in bad) for r in kept}
    out = stages["line dedup"](spark, out, sf).cache()
    assert {r.doc_id: r.text for r in out.collect()} == text

    firsts = {i for i, _, c in components(list(text.items()), 5, 4, 5) if c == i}
    out = stages["near dedup"](spark, out, sf).cache()
    assert {r.doc_id for r in out.collect()} == firsts

    con = duckdb.connect()
    con.register("documents", out.toArrow())
    want = {r[0] for r in con.execute(ORACLES["op6_mixing"]).fetchall() if r[4]}
    out = stages["mixing"](spark, out, sf).cache()
    assert {r.doc_id for r in out.collect()} == want

    rows = stages["packing"](spark, out, sf).withColumnRenamed("doc_id", "id").collect()
    check_packing(rows, [(r.doc_id, r.text) for r in out.collect()], public_bpe()[0])
