"""Quality rules: decision lists learned by sequential covering, emitted as Spark conditional expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, labelled_sample, refuse, whole
from .text_batches import window_hashes, word_hashes, words

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits", "n_bangs"]
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


#: What rules may test: each feature is one count over another.
RATIOS = {
    "symbols_a_word": ("n_symbols", "n_words"),
    "bangs_a_word": ("n_bangs", "n_words"),
    "upper_share": ("n_upper", "n_chars"),
    "digit_share": ("n_digits", "n_chars"),
    "mean_word": ("word_chars", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "words_a_line": ("n_words", "n_lines"),
}


def features(prefix: str = "") -> dict[str, Column]:
    """The features as expressions over the counts of with_counts, or over columns named like them behind a prefix."""
    return {f: F.col(prefix + a) / F.greatest(F.col(prefix + b), F.lit(1)) for f, (a, b) in RATIOS.items()}


def text_counts(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS."""
    ws = words(text)
    raw = text.encode("utf-8", "surrogatepass")
    repeat = 0
    if len(ws) > 3:
        _, at, times = np.unique(window_hashes(word_hashes(ws), 3), return_inverse=True, return_counts=True)
        again = times[at] > 1
        covered = np.zeros(len(ws), bool)
        for i in range(3):
            covered[i : i + len(again)] |= again
        repeat = int(covered.sum())
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(ws),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat,
        len(text),
        len(lines),
        len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, _DIGITS)),
        text.count("!"),
    )


def with_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(row, n_words, ...): every row as a struct, and its counts by the names of COUNTS.

    Only the text goes to Python and only counts come back; all other columns stay where they are.
    """

    @F.arrow_udf(", ".join(f"{c} bigint" for c in COUNTS).join(("struct<", ">")).replace(" bigint", ":bigint"))
    def count(texts: pa.Array) -> pa.Array:
        counts = np.array([text_counts(t.as_py() or "") for t in texts], np.int64).reshape(-1, len(COUNTS))
        return pa.StructArray.from_arrays([pa.array(c) for c in counts.T], names=COUNTS)

    return docs.select(whole(docs).alias("row"), count(F.col(text_col)).alias("counts")).select("row", "counts.*")


@dataclass(frozen=True)
class Rule:
    """Rejects where all tests (feature, "<=" or ">", threshold) hold."""

    tests: tuple[tuple[str, str, float], ...]

    def column(self, columns: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a & b, (columns[f] <= v if op == "<=" else columns[f] > v for f, op, v in self.tests))

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return reduce(np.logical_and, (x[f] <= v if op == "<=" else x[f] > v for f, op, v in self.tests))

    def __str__(self) -> str:
        return " AND ".join(f"{f} {op} {v:.6g}" for f, op, v in self.tests)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_tests: int) -> list[tuple[str, str, float]]:
    """Adds the test of most gain (FOIL's: bad rows kept times bits of purity won) until no good row is left."""
    tests, live = [], np.ones(len(bad), bool)
    while len(tests) < max_tests and (~bad[live]).any():
        p0, n0 = bad[live].sum(), (~bad[live]).sum()
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for f, v in x.items():
            v = v[live]
            order = np.argsort(v, kind="stable")
            s, y = v[order], bad[live][order]
            cut = np.flatnonzero(s[1:] > s[:-1])
            if not len(cut):
                continue
            p, n = np.cumsum(y)[cut], np.cumsum(~y)[cut]
            for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                gain = pp * (np.log2(np.maximum(pp, 1e-9) / np.maximum(pp + nn, 1e-9)) - base)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], (f, op, float((s[cut[i]] + s[cut[i] + 1]) / 2)))
        if best[1] is None:
            break
        tests.append(best[1])
        live &= Rule((best[1],)).holds(x)
    return tests


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_tests: int = 4, min_bad: int = 4, purity: float = 0.95) -> list[Rule]:
    """An ordered list of rejecting rules.

    Sequential covering: two thirds of the rows left grow a rule, the last third prunes it (the tests from the end go
    while that does not lower (p - n) / (p + n) there); a rule stays if at least min_bad rows and a share of purity of
    all rows it holds for are bad. Then the rows it covers go, until no rule qualifies.
    """
    rules, live = [], np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 2
    while len(rules) < max_rules and bad[live].sum() >= min_bad and (~bad[live]).any():
        grow, prune = live & ~third, live & third
        tests = _grow({f: v[grow] for f, v in x.items()}, bad[grow], max_tests) if bad[grow].any() else []
        if not tests:
            break

        def worth(k: int) -> float:
            held = Rule(tuple(tests[:k])).holds(x) & prune
            p, n = (held & bad).sum(), (held & ~bad).sum()
            return (p - n) / max(p + n, 1)

        keep = max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))
        options = [Rule(tuple(tests[:k])) for k in (keep, len(tests))]
        good = None
        for r in options:
            held = r.holds(x) & live
            if (held & bad).sum() >= min_bad and (held & bad).sum() >= purity * held.sum():
                good = r
                break
        if not good:
            break
        rules.append(good)
        live &= ~good.holds(x)
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000) -> list[Rule]:
    """Learns from at most max_labelled labelled ids (label 0 is bad); no rule without both kinds of labels."""
    sample = labelled_sample(labels, id_col, label_col, max_labelled, training_only=False)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")  # bounded by max_labelled
    rows = with_counts(picked, "text").select("row.id", "row.label", *(c.alias(f) for f, c in features().items())).dropDuplicates(["id"]).orderBy("id").limit(max_labelled).collect()
    x = {f: np.array([r[f] for r in rows], float) for f in RATIOS}
    return learn(x, np.array([r["label"] == 0 for r in rows], bool))


def quality_verdicts(docs: DataFrame, rules: list[Rule], text_col: str = "text", min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """docs with the counts (__c_<count>), __base_failed, __rule (the number of the first rule that rejects) and __kept.

    Base: fewer than min_words words, or over max_repeat percent of the words in 3-word windows found twice or more.
    Past it, the rules are one ordered CASE expression; a text that no rule names is kept. Null and empty texts have
    no words and fail the base. Null ids and repeated rows each get their text's verdict, an empty table gives none.
    All columns pass through, whatever their names; only columns named like the new ones are refused.
    """
    refuse(docs, *(f"__c_{c}" for c in COUNTS), "__base_failed", "__rule", "__kept")
    n, r = F.col("n_words"), F.col("n_repeat_words")
    out = with_counts(docs, text_col).withColumn("base_failed", (n < min_words) | (100 * r > max_repeat * n))
    columns = features()
    case = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        case = F.when(rule.column(columns), F.lit(i)).otherwise(case)
    out = out.withColumn("rule", case)
    kept = ~F.col("base_failed") & F.col("rule").isNull()
    return out.select("row.*", *(F.col(c).alias(f"__c_{c}") for c in COUNTS), F.col("base_failed").alias("__base_failed"), F.col("rule").alias("__rule"), kept.alias("__kept"))
