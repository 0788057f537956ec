"""Toxicity: a bidirectional GRU with attention pooling over character and word inputs, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample
from .nets import Adam, gru, gru_back, sigmoid
from .text_batches import mix, slices, word_hashes

WINDOW, STRIDE, HIDDEN = 48, 36, 8
#: Character n-grams of these byte lengths, in so many buckets; words in buckets of their own.
GRAMS, BUCKETS, WORD_BUCKETS = (3, 4, 5, 6), 1 << 20, 1 << 20
#: A word's inputs: numbers from counts, a vector learned for the word, the mean of vectors learned for its n-grams.
NUMBERS, VECTOR, VECTORS = 7, 6, 1 << 15
INPUTS = NUMBERS + 2 * VECTOR
#: Windows in a training step, fewer where there would be under 40 steps.
BATCH = 160
#: For so many training documents, one more of words that no language has.
FOREIGN = 12
#: Longer words (text without blanks, say) are cut into parts of so many bytes, a new one every STEP bytes.
PART, STEP = 64, 32
#: Marks a cut end of a part; no byte of UTF-8.
_CUT = b"\xff"
#: The inputs of so many bytes of words are computed at once.
SLICE = 1 << 18
_EDGES = b".,;:!?\"'()[]{}*#$%&|<>-_~`"


def bare_words(text: str) -> list[bytes]:
    """Lower-cased words without punctuation at their ends; words of punctuation alone become empty ones.

    Of a word of more than PART bytes its overlapping parts, the cut ends marked; together they hold all its n-grams.
    """
    out: list[bytes] = []
    for w in text.lower().encode("utf-8", "surrogatepass").split():
        w = w.strip(_EDGES)
        if len(w) <= PART:
            out.append(w)
        else:
            starts = range(0, len(w) - PART + STEP, STEP)
            out += [_CUT * (i > 0) + w[i : i + PART] + _CUT * (i + PART < len(w)) for i in starts]
    return out


def gram_buckets(ws: list[bytes], lengths: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every character n-gram of every word, its edges marked but for cut ends; words in rising order."""
    marked = [(b"" if w[:1] == _CUT else b"\x02") + w.strip(_CUT) + (b"" if w[-1:] == _CUT else b"\x03") for w in ws]
    joined = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(ws)), [len(w) for w in marked])
    buckets, owners = [], []
    for n in lengths:
        if len(joined) < n:
            continue
        h = np.zeros(len(joined) - n + 1, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + joined[i : len(joined) - n + 1 + i]
        inside = owner[: len(h)] == owner[n - 1 :]
        buckets.append((mix(h[inside] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[: len(h)][inside])
    if not buckets:  # words of punctuation alone
        return np.empty(0, np.int64), np.empty(0, np.int64)
    b, o = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return b[order], o[order]


def word_buckets(ws: list[bytes]) -> np.ndarray:
    return (word_hashes(ws) % np.uint64(WORD_BUCKETS)).astype(np.int64)


def association(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """How surely a feature goes with label 1: the log odds of its document counts over their standard error; 0 if unseen."""
    share = n_pos / (n_pos + n_neg)
    a, b = pos + share, neg + 1 - share
    return (np.log(a / b) - np.log(n_pos / n_neg)) / np.sqrt(1 / a + 1 / b)


@dataclass
class Numbers:
    """What the counts of labelled documents say of every bucket, ready to be looked up."""

    gram: np.ndarray  # (BUCKETS,) association of an n-gram with label 1, scaled
    word: np.ndarray  # (WORD_BUCKETS,) the same of a word
    seen: np.ndarray  # (WORD_BUCKETS,) how often a word was seen, scaled

    def of(self, ws: list[bytes], gram: np.ndarray, owner: np.ndarray, wb: np.ndarray) -> np.ndarray:
        """(len(ws), NUMBERS) of words with their buckets."""
        g = self.gram[gram]
        first = np.searchsorted(owner, np.arange(len(ws)))
        has = first < np.append(first[1:], len(owner))  # an empty word has no gram
        top, low, mean = np.zeros(len(ws)), np.zeros(len(ws)), np.zeros(len(ws))
        if has.any():
            at = first[has]
            top[has], low[has] = np.maximum.reduceat(g, at), np.minimum.reduceat(g, at)
            mean[has] = np.add.reduceat(g, at) / np.diff(np.append(at, len(owner)))
        size = np.array([len(w) for w in ws])
        return np.stack([self.word[wb], top, mean, low, self.seen[wb], np.minimum(size / 8, 3), np.ones(len(ws))], axis=1).astype(np.float32)


@dataclass
class Counts:
    """Document counts of grams and words by label."""

    gram: np.ndarray  # (2, BUCKETS)
    word: np.ndarray  # (2, WORD_BUCKETS)
    docs: np.ndarray  # (2,)

    def numbers(self, without: int | None = None) -> Numbers:
        """without: leave a document of that label out of the counts."""
        less = np.zeros(2, np.float32)
        if without is not None:
            less[without] = 1
        n = np.maximum(self.docs - less, 1)

        def z(table: np.ndarray) -> np.ndarray:
            neg, pos = (np.maximum(table[i] - less[i], 0) for i in (0, 1))
            return np.where(pos + neg > 0, np.clip(association(pos, neg, n[1], n[0]), -8, 12) / 4, 0).astype(np.float32)

        seen = np.maximum(self.word[0] + self.word[1] - less.sum(), 0)
        return Numbers(z(self.gram), z(self.word), np.minimum(np.log1p(seen) / 4, 2).astype(np.float32))


class Words:
    """The buckets of distinct words: of each word, of all its n-grams, and of those of the shortest length alone, one word after the other."""

    def __init__(self, ws: list[bytes]):
        self.ws, self.word = ws, word_buckets(ws)
        part = np.cumsum([len(w) for w in ws]) // SLICE
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(ws)]
        parts = [(ws[a:b], a) for a, b in zip(bounds, bounds[1:]) if a < b]

        def grams(lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
            rows = [(*gram_buckets(some, lengths), a) for some, a in parts]
            gram = np.concatenate([g.astype(np.int32) for g, _, _ in rows] or [np.empty(0, np.int32)])
            return gram, np.concatenate([(o + a).astype(np.int32) for _, o, a in rows] or [np.empty(0, np.int32)])

        self.gram, self.owner = grams(GRAMS)
        self.char, owner = grams(GRAMS[:1])
        self.char %= VECTORS
        self.start = np.searchsorted(owner, np.arange(len(ws) + 1))

    def chars_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector's number, place in rows) of the shortest n-grams of some words."""
        n = self.start[rows + 1] - self.start[rows]
        place = np.repeat(np.arange(len(rows)), n)
        return self.char[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[rows], n)], place


def windows(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(positions (n, WINDOW) within all words, -1 behind the end; document of each window); none for an empty document."""
    rows, docs, base = [], [], 0
    span = np.arange(WINDOW)
    for d, n in enumerate(sizes):
        if n:
            starts = np.arange(0, max(n - WINDOW + STRIDE, 1), STRIDE) if n > WINDOW else np.zeros(1, np.int64)
            at = starts[:, None] + span
            rows.append(np.where(at < n, at + base, -1).astype(np.int32))
            docs.append(np.full(len(starts), d))
        base += n
    if not rows:
        return np.empty((0, WINDOW), np.int32), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(docs)


def summed(values: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """(n, d) sums of the rows of values with the same place."""
    return np.stack([np.bincount(place, values[:, j], n) for j in range(values.shape[1])], axis=1).astype(np.float32)


class Network:
    """logit(window) = attention over the states of a forward and a backward GRU, then a linear layer.

    A step's inputs are a word's numbers, its learned vector and the mean of its character n-grams' learned vectors.
    """

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        h, f32 = HIDDEN, np.float32
        self.p = {"w": r.normal(0, 0.3, (INPUTS, 6 * h)).astype(f32), "uf": r.normal(0, 0.3, (h, 3 * h)).astype(f32), "ub": r.normal(0, 0.3, (h, 3 * h)).astype(f32), "v": r.normal(0, 0.3, 2 * h).astype(f32), "o": r.normal(0, 0.3, 2 * h).astype(f32), "b": np.full(1, -1, f32)}
        self.word, self.char = (r.normal(0, 0.05, (VECTORS, VECTOR)).astype(f32) for _ in range(2))
        self.squares = np.full((2, VECTORS, 1), 0.01, f32)

    def inputs(self, words: Words, rows: np.ndarray, numbers: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """(len(rows), INPUTS) of some words; own: 0 where the word's vector is left out."""
        gram, place = words.chars_of(rows)
        chars = summed(self.char[gram], place, len(rows)) / np.maximum(np.bincount(place, minlength=len(rows)), 1)[:, None]
        mine = self.word[words.word[rows] % VECTORS]
        return np.concatenate((numbers, mine if own is None else mine * own[:, None], chars), axis=1).astype(np.float32)

    def learn_vectors(self, words: Words, rows: np.ndarray, own: np.ndarray, d: np.ndarray, rate: float) -> None:
        """A step of AdaGrad on the vectors that some inputs with gradients d (len(rows), 2 * VECTOR) used."""
        gram, place = words.chars_of(rows)
        share = 1 / np.maximum(np.bincount(place, minlength=len(rows)), 1).astype(np.float32)
        for k, (table, at, g) in enumerate(((self.word, words.word[rows] % VECTORS, d[:, :VECTOR] * own[:, None]), (self.char, gram, (d[:, VECTOR:] * share[:, None])[place]))):
            used, place_in = np.unique(at, return_inverse=True)
            total = summed(g, place_in, len(used))
            self.squares[k][used] += (total * total).mean(axis=1, keepdims=True)
            table[used] -= rate * total / np.sqrt(self.squares[k][used])

    def logits(self, projected: np.ndarray, at: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """projected: inputs @ w with a row of zeros behind, which -1 in at (n, WINDOW) points to."""
        h, t = HIDDEN, at.T
        mask = t >= 0
        x = projected[t]
        f, tf = gru(x[:, :, : 3 * h], mask, self.p["uf"], tape is not None)
        b, tb = gru(x[::-1, :, 3 * h :], mask[::-1], self.p["ub"], tape is not None)
        states = np.concatenate((f, b[::-1]), axis=2)
        e = np.where(mask, states @ self.p["v"], -1e9)
        e = np.exp(e - e.max(axis=0))
        a = e / e.sum(axis=0)
        pooled = (a[:, :, None] * states).sum(axis=0)
        if tape is not None:
            tape.update(tf=tf, tb=tb, states=states, a=a, pooled=pooled)
        return pooled @ self.p["o"] + self.p["b"][0]

    def score(self, projected: np.ndarray, at: np.ndarray, batch: int = 2048) -> np.ndarray:
        """Logits of windows over projected inputs, with a row of zeros behind them."""
        return np.concatenate([self.logits(projected, at[i : i + batch]) for i in range(0, len(at), batch)] or [np.empty(0, np.float32)])

    def projected(self, words: Words, rows: np.ndarray, numbers: np.ndarray, some: int = 50_000) -> np.ndarray:
        """The inputs of words, projected a part at a time, and a row of zeros."""
        parts = [self.inputs(words, rows[i : i + some], numbers[i : i + some]) @ self.p["w"] for i in range(0, len(rows), some)]
        return np.concatenate((*parts, np.zeros((1, 6 * HIDDEN), np.float32)))

    def score_documents(self, words: Words, step: np.ndarray, numbers: np.ndarray, at: np.ndarray, batch: int = 2048) -> np.ndarray:
        """Logits of windows at positions that rise, each batch projecting the positions it spans."""
        out = []
        for i in range(0, len(at), batch):
            some = at[i : i + batch]
            low, high = some[some >= 0].min(), some.max() + 1
            out.append(self.logits(self.projected(words, step[low:high], numbers[low:high]), np.where(some >= 0, some - low, -1)))
        return np.concatenate(out or [np.empty(0, np.float32)])

    def train(self, words: Words, step: np.ndarray, numbers: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, adam: Adam, seed: int) -> None:
        """step: the word of every position; numbers: its numbers. A third of the word vectors is left out at random, lest rare words be learned by heart."""
        r, h = np.random.default_rng(seed), HIDDEN
        for _ in range(epochs):
            for i in np.array_split(r.permutation(len(at)), max(1, len(at) // BATCH, min(40, len(at) // 8))):
                used = np.unique(at[i], return_inverse=True)
                rows = used[0]
                shift = int(rows[0] == -1)
                rows, idx = rows[shift:], used[1].reshape(len(i), -1) - shift
                own = (r.random(len(rows)) > 1 / 3).astype(np.float32)
                x = np.concatenate((self.inputs(words, step[rows], numbers[rows], own), np.zeros((1, INPUTS), np.float32)))
                tape: dict = {}
                logit = self.logits(x @ self.p["w"], idx, tape)
                d = ((sigmoid(logit) - y[i]) * weight[i] / len(i)).astype(np.float32)
                states, a, pooled = tape["states"], tape["a"], tape["pooled"]
                dpool = d[:, None] * self.p["o"]
                da = (states * dpool).sum(axis=2)
                de = a * (da - (a * da).sum(axis=0))
                ds = a[:, :, None] * dpool + de[:, :, None] * self.p["v"]
                dxf, duf = gru_back(ds[:, :, :h], tape["tf"], self.p["uf"])
                dxb, dub = gru_back(ds[::-1, :, h:], tape["tb"], self.p["ub"])
                dx = np.concatenate((dxf, dxb[::-1]), axis=2)
                dp = summed(dx.reshape(-1, 6 * h), np.where(idx.T < 0, len(rows), idx.T).ravel(), len(rows) + 1)[:-1]
                self.learn_vectors(words, step[rows], own, dp @ self.p["w"][NUMBERS:].T, 0.05)
                adam.step({"w": x[:-1].T @ dp, "uf": duf, "ub": dub, "v": (states * de[:, :, None]).sum(axis=(0, 1)), "o": pooled.T @ d, "b": d.sum(keepdims=True)})


@dataclass
class ToxicityModel:
    numbers: Numbers | None
    net: Network | None
    scale: tuple[float, float]
    empty: float  # the logit of texts without words

    def scores(self, texts: list[str]) -> np.ndarray:
        """The score of each text: of all its overlapping windows, the highest; the base rate without words."""
        out = np.full(len(texts), self.scale[1], float)
        if self.net:
            index: dict[bytes, int] = {}
            split = [bare_words(t) for t in texts]
            own = np.array([index.setdefault(w, len(index)) for d in split for w in d], np.int64)
            at, docs = windows([len(d) for d in split])
            if len(at):
                at, words = np.where(at >= 0, own[at], -1), Words(list(index))
                projected = self.net.projected(words, np.arange(len(index)), self.numbers.of(words.ws, words.gram, words.owner, words.word))
                top = np.full(len(texts), -np.inf)
                np.maximum.at(top, docs, self.net.score(projected, at))
                has = np.isfinite(top)
                out = np.where(has, self.scale[0] * np.where(has, top, 0) + self.scale[1], self.empty)
            else:
                out[:] = self.empty
        return sigmoid(out)


def foreign_text(r: np.random.Generator, words: int = 60) -> str:
    """Words of letters drawn at random, in half of the texts one word again and again."""
    spell = lambda: "".join(chr(97 + c) for c in r.integers(0, 26, int(r.integers(2, 12))))
    return " ".join([spell()] * words if r.random() < 0.5 else [spell() for _ in range(words)])


def fit(texts: list[str], y: np.ndarray, seed: int = 7) -> ToxicityModel:
    """Counts, then the network on windows: of label 0 any, of label 1 the one that looks most like it.

    Texts of unknown words, which are not counted, join label 0, so that what was never seen is no sign of label 1. The first round takes the window with the strongest associations, the next two the one that the network itself
    scores highest. A training document's own counts are left out of its numbers. Last, highest logits are calibrated.
    """
    pos = float(y.sum())
    empty = float(np.log((pos + 1) / (len(y) + 20)))
    if len(set(y.tolist())) < 2:
        return ToxicityModel(None, None, (0.0, float(np.log((pos + 1) / (len(y) - pos + 20)))), empty)
    r = np.random.default_rng(seed)
    real, y = len(y), np.append(y, np.zeros(len(y) // FOREIGN, y.dtype))
    texts = [*texts, *(foreign_text(r) for _ in range(len(y) - real))]
    index: dict[bytes, int] = {}
    ids = [np.array([index.setdefault(w, len(index)) for w in bare_words(t)], np.int32) for t in texts]
    words = Words(list(index))
    counts = Counts(np.zeros((2, BUCKETS), np.float32), np.zeros((2, WORD_BUCKETS), np.float32), np.bincount(y[:real], minlength=2).astype(float))
    first = np.searchsorted(words.owner, np.arange(len(index) + 1))
    for own, label in zip(ids[:real], y):
        if len(own := np.unique(own)):
            counts.gram[label][np.unique(np.concatenate([words.gram[first[w] : first[w + 1]] for w in own]))] += 1
            counts.word[label][np.unique(words.word[own])] += 1
    step, sizes = np.concatenate(ids), [len(x) for x in ids]
    of_label = np.repeat(y, sizes)
    numbers = np.zeros((len(step), NUMBERS), np.float32)
    for label in (0, 1):  # a word's numbers are the same in all documents of a label
        numbers[of_label == label] = counts.numbers(label).of(words.ws, words.gram, words.owner, words.word)[step[of_label == label]]
    at, doc = windows(sizes)
    label = y[doc]
    net = Network(seed)
    if not len(at):
        return ToxicityModel(None, None, (0.0, empty), empty)  # no words at all
    strength = np.where(at >= 0, np.maximum(numbers[:, 0], 0)[at] + np.maximum(numbers[:, 1], 0)[at], 0).max(axis=1)
    adam = Adam(net.p, 0.015)
    for epochs in (8, 4, 4):
        top = np.zeros(len(at), bool)
        order = np.lexsort((strength, doc))
        top[order[np.append(doc[order][1:] != doc[order][:-1], True)]] = True
        some = (label == 0) & (r.random(len(at)) < min(1, 2 * len(y) / max(1, (label == 0).sum())))
        use = np.flatnonzero(top | some)
        ones = (label[use] == 1).sum()
        weight = np.where(label[use] == 1, np.clip((len(use) - ones) / max(ones, 1) / 2, 1, 8), 1).astype(np.float32)
        net.train(words, step, numbers, at[use], label[use].astype(np.float32), weight, epochs, adam, seed)
        strength = net.score_documents(words, step, numbers, at)
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, doc, strength)
    a, b, has = 1.0, 0.0, np.isfinite(best) & (np.arange(len(y)) < real)
    for _ in range(300):  # logistic calibration by gradient steps
        g = sigmoid(a * best[has] + b) - y[has]
        a, b = max(0.05, a - 0.05 * float((g * best[has]).mean())), b - 0.5 * float(g.mean())
    net.squares = None  # only training needs it
    return ToxicityModel(counts.numbers(), net, (a, b), empty)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 4000) -> ToxicityModel:
    """Fits on at most max_labelled labelled texts, each whole, of ids that are not held out."""
    sample = labelled_sample(labels, id_col, label_col, max_labelled, training_only=True)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").join(F.broadcast(sample), "id")  # bounded by max_labelled
    rows = picked.dropDuplicates(["id"]).orderBy("id").limit(max_labelled).collect()
    return fit([r["text"] for r in rows], np.array([int(r["label"] == 1) for r in rows], np.int64))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score), one row per input row: the calibrated highest score of a text's overlapping windows, 0 to 1.

    Whole texts are scored, by nothing but their words, long ones in parts. Null, empty and wordless texts get a low base score. Null ids
    stay null; repeated rows each get the same score, an empty table gives none. Other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS, WORD_BUCKETS, VECTORS and HIDDEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(texts).astype(float))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")

