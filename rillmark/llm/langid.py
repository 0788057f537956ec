"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample
from .nets import Adam, sigmoid
from .text_batches import slices

GRAMS, BUCKETS = (2, 3, 4), 4096
UNDECIDED = "und"


def profile(text: str) -> np.ndarray:
    """The hashed byte n-grams of a lower-cased text, as square roots of their shares."""
    raw = np.frombuffer(b" " + " ".join(text.lower().split()).encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    for n in GRAMS:
        if len(raw) >= n:
            h = np.full(len(raw) - n + 1, n, np.uint32)
            for i in range(n):
                h = (h * np.uint32(0x01000193)) ^ raw[i : len(raw) - n + 1 + i]
            h *= np.uint32(0x9E3779B1)
            counts += np.bincount(h >> np.uint32(20), minlength=BUCKETS)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """(k, bits) of -1 and 1: all distinct splits of up to 7 classes, beyond that random ones that lie far apart."""
    if k < 2:
        return np.ones((k, 0), np.int8)
    if k <= 7:
        bits = np.arange(1, 2 ** (k - 1))
        rest = (bits[None, :] >> np.arange(k - 1)[:, None]) & 1
        return np.concatenate((np.zeros((1, len(bits)), int), rest)).astype(np.int8) * 2 - 1
    r, bits, best = np.random.default_rng(seed), int(15 * np.ceil(np.log2(k))), None
    for _ in range(50):
        code = r.integers(0, 2, (k, bits)) * 2 - 1
        far = min(int((code[i] != code[j]).sum()) for i in range(k) for j in range(i))
        if best is None or far > best[0]:
            best = (far, code)
    return best[1].astype(np.int8)


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray
    w: np.ndarray
    b: np.ndarray
    trust: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(texts, languages): loss-weighted decoding of the predicted bits against every codeword."""
        margin = x @ self.w + self.b
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None, :, :]) @ self.trust
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return p / p.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], seed: int = 7, epochs: int = 12) -> LanguageModel:
    """A logistic classifier for each bit, on whole texts and on excerpts, so that short texts are learned too.

    A bit's trust in decoding is its accuracy on the training rows, less chance.
    """
    names = sorted(set(langs))
    code = codewords(len(names), seed)
    r = np.random.default_rng(seed)
    rows, y = [], []
    for t, lang in zip(texts, langs):
        rows.append(profile(t))
        size = int(2 ** r.uniform(4, 8.5))
        at = int(r.integers(0, max(1, len(t) - size)))
        rows.append(profile(t[at : at + size]))
        y += [names.index(lang)] * 2
    bits = code.shape[1]
    model = LanguageModel(names, code, np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32), np.ones(bits, np.float32) / max(bits, 1))
    if not bits or not rows:
        return model
    x, target = np.stack(rows), (code[y] > 0).astype(np.float32)
    balance = (len(y) / np.bincount(y, minlength=len(names)) / len(names))[y].astype(np.float32)[:, None]
    adam = Adam({"w": model.w, "b": model.b}, 0.05)
    for _ in range(epochs):
        for i in np.array_split(r.permutation(len(x)), max(1, len(x) // 64)):
            d = (sigmoid(x[i] @ model.w + model.b) - target[i]) * balance[i] / len(i)
            adam.step({"w": x[i].T @ d, "b": d.sum(axis=0)})
    right = ((x @ model.w + model.b > 0) == (target > 0)).mean(axis=0)
    model.trust = np.maximum(2 * right - 1, 0.01).astype(np.float32)
    model.trust /= model.trust.sum() / max(1.0, bits / 2)
    return model


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_labelled: int = 2000) -> LanguageModel:
    """Fits on at most max_labelled texts with a language, each whole, of ids that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text <> ''")
    sample = labelled_sample(docs, id_col, lang_col, max_labelled, training_only=True)
    got = rows.join(F.broadcast(sample), "id").dropDuplicates(["id"]).orderBy("id").limit(max_labelled).collect()  # bounded by max_labelled
    return fit([r["text"] for r in got], [str(r["label"]) for r in got])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", doubt: float = 0.2) -> DataFrame:
    """(id, lang_pred, score, ambiguous), one row per input row; the whole text alone decides.

    lang_pred is the language whose codeword the predicted bits lose least against, score its share of the exponential
    losses; ambiguous where the next language's share is within doubt of it. Null texts and texts without a letter are
    "und" with a score of 0 and ambiguous. A model of one language always says that one. Null ids stay null, repeated
    rows each get the same answer, an empty table gives none, other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS times the number of bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, texts in slices(batches, 1):
            known = np.array([bool(m.langs) and any(map(str.isalpha, t)) for t in texts])
            names, score, unsure = np.full(len(texts), UNDECIDED, object), np.zeros(len(texts)), np.ones(len(texts), bool)
            if known.any():
                p = m.probabilities(np.stack([profile(t) for t, k in zip(texts, known) if k]))
                ranked = np.sort(p, axis=1)
                names[known] = np.array(m.langs, object)[p.argmax(axis=1)]
                score[known] = ranked[:, -1]
                unsure[known] = ranked[:, -1] - ranked[:, -2] < doubt if p.shape[1] > 1 else False
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(unsure)], names=["id", "lang_pred", "score", "ambiguous"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, ambiguous boolean")
