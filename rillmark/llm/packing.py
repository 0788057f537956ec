"""Packing token streams into windows by order-preserving dynamic programming with a monotone queue."""

from __future__ import annotations

import base64
import json
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_batches import slices

#: What a cut costs, in padding tokens: between documents (nothing), after a sentence, elsewhere.
SENTENCE_CUT, INNER_CUT = 2, 24
#: What a window of a smaller power of two costs.
SHORT = 48
#: Without a sentence's end for this many tokens, cuts elsewhere are considered, this far apart.
GAP, STEP = 64, 16


@lru_cache(maxsize=2)
def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """(content, id) of the added tokens of a tokenizers .json file; only such that match as they stand are known."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path}: added tokens that do not match as they stand")
    return tuple((t["content"], t["id"]) for t in tokens)


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
    """(encode, ends, opens) of a byte-level BPE vocabulary in a .tiktoken file, and of (content, id) tokens added to it.

    encode: text to uint32 ids, split at the added tokens first; ends[id]: 2 if a line ends in the token, 1 if its last
    character can end a sentence; opens[id]: the token starts with white space.
    """
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(added))
    ranks |= {content.encode(): i for content, i in added}
    n = max(ranks.values()) + 2
    ends, opens = np.zeros(n, np.int8), np.zeros(n, bool)
    for b, i in ranks.items():
        ends[i] = 2 if b"\n" in b else int(b.rstrip(b"\"')]").endswith((b".", b"!", b"?")))
        opens[i] = b[:1].isspace()
    allowed = {content for content, _ in added}
    return (lambda text: np.array(encoding.encode(text, allowed_special=allowed, disallowed_special=()), np.uint32)), ends, opens


def sentence_cuts(ids: np.ndarray, ends: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The positions within ids before which a sentence has ended."""
    e = ends[ids[:-1]]
    return np.flatnonzero((e == 2) | ((e == 1) & opens[ids[1:]])) + 1


def best_cuts(at: np.ndarray, cost: np.ndarray, window: int, all_powers_from: int | None = None) -> list[int]:
    """The cheapest increasing positions of at, from its first to its last, at most window apart.

    A window of length n costs window - n padding, or SHORT where n is a smaller power of two, and cost[k] for its cut.
    The padding falls as the window's start comes nearer, at the same rate for all starts, so a queue of starts with
    rising (best cost + position) gives the best one at its head; each position enters and leaves it once. Powers of
    two are tried besides: the three largest, or all of them from position all_powers_from on.
    """
    pos, pen, n = at.tolist(), cost.tolist(), len(at)
    index = {p: k for k, p in enumerate(pos)}
    powers = [1 << i for i in range(window.bit_length() - 1, -1, -1) if 1 << i < window]
    few, full = powers[:3], all_powers_from if all_powers_from is not None else pos[-1] + 1
    best, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int, int]] = deque([(pos[0], pos[0], 0)])
    for k in range(1, n):
        p = pos[k]
        while queue and queue[0][1] < p - window:
            queue.popleft()
        low, _, i = queue[0]
        b = low + window - p
        for w in powers if p >= full else few:
            j = index.get(p - w)
            if j is not None and best[j] + SHORT < b:
                b, i = best[j] + SHORT, j
        b += pen[k]
        best[k], back[k] = b, i
        key = b + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, k))
    cuts, k = [pos[-1]], n - 1
    while k:
        k = back[k]
        cuts.append(pos[k])
    return cuts[::-1]


class _Packer:
    """The documents of one partition, in order; solves blocks of many windows and keeps the last few for the next."""

    def __init__(self, window: int, ends: np.ndarray, opens: np.ndarray, first_id: int, kind: pa.DataType, with_ids: bool, block: int = 256):
        self.window, self.ends, self.opens, self.kind, self.with_ids = window, ends, opens, kind, with_ids
        self.block, self.sequence = block * window, first_id
        self.docs: list[tuple[object, int, int, np.ndarray]] = []  # id, tokens, start, ids left
        self.size = 0

    def add(self, key: object, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.docs.append((key, len(ids), 0, ids))
        self.size += len(ids)
        if self.size >= self.block:
            yield self.solve(last=False)

    def solve(self, last: bool) -> pa.RecordBatch:
        at, cost, p = [np.zeros(1, np.int64)], [np.zeros(1)], 0
        for _, _, _, ids in self.docs:
            s = sentence_cuts(ids, self.ends, self.opens)
            edges = np.concatenate(([0], s, [len(ids)]))
            wide = np.flatnonzero(np.diff(edges) > GAP)
            inner = [np.arange(edges[i] + STEP, edges[i + 1], STEP) for i in wide]
            here = np.concatenate((s, *inner, [len(ids)]))
            price = np.concatenate((np.full(len(s), SENTENCE_CUT), np.full(len(here) - len(s) - 1, INNER_CUT), [0]))
            order = np.argsort(here, kind="stable")
            at.append(here[order] + p)
            cost.append(price[order])
            p += len(ids)
        at, cost = np.concatenate(at), np.concatenate(cost)
        if last:  # the end may fall anywhere, and lengths of powers of two need no padding
            more = np.setdiff1d(np.arange(max(0, p - self.window), p + 1), at)
            at, cost = np.concatenate((at, more)), np.concatenate((cost, np.full(len(more), INNER_CUT)))
            order = np.argsort(at, kind="stable")
            at, cost = at[order], cost[order]
        cuts = best_cuts(at, cost, self.window, max(0, p - self.window) if last else None)
        if not last:
            settled = [c for c in cuts if c <= p - 4 * self.window]
            cuts = settled if len(settled) > 1 else cuts
        return self.commit(cuts)

    def commit(self, cuts: list[int]) -> pa.RecordBatch:
        """A row for each piece of the windows between cuts; what lies behind the last one stays."""
        keys, starts, lengths, crcs, totals, sequences, offsets, pieces = [], [], [], [], [], [], [], []
        w, p, left = 0, 0, []
        for key, total, start, ids in self.docs:
            done = 0
            while done < len(ids) and w < len(cuts) - 1:
                take = min(len(ids) - done, cuts[w + 1] - p - done)
                piece = ids[done : done + take]
                keys.append(key)
                starts.append(start + done)
                lengths.append(take)
                crcs.append(zlib.crc32(piece.astype("<u4").tobytes()))
                totals.append(total)
                sequences.append(self.sequence + w)
                offsets.append(p + done - cuts[w])
                pieces.append(piece)
                done += take
                w += p + done == cuts[w + 1]
            if done < len(ids):
                left.append((key, total, start + done, ids[done:]))
            p += len(ids)
        self.sequence += len(cuts) - 1
        self.docs, self.size = left, sum(len(x[3]) for x in left)
        columns = [pa.array(keys, self.kind), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals, sequences, offsets))]
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if self.with_ids:
            bounds = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            flat = np.concatenate(pieces).astype(np.int32) if pieces else np.empty(0, np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)


def pack(docs: DataFrame, encoder: Callable[[], tuple], id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), a row for each piece of a document.

    A document's ids are those of its text, then end_id. The documents of a partition are one stream in table order,
    cut into windows of at most window ids. Cuts fall between documents (free), after sentences or, where no sentence
    ends for long, elsewhere; dynamic programming picks those of the least padding plus cut costs, over blocks of 256
    windows whose last four are settled with the next block. Lengths of powers of two count as unpadded, and a
    partition's last window is cut into such lengths where that is cheaper. Partitions are those of docs, so nothing is
    shuffled and each one pads its own end; sequence_id holds the partition in its upper bits. encoder() gives (encode,
    ends, opens) as byte_bpe does and runs on the executors.

    Null and empty texts are end_id alone. Repeated rows are packed each for itself; null ids stay null. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends, opens = encoder()
        packer, end = None, np.array([end_id], np.uint32)
        for batch, texts in slices(batches, 1):
            if packer is None:
                packer = _Packer(window, ends, opens, TaskContext.get().partitionId() << 33, batch.column(0).type, with_ids)
            for key, text in zip(batch.column(0).to_pylist(), texts):
                yield from packer.add(key, np.concatenate((encode(text), end)))
        if packer is not None and packer.docs:
            yield packer.solve(last=True)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = ", ids array<int>" if with_ids else ""
    return rows.mapInArrow(run, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint{ids}")
