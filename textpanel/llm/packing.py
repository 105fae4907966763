"""Windows of fixed capacity, filled with documents that resemble each other.

Documents are dealt to shards of about `shard_docs` documents by a hash of their id, so no source or group of copies can overload one, and
a shard's content doesn't depend on the number of partitions or tasks. Each shard gets a BM25 inverted index over its documents' words.
Then windows are filled one by one: the longest unused document is the seed, all its words are the query; its unused neighbours that still
fit join it, best score first, until what is left of the window is less than `tail` of it; the tail goes to the longest unused documents
that fit, so that little room is lost. A task holds one shard: at most `shard_docs` times the window's words.

Only a document that is longer than a window is split: into full windows and a last piece, which is packed like a document, by its own
words.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizer

WORD = re.compile(r"\w+")
#: BM25.
K1, B = 1.2, 0.75
#: How a document came into its window.
SPLIT, SEED, NEIGHBOUR, FIT = "split", "seed", "neighbour", "fit"


def _measured(batches: Iterator[pa.RecordBatch], vocabulary, capacity: int) -> Iterator[pa.RecordBatch]:
    """(id, shard, text) to (id, shard, n_tokens, word hashes, their counts): words of the text, or of the last piece of a longer one."""
    a = tokenizer.automaton(vocabulary.value)
    hashes: dict[str, int] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            n, terms, times = [], [], []
            for text in part.column(2).to_pylist():
                text = text or ""
                ids = a.encode(text)
                n.append(len(ids))
                if len(ids) > capacity:
                    text = a.decode(ids[len(ids) - len(ids) % capacity :])
                if len(hashes) > 500_000:
                    hashes.clear()
                found: Counter[int] = Counter()
                for w, k in Counter(WORD.findall(text.lower())).items():
                    h = hashes.get(w)
                    if h is None:
                        h = hashes[w] = crc32(w.encode("utf-8", "replace")) - (1 << 31)
                    found[h] += k
                terms.append(list(found))
                times.append(list(found.values()))
            yield pa.record_batch([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], names=["id", "shard", "n_tokens", "terms", "times"])


class Shard:
    """Items of one shard with their BM25 index. An item: (id, piece, pieces, offset, size, terms, times)."""

    def __init__(self, items: list[tuple], capacity: int):
        self.items, self.capacity = items, capacity
        n = len(items)
        self.size = np.array([x[4] for x in items], dtype=np.int64)
        lengths = np.array([len(x[5]) for x in items], dtype=np.int64)
        doc = np.repeat(np.arange(n), lengths)
        term = np.concatenate([x[5] for x in items]) if n else np.empty(0, np.int32)
        times = (np.concatenate([x[6] for x in items]) if n else np.empty(0, np.int16)).astype(np.float32)
        order = np.argsort(term, kind="stable")
        self.doc = doc[order].astype(np.int32)
        sorted_terms = term[order]
        self.terms, first = np.unique(sorted_terms, return_index=True)
        self.first = np.append(first, len(sorted_terms))
        df = np.diff(self.first)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        dl = np.bincount(doc, weights=times, minlength=n) if n else np.empty(0)
        norm = (K1 * (1 - B + B * dl / max(dl.mean() if n else 0, 1e-9))).astype(np.float32)
        tf = times[order]
        self.weight = np.repeat(self.idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])

    def scores(self, item: int) -> np.ndarray:
        """BM25 of every item for the query made of the item's words."""
        at = np.searchsorted(self.terms, self.items[item][5])
        if not len(at):
            return np.zeros(len(self.items))
        spans = [slice(self.first[k], self.first[k + 1]) for k in at]
        return np.bincount(np.concatenate([self.doc[s] for s in spans]), weights=np.concatenate([self.weight[s] for s in spans]), minlength=len(self.items))

    def windows(self, tail: float) -> Iterator[list[tuple[int, str]]]:
        """Windows of (item, how it came there), each item once."""
        free = np.ones(len(self.items), dtype=bool)
        by_size = sorted((int(s), -i) for i, s in enumerate(self.size))  # unused items; of equal sizes the first comes last
        while by_size:
            size, i = by_size.pop()
            free[-i] = False
            window, room = [(-i, SEED)], self.capacity - size
            if by_size and by_size[0][0] <= room and room > tail * self.capacity:
                score = self.scores(-i)
                near = np.flatnonzero(free & (self.size <= room) & (score > 0))
                near = near[np.argsort(-score[near], kind="stable")]
                while len(near) and room > tail * self.capacity:
                    x = int(near[0])
                    self._take(by_size, free, x)
                    window.append((x, NEIGHBOUR))
                    room -= int(self.size[x])
                    near = near[1:][self.size[near[1:]] <= room]
            while by_size and by_size[0][0] <= room:
                s, i = by_size[bisect_right(by_size, (room, 1)) - 1]
                self._take(by_size, free, -i)
                window.append((-i, FIT))
                room -= s
            yield window

    def _take(self, by_size: list[tuple[int, int]], free: np.ndarray, x: int) -> None:
        del by_size[bisect_right(by_size, (int(self.size[x]), -x)) - 1]
        free[x] = False


def _packed(batches: Iterator[pa.RecordBatch], capacity: int, tail: float) -> Iterator[pa.RecordBatch]:
    """Rows in order of shards, as _measured gives them, to windows."""
    kind = pa.int64()
    waiting: list[tuple] = []
    rows: list[tuple] = []
    current, number = None, 0

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        rows.clear()
        types = (pa.int64(), kind, pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string())
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["window_id", "id", "piece", "pieces", "from_token", "n_tokens", "window_tokens", "how"])

    def put(window: list[tuple[tuple, str]]) -> None:
        nonlocal number
        total = sum(x[4] for x, _ in window)
        rows.extend(((current << 32) + number, x[0], x[1], x[2], x[3], x[4], total, how) for x, how in window)
        number += 1

    def pack() -> Iterator[pa.RecordBatch]:
        shard = Shard(waiting, capacity)
        for window in shard.windows(tail):
            put([(shard.items[i], how) for i, how in window])
            if len(rows) >= 10_000:
                yield out()
        waiting.clear()

    for batch in batches:
        kind = batch.schema.field(0).type
        ids, shards, n_tokens = (batch.column(i).to_pylist() for i in range(3))
        for k, n in enumerate(n_tokens):
            if shards[k] != current:
                yield from pack()
                current, number = shards[k], 0
            if n == 0:
                rows.append((None, ids[k], 0, 1, 0, 0, None, None))
                continue
            pieces = -(-n // capacity)
            for piece in range(n // capacity):
                put([((ids[k], piece, pieces, piece * capacity, capacity), SPLIT if pieces > 1 else SEED)])
            if n % capacity:
                terms = batch.column(3)[k].values.to_numpy(zero_copy_only=False)
                times = batch.column(4)[k].values.to_numpy(zero_copy_only=False)
                waiting.append((ids[k], pieces - 1, pieces, n - n % capacity, n % capacity, terms.copy(), times.copy()))
            if len(rows) >= 10_000:
                yield out()
    yield from pack()
    if rows:
        yield out()


def pack_windows(docs: DataFrame, id: str, text: str, capacity: int = 2048, vocabulary: str = tokenizer.VOCABULARY, shard_docs: int = 4_000, tail: float = 0.1) -> DataFrame:
    """(window_id, <id>, piece, pieces, from_token, n_tokens, window_tokens, how): where every token of every document lies. how: split (a full
    piece), seed, neighbour (found by the index) or fit (filled the rest).

    A document with no tokens (null or empty text) has one row with null window_id, window_tokens and how, and takes no room. ids should be
    unique; repeated rows are packed as often as they occur. The windows are the same however the rows are partitioned, as long as ids
    are unique. The number of documents, from the files' footers, gives the number of shards.
    """
    shared = tokenizer.shared_vocabulary(docs, vocabulary)
    shards = max(1, -(-docs.count() // shard_docs))
    source = docs.select(F.col(id).alias("id"), F.pmod(F.xxhash64(F.col(id)), F.lit(shards)).cast("int").alias("shard"), F.col(text).cast("string"))
    kind = source.schema[0].dataType.simpleString()
    measured = source.mapInArrow(lambda it: _measured(it, shared, capacity), f"id {kind}, shard int, n_tokens bigint, terms array<int>, times array<int>")
    dealt = measured.repartition("shard").sortWithinPartitions("shard", "id", "n_tokens")
    packed = dealt.mapInArrow(lambda it: _packed(it, capacity, tail), f"window_id bigint, id {kind}, piece int, pieces int, from_token bigint, n_tokens int, window_tokens int, how string")
    return packed.withColumnRenamed("id", id)
