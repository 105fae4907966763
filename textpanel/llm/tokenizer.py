"""Byte-level BPE by a deterministic automaton over tokens.

The automaton reads tokens and accepts exactly the token sequences that BPE produces. It starts with one state and an arc for each
byte. The merges are then applied in order, each as one gadget. For the merge of u and v into w, where an arc u is followed by an
arc v: the state that arcs u lead to is split, and its copy for u loses the arc v (u then v is never seen again); every state with an
arc u gets an arc w, which leads to where v led. A token's arcs all lead to one state, so states are named by tokens.

The states are not written out with their tens of thousands of arcs each. What a gadget changes is kept: which v an u lost, and when
(at which merge). Whether a state has an arc then follows from the order of events: an arc w exists where the arc u existed when w
was made; a state made by a merge has the older arcs that v's state had then. Every answer is kept in a transition table.

Encoding: the bytes of a pre-split word are matched with a table-driven trie of all tokens; from each position, the state of the
prefix's last token says which of the matching tokens may follow. Each prefix has exactly one accepted path, so one pass finds the
path, and its arc labels are the ids. Decoding emits the labels' bytes.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how this family of tokenizers splits text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words whose ids a worker keeps; then it starts anew.
WORDS_KEPT = 400_000


def byte_letters() -> dict[str, int]:
    """The letters that vocabulary files write for bytes: printable Latin-1 stands for itself, the other bytes for U+0100 and on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """tokens: the bytes of each id, where ids of single bytes come first in any order; merges: pairs of ids, in order; the k-th makes
    the id made[k]."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int]], made: list[int]):
        self.tokens = tokens
        n = len(tokens)
        self.left, self.right, self.born = [-1] * n, [-1] * n, [-1] * n
        self.lost: list[dict[int, int]] = [{} for _ in range(n)]
        self.alive = [len(t) == 1 for t in tokens]
        self.table: dict[int, bool] = {}
        for k, ((u, v), w) in enumerate(zip(merges, made, strict=True)):
            if not (self.alive[u] and self.alive[v] and self._arc(u, k - 1, v)):
                continue  # u is never followed by v: the gadget changes nothing
            self.lost[u][v] = k
            self.left[w], self.right[w], self.born[w], self.alive[w] = u, v, k, True
        self.trie: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        nodes = 1
        for t in range(n):
            if self.alive[t]:
                at = 0
                for b in tokens[t]:
                    step = self.trie.get(at << 8 | b)
                    if step is None:
                        step = self.trie[at << 8 | b] = nodes
                        nodes += 1
                    at = step
                self.ends[at] = t
        self.words: dict[str, list[int]] = {}

    def _arc(self, x: int, upto: int, t: int) -> bool:
        """Whether the state of token x, as it was after merge number `upto`, has the arc t."""
        while True:
            gone = self.lost[x].get(t)
            if gone is not None and gone <= upto:
                return False
            if self.born[t] < self.born[x]:  # an older arc, taken over from the state of x's right part
                upto = self.born[x] - 1
                x = self.right[x]
            elif self.born[t] < 0:
                return True
            else:  # a newer arc: it came where its left part was
                upto = self.born[t]
                t = self.left[t]

    def follows(self, x: int, t: int) -> bool:
        """Whether t may follow x."""
        key = x << 20 | t
        known = self.table.get(key)
        if known is None:
            known = self.table[key] = self._arc(x, 1 << 40, t)
        return known

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        trie, ends, table = self.trie, self.ends, self.table
        for j in range(n):
            x = last[j]
            if j and x < 0:
                continue
            at, i = 0, j
            while i < n:
                at = trie.get(at << 8 | word[i], -1)
                if at < 0:
                    break
                i += 1
                t = ends.get(at, -1)
                if t >= 0 and last[i] < 0:
                    if j:
                        ok = table.get(x << 20 | t)
                        if ok is None:
                            ok = self.follows(x, t)
                        if not ok:
                            continue
                    last[i], start[i] = t, j
        if n and last[n] < 0:
            raise ValueError("bytes that the vocabulary lacks")
        ids, i = [], n
        while i:
            ids.append(last[i])
            i = start[i]
        return ids[::-1]

    def encode(self, text: str) -> list[int]:
        """Ids of the text without special tokens: what looks like one is ordinary text. Lone surrogates become U+FFFD."""
        out: list[int] = []
        words = self.words
        for w in regex.findall(PATTERN, text):
            ids = words.get(w)
            if ids is None:
                if len(words) >= WORDS_KEPT:
                    words.clear()
                    self.table.clear()
                ids = self.encode_word(w.encode("utf-8", "replace"))
                if len(w) <= 64:
                    words[w] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join([self.tokens[i] for i in ids]).decode("utf-8", "replace")


def compile_automaton(vocabulary: str) -> Automaton:
    """From the text of a vocabulary file (JSON with model.vocab and model.merges)."""
    model = json.loads(vocabulary)["model"]
    letters = byte_letters()
    tokens = [b""] * (max(model["vocab"].values()) + 1)
    for text, i in model["vocab"].items():
        tokens[i] = bytes(letters[c] for c in text)
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = model["vocab"]
    return Automaton(tokens, [(ids[a], ids[b]) for a, b in pairs], [ids[a + b] for a, b in pairs])


_COMPILED: dict[int, Automaton] = {}


def automaton(vocabulary: str) -> Automaton:
    """Compiled once per process."""
    key = hash(vocabulary)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = compile_automaton(vocabulary)
    return _COMPILED[key]


def shared_vocabulary(df: DataFrame, path: str):
    """The vocabulary file as a broadcast: it is read on the driver only and has a fixed size of some MB."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


#: Characters that are encoded before the ids are passed on: bounds the memory of a batch, whatever its rows hold.
CHUNK_CHARS = 2_000_000


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """Key columns and text, last, to the key columns and ids."""
    a = automaton(vocabulary.value)

    def out(batch: pa.RecordBatch, lo: int, hi: int, offsets: list[int], ids: array) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(ids, dtype=np.int32) if ids else np.empty(0, np.int32)))
        return pa.record_batch([*[c.slice(lo, hi - lo) for c in batch.columns[:-1]], lists], names=[*batch.schema.names[:-1], "ids"])

    for batch in batches:
        lo, chars, offsets, ids = 0, 0, [0], array("i")
        texts = batch.column(batch.num_columns - 1)
        for k in range(batch.num_rows):
            text = texts[k].as_py() or ""
            ids.extend(a.encode(text))
            offsets.append(len(ids))
            chars += len(text)
            if chars >= CHUNK_CHARS:
                yield out(batch, lo, k + 1, offsets, ids)
                lo, chars, offsets, ids = k + 1, 0, [0], array("i")
        if lo < batch.num_rows:
            yield out(batch, lo, batch.num_rows, offsets, ids)


def encode_column(df: DataFrame, keys: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The keys and `ids`, the list of token ids of the text; an empty and a null text give an empty list."""
    shared = shared_vocabulary(df, vocabulary)
    source = df.select(*keys, F.col(text).cast("string"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]] + ["ids array<int>"])
    return source.mapInArrow(lambda it: _encoded(it, shared), schema)


def decode_column(df: DataFrame, keys: list[str], ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The keys and `text`; a null or empty list gives an empty text."""
    shared = shared_vocabulary(df, vocabulary)
    source = df.select(*keys, F.col(ids))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]] + ["text string"])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = pa.array([a.decode(x or []) for x in part.column(part.num_columns - 1).to_pylist()], pa.string())
                yield pa.record_batch([*part.columns[:-1], texts], names=[*part.schema.names[:-1], "text"])

    return source.mapInArrow(decoded, schema)
