"""A corpus as token ids of a public byte-level BPE vocabulary, by a lazily determinised finite-state transducer.

Merges are compiled to a trie of token bytes and, per token, the spines of its merge tree. Reading bytes, the transducer
keeps every token that may be under way: pairs (trie node, token before it). Of the tokens that end at a byte exactly one
follows the token before it as the merges would have it; it is the arc's output. A set of pairs is a state of the
deterministic transducer, made when first reached and kept, like its arcs, in tables of bounded size.

When only one pair is left no later byte can change what was read, and the tokens up to there are emitted: lookahead is
bounded by the longest token under way, and by the end of the piece that the vocabulary's pattern cuts from the text.
Arcs over whole pieces are kept in the same way, so that common words cost one lookup.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from handloom.runtime import quoted

#: Fixed value: the pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern for the standard library's faster engine, and the characters on which its classes differ or are not
#: known to agree; texts with one of them take the pattern above.
PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
NOT_PLAIN = r"[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|[^\x00-\u024f\u2010-\u2027\u2030-\u203a\u20ac\ufeff]"
VOCABULARY = "byte_bpe_50k.json"
#: States and pieces that a worker keeps; beyond that the tables start anew.
MAX_STATES, MAX_PIECES = 60_000, 250_000
#: Texts longer than this are cut into pieces one by one, not all at once.
LONG_TEXT = 1 << 20
FLUSH_IDS = 1 << 21
NEVER = 1 << 60


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Transducer:
    """``encode`` gives the ids of one piece."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        letters = _byte_letters()
        as_bytes = {v: bytes(letters[c] for c in k) for k, v in vocabulary.items() if all(c in letters for c in k)}
        self.bytes_of = as_bytes
        self.merge: dict[tuple[int, int], int] = {}
        left, right, self.rank = {}, {}, {}
        for rank, (a, b) in enumerate(merges):
            i, j, k = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.merge[i, j] = k
            self.rank[k] = rank
            left[k], right[k] = i, j
        self.left_spine, self.right_spine = {}, {}
        made = [t for t in as_bytes if len(as_bytes[t]) == 1] + [vocabulary[a + b] for a, b in merges]
        for t in made:  # a token's parts are made before it
            self.left_spine[t] = (*self.left_spine[left[t]], t) if t in left else (t,)
            self.right_spine[t] = (*self.right_spine[right[t]], t) if t in right else (t,)
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for t in made:
            node = 0
            for b in as_bytes[t]:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = t
        self._forget()

    def _forget(self) -> None:
        start = ((0, -1),)
        self.state_of, self.pairs, self.arcs = {start: 0}, [start], [{}]

    def follows(self, a: int, b: int) -> bool:
        """Whether the merges leave the boundary between a and b alone.

        At the boundary the last part of a and the first part of b grow along their spines in order of rank. They fuse if
        they have a merge that comes before either grows; of equal merges the one further left comes first.
        """
        up, down = self.right_spine[a], self.left_spine[b]
        i = j = 0
        while True:
            next_a = self.rank[up[i + 1]] if i + 1 < len(up) else NEVER
            next_b = self.rank[down[j + 1]] if j + 1 < len(down) else NEVER
            fused = self.merge.get((up[i], down[j]))
            if fused is not None:
                r = self.rank[fused]
                if r < next_a and r <= next_b:
                    return False
            if next_a == next_b == NEVER:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def _arc(self, state: int, byte: int) -> tuple[int, int]:
        pairs, out = [], -1
        for node, before in self.pairs[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            if self.children[child]:
                pairs.append((child, before))
            token = self.token_at[child]
            if out < 0 <= token and (before < 0 or self.follows(before, token)):
                out = token
        pairs.append((0, out))
        key = tuple(pairs)
        target = self.state_of.get(key)
        if target is None:
            target = self.state_of[key] = len(self.pairs)
            self.pairs.append(key)
            self.arcs.append({})
        self.arcs[state][byte] = arc = (target, out)
        return arc

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Ids of one piece's bytes, each emitted once no later byte can change it."""
        if len(self.pairs) > MAX_STATES:
            self._forget()
        state, ends = 0, []
        for byte in data:
            state, token = self.arcs[state].get(byte) or self._arc(state, byte)
            ends.append(token)
            if len(self.pairs[state]) == 1:
                yield from self._settled(ends)
                ends = []
                if len(self.pairs) > MAX_STATES:
                    only = self.pairs[state]
                    self._forget()
                    state = self.state_of[only] = len(self.pairs)
                    self.pairs.append(only)
                    self.arcs.append({})
        yield from self._settled(ends)

    def _settled(self, ends: list[int]) -> list[int]:
        out, at = [], len(ends)
        while at > 0:
            out.append(ends[at - 1])
            at -= len(self.bytes_of[ends[at - 1]])
        out.reverse()
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of a stream of ids: an incremental UTF-8 state machine holds bytes back until a character is whole."""
        machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        for i in ids:
            yield machine.decode(self.bytes_of[i])
        yield machine.decode(b"", True)


class _Pieces(dict):
    """Ids of pieces, found by the transducer when first asked for; bounded."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.transducer.stream(piece.encode()))
        if len(piece) <= 64:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.transducer = Transducer(model["vocab"], merges)
        self.pieces = _Pieces(self.transducer)
        self.general, self.plain, self.not_plain = regex.compile(PATTERN), re.compile(PLAIN), re.compile(NOT_PLAIN)

    def split(self, text: str) -> Iterable[str]:
        pattern = self.general if self.not_plain.search(text) else self.plain
        if len(text) > LONG_TEXT:
            return (m.group() for m in pattern.finditer(text))
        return pattern.findall(text)

    def encode(self, text: str) -> Iterable[int]:
        return chain.from_iterable(map(self.pieces.__getitem__, self.split(text)))

    def count(self, text: str) -> int:
        return sum(map(len, map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.transducer.decode(ids))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary; later tasks of the worker find its tables filled."""
    return Encoder(path)


def _per_text(docs: DataFrame, key: str, text: str, schema: str, work) -> DataFrame:
    slim = docs.select(quoted(key).alias("k"), quoted(text).alias("t"))
    field = slim.schema["k"].dataType.simpleString()
    return slim.mapInArrow(work, f"k {field}, {schema}").withColumnRenamed("k", key)


def token_ids(docs: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``(key, ids)`` for every row of ``docs``, without special tokens.

    * empty and null texts: an empty list; a null key: kept; repeated rows: each comes out;
    * special tokens' strings in a text are ordinary text; empty input: no row; further columns are not carried on.
    """
    where = path or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(where)
        for b in batches:
            ids, ends, first = array("i"), [0], 0
            for i, text in enumerate(b.column("t")):
                s = text.as_py()
                if s:
                    ids.extend(enc.encode(s))
                ends.append(len(ids))
                if len(ids) > FLUSH_IDS or i + 1 == b.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))
                    yield pa.RecordBatch.from_arrays([b.column("k").slice(first, i + 1 - first), lists], ["k", "ids"])
                    ids, ends, first = array("i"), [0], i + 1

    return _per_text(docs, key, text, "ids array<int>", work)


def token_counts(docs: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``(key, n_tokens)`` for every row of ``docs``; empty and null texts have none."""
    where = path or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(where)
        for b in batches:
            counts = [enc.count(s) if s else 0 for s in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(counts, pa.int64())], ["k", "n_tokens"])

    return _per_text(docs, key, text, "n_tokens bigint", work)


def texts(encoded: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """``(key, text)`` of lists of ids; null lists give null."""
    where = path or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(where)
        for b in batches:
            out = [None if x is None else enc.decode(x) for x in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(out, pa.string())], ["k", "text"])

    return _per_text(encoded, key, ids, "text string", work)


def decoded_right(docs: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``(key, same)``: whether the ids of each text decode to it again, a null text counting as empty."""
    where = path or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(where)
        for b in batches:
            same = [enc.decode(enc.encode(s or "")) == (s or "") for s in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(same, pa.bool_())], ["k", "same"])

    return _per_text(docs, key, text, "same boolean", work)
