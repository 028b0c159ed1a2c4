"""BPE encoding and decoding by a pair occurrence index.

The distinct pre-tokens of a slice of a partition are laid end to end as one linked list of symbols. An index
maps each mergeable pair (by its rank) to all positions where it occurs; the active ranks are applied in
ascending order, each to all its positions at once, and the lists of the pairs that a merge makes are updated.
A rank that a merge makes active is taken in its turn, below the current one or not.

Defined cases: a null text is empty and has no ids; texts are encoded whole; rows that repeat are encoded alike;
an empty table gives an empty result; columns other than the named ones are ignored. Special tokens that stand
in a text become their ids, as the tokenizers library does by default.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import map_batches, with_names

#: The published split of byte-level BPE, with \s as Unicode's White_Space.
SPACE = r"\t-\r\x20\x85\xA0  -     　"
SPLIT = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Bytes of encoded pre-tokens that a worker keeps, about (with ``OVERHEAD`` for the objects of each); beyond them
#: it starts anew. Only the time depends on it.
CACHE_BYTES, OVERHEAD = 160 << 20, 300
#: Rows whose new pieces are encoded together.
ROWS = 1000


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class PairIndexEncoder:
    """A byte-level BPE vocabulary, and the encoder of distinct pre-tokens."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_characters()
        self.byte_ids = np.array([vocab[c] for c in chars], np.int32)
        back = {c: b for b, c in enumerate(chars)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = {i: bytes(back[c] for c in token) for token, i in vocab.items() if token not in self.special}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.token_text = {i: str(i) for i in self.token_bytes}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        self.left, self.right, self.made = left, right, made.astype(np.int32)
        key = left << 32 | right
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self.byte_ranks = self.ranks(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)
        self.split = regex.compile(SPLIT)
        self.special_split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where the pair does not merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.order[at], -1)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (bytes of a pre-token), by the pair occurrence index over all of them."""
        if not words:
            return []
        raw = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        # a separator (-1) stands before each word and after the last one
        where = np.arange(len(raw)) + np.repeat(np.arange(1, len(words) + 1), sizes)
        symbols = np.full(len(raw) + len(words) + 1, -1, np.int32)
        symbols[where] = self.byte_ids[raw]
        after, before = np.arange(1, len(symbols) + 1, dtype=np.int32), np.arange(-1, len(symbols) - 1, dtype=np.int32)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(ranks: np.ndarray, positions: np.ndarray) -> None:
            by = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[by], positions[by]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(ranks)]
            for k, rank in enumerate(ranks[bounds[:-1]].tolist()):
                part = positions[bounds[k] : bounds[k + 1]]
                held = index.get(rank)
                if held is None:
                    index[rank] = [part]
                    heapq.heappush(active, rank)
                else:
                    held.append(part)

        first = np.full(len(symbols) - 1, -1, np.int32)
        joined = np.flatnonzero(where[1:] == where[:-1] + 1)
        first[where[joined]] = self.byte_ranks[raw[joined], raw[joined + 1]]
        at = np.flatnonzero(first >= 0)
        if len(at):
            add(first[at], at.astype(np.int32))
        while active:
            rank = heapq.heappop(active)
            held = index.pop(rank)
            at = np.sort(np.concatenate(held)) if len(held) > 1 else np.sort(held[0])
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            a, b, new = self.left[rank], self.right[rank], self.made[rank]
            at = at[(symbols[at] == a) & (symbols[after[at]] == b)]
            if a == b and len(at) > 1:  # of overlapping occurrences every other one merges, from the left
                follows = np.concatenate([[False], after[at[:-1]] == at[1:]])
                start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            rest = after[gone]
            symbols[at], symbols[gone] = new, -2
            after[at], before[rest] = rest, at
            prior = before[at]
            left, right = self.ranks(symbols[prior], symbols[at]), self.ranks(symbols[at], symbols[rest])
            ranks, positions = np.concatenate([left, right]), np.concatenate([prior, at])
            live = ranks >= 0
            if live.any():
                add(ranks[live], positions[live])
        kept = np.flatnonzero(symbols >= 0)
        ids = symbols[kept].tolist()
        # separators before the end of word i: i + 1 of them stand before it
        counts = np.searchsorted(kept, ends + np.arange(1, len(words) + 1)).tolist()
        out, at = [], 0
        for end in counts:
            out.append(ids[at:end])
            at = end
        return out


class WordCache:
    """Ids and bytes of the pre-tokens met so far; beyond ``limit`` bytes of them it starts anew."""

    def __init__(self, enc: PairIndexEncoder, limit: int = CACHE_BYTES):
        self.enc, self.limit, self.size = enc, limit, 0
        self.ids: dict[str, str] = {}
        self.data: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """Ids (joined by commas) and the bytes that they decode to, of each text without special tokens."""
        split = list(map(self.enc.split.findall, texts))
        if self.size > self.limit:
            self.ids.clear()
            self.data.clear()
            self.size = 0
        new = list(set().union(*split).difference(self.ids))
        found = self.enc.encode_words([w.encode() for w in new])
        text, data = self.enc.token_text.__getitem__, self.enc.token_bytes.__getitem__
        joined = [",".join(map(text, ids)) for ids in found]
        # of a pre-token: itself, its bytes and the digits of its ids
        self.size += sum(map(len, new)) * 2 + sum(map(len, joined)) + OVERHEAD * len(new)
        self.ids.update(zip(new, joined, strict=True))
        self.data.update(zip(new, [b"".join(map(data, ids)) for ids in found], strict=True))
        ids, data = self.ids.__getitem__, self.data.__getitem__
        return [(",".join(map(ids, words)), b"".join(map(data, words))) for words in split]


@lru_cache(maxsize=1)
def word_cache(path: str) -> WordCache:
    """One per worker process, which later tasks find filled; each executor reads the vocabulary where it has it."""
    return WordCache(PairIndexEncoder(path))


def encode_texts(cache: WordCache, texts: list[str]) -> list[tuple[str, bytes]]:
    """As ``WordCache.encode``, with the special tokens that stand in a text as their ids."""
    special = cache.enc.special_split
    parts = [special.split(t) if special and any(s in t for s in cache.enc.special) else [t] for t in texts]
    found = iter(cache.encode([p for ps in parts for p in ps[::2]]))
    out = []
    for ps in parts:
        done = [next(found) if k % 2 == 0 else (str(cache.enc.special[p]), p.encode()) for k, p in enumerate(ps)]
        out.append(done[0] if len(done) == 1 else (",".join(d[0] for d in done if d[0]), b"".join(d[1] for d in done)))
    return out


def _run(cache: WordCache, batch: pa.RecordBatch, keep: bool) -> pa.RecordBatch:
    n, ids_sha, decoded_sha, ids_out, decoded_out = [], [], [], [], []
    for ids, data in encode_texts(cache, [t or "" for t in batch.column("text").to_pylist()]):
        n.append(ids.count(",") + 1 if ids else 0)
        ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
        decoded = data.decode("utf-8", "replace")
        decoded_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
        ids_out.append([int(i) for i in ids.split(",")] if keep and ids else [] if keep else None)
        decoded_out.append(decoded if keep else None)
    arrays = [batch.column("id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string()), pa.array(ids_out, pa.list_(pa.int32())), pa.array(decoded_out, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names="id n_tokens ids_sha256 decoded_sha256 ids decoded".split())


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Per row: number of tokens and digests of the ids and of the decoded text; with ``keep`` also the ids and the text.

    ``vocabulary``: path of a byte-level BPE file of the tokenizers library, the same on every executor.
    """
    docs = with_names(docs, id=id_col, text=text_col)
    schema = f"id {docs.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"

    def run(batches):
        cache = word_cache(vocabulary)
        gc.disable()  # millions of short-lived lists and no cycles
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    yield _run(cache, batch.slice(start, ROWS), keep)
        finally:
            gc.enable()

    return docs.mapInArrow(run, schema)
