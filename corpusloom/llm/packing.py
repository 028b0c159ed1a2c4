"""Packing of token sequences: first-fit decreasing over a tournament tree of bin capacities.

Each document's ids (with the end id) are cut into pieces of at most ``capacity``, which are dealt at random into groups of bounded expected size. Each group is packed by
first-fit decreasing, where a tournament tree over the bins' free room finds the first bin that fits; then the
group's poorly filled bins are opened, and their pieces, cut where need be, top up the free room of the others,
so that a group leaves one sequence at most that is not full.

Defined cases: a null or empty text is the end id alone; documents of any length are cut, none is left out;
equal lengths pack by (document, start); rows that repeat are packed as often as they stand there; an empty
table gives an empty result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import gc
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import held, materialise, trim, with_names

CAPACITY, END_ID = 2048, 1
#: Expected pieces in a group, and the seed of the dealing.
GROUP_PIECES, SEED = 4096, 9
#: Bytes of encoded pieces, and of words in them, that a worker keeps, about (with ``OVERHEAD`` for the objects of
#: each); beyond them it starts anew. Only the time depends on it.
CACHE_BYTES, OVERHEAD = 128 << 20, 200
ROWS = 1000


#: The published split of word-level BPE vocabularies, and what it works on.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]


class WordEncoder:
    """Ids of texts by the tokenizers library, through a cache of the pieces between spaces, tabs and line ends.

    With the published word split (lower case, white space dropped) each new piece of plain Latin letters is
    split here and its words go to the library's BPE model; any other piece goes through the library whole.
    A tokenizer of another make encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.by_words = kinds == NORMALIZERS and steps[0].get("pattern") == {"Regex": WORDS} and steps[0].get("behavior") == "Removed"
        self.pieces: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}
        self.size = 0
        self.find = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+").findall
        # what the last step before the model makes of each byte
        from tokenizers.pre_tokenizers import ByteLevel

        step = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {ord(c): step.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x21, 0x180)) if not c.isspace()}

    def _learn(self, new: list[str]) -> None:
        """Encodes pieces that no text had before."""
        plain = [p for p in new if PLAIN(p) and "<|" not in p]
        before = len(self.words)
        split = [self.find(p.lower()) for p in plain]
        tokenize, shown = self.tokenizer.model.tokenize, self.shown
        for word in {w for words in split for w in words}.difference(self.words):
            self.words[word] = np.array([t.id for t in tokenize(word if word.isascii() else word.translate(shown))], "<u4").tobytes()
        ids = self.words.__getitem__
        self.pieces.update(zip(plain, [ids(words[0]) if len(words) == 1 else b"".join(map(ids, words)) for words in split], strict=True))
        rest = [p for p in new if p not in self.pieces]
        for at in range(0, len(rest), 5000):
            part = rest[at : at + 5000]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.pieces.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(part, found, strict=True))
        # a character is at most 4 bytes, and so is the number of a token of one character
        self.size += 8 * sum(map(len, new)) + OVERHEAD * (len(new) + len(self.words) - before)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        if not self.by_words:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if self.size > CACHE_BYTES:
            self.pieces, self.words, self.size = {"": b""}, {}, 0
        self._learn(list(set().union(*split).difference(self.pieces)))
        ids = self.pieces.__getitem__
        return [b"".join(map(ids, pieces)) for pieces in split]


#: ASCII without controls and the Latin letters of U+00C0 to U+017F but those that change their length in lower case.
PLAIN = re.compile(r"[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u0148\u014A-\u017F]*").fullmatch


def word_encoder(path: str) -> WordEncoder:
    """One per worker process."""
    return held(f"words of {path}", lambda: WordEncoder(path))


def _pieces(batch: pa.RecordBatch, path: str, capacity: int, end_id: int, keep: bool) -> pa.RecordBatch:
    rows, starts, sizes, sums, totals, parts = [], [], [], [], [], []
    tail = np.array([end_id], "<u4").tobytes()
    for row, data in enumerate(word_encoder(path).encode([t or "" for t in batch.column("text").to_pylist()])):
        data += tail
        n = len(data) // 4
        for start in range(0, n, capacity):
            part = data[4 * start : 4 * (start + capacity)]
            rows.append(row)
            starts.append(start)
            sizes.append(len(part) // 4)
            sums.append(zlib.crc32(part))
            totals.append(n)
            # a remainder may be cut again, so its ids go along; a full piece needs only its sum
            parts.append(part if keep or len(part) < 4 * capacity else None)
    longs = [pa.array(x, pa.int64()) for x in (starts, sizes, sums, totals)]
    return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), *longs, pa.array(parts, pa.binary())], names="id start length crc doc_tokens ids".split())


class Tournament:
    """The free room of bins 0, 1, ... under a tree of maxima; ``first`` finds the first bin with enough room."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.size)

    def first(self, need: int) -> int:
        node, room = 1, self.room
        while node < self.size:
            node *= 2
            if room[node] < need:
                node += 1
        return node - self.size

    def take(self, at: int, need: int) -> None:
        room, node = self.room, at + self.size
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size; sizes come in falling order."""
    tree, out = Tournament(len(sizes), capacity), []
    for size in sizes:
        at = tree.first(size)
        tree.take(at, size)
        out.append(at)
    return out


def plan(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(item, from, length, bin) of every placed part of items in falling order of size, in the order of placing.

    After first-fit decreasing the emptiest bins are opened and their items fill the room of the rest.
    """
    bins = first_fit_decreasing(sizes, capacity)
    used = [0] * (max(bins, default=-1) + 1)
    for size, b in zip(sizes, bins, strict=True):
        used[b] += size
    order = sorted(range(len(used)), key=lambda b: (-used[b], b))
    full = sum(used) // capacity  # as many bins stay as the tokens can fill
    stay = set(order[:full])
    out = [(i, 0, size, b) for i, (size, b) in enumerate(zip(sizes, bins, strict=True)) if b in stay]
    gaps = [(b, capacity - used[b]) for b in order[:full] if used[b] < capacity]
    gaps.reverse()
    last = order[full] if full < len(order) else None
    for i, (size, b) in enumerate(zip(sizes, bins, strict=True)):
        at = 0
        while b not in stay and at < size:
            if gaps:
                to, room = gaps.pop()
                part = min(room, size - at)
                if part < room:
                    gaps.append((to, room - part))
            else:
                to, part = last, size - at
            out.append((i, at, part, to))
            at += part
    return out


def _pack(group: pa.Table, capacity: int) -> pa.Table:
    group = group.take(pc.sort_indices(group, sort_keys=[("length", "descending"), ("id", "ascending"), ("start", "ascending")]))
    placed = plan(group["length"].to_pylist(), capacity)
    item, at, size, bins = (np.array(x, np.int64) for x in zip(*placed, strict=True))
    by = np.argsort(bins, kind="stable")
    item, at, size, bins = item[by], at[by], size[by], bins[by]
    before = np.cumsum(size) - size
    first = np.concatenate([[True], bins[1:] != bins[:-1]])
    start_of_bin = np.maximum.accumulate(np.where(first, before, 0))
    rows = group.take(pa.array(item))
    whole = size == rows["length"].to_numpy()
    ids, crc = rows["ids"].to_pylist(), rows["crc"].to_pylist()
    parts = [None if d is None else d[4 * a : 4 * (a + n)] for d, a, n in zip(ids, at.tolist(), size.tolist(), strict=True)]
    sums = [c if w else zlib.crc32(p) for c, w, p in zip(crc, whole.tolist(), parts, strict=True)]
    sequence = rows["group"].to_numpy() * SEQUENCES_OF_GROUP + np.cumsum(first) - 1
    return pa.table({"id": rows["id"], "start": pa.array(rows["start"].to_numpy() + at), "length": pa.array(size), "crc": pa.array(sums, pa.int64()), "doc_tokens": rows["doc_tokens"], "sequence_id": pa.array(sequence), "offset": pa.array(before - start_of_bin), "ids": pa.array(parts, pa.binary())})


#: Sequence ids that each group has; a group never has more pieces.
SEQUENCES_OF_GROUP = 1 << 24


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, keep: bool = True) -> DataFrame:
    """One row per piece: ``id, start, length, crc, doc_tokens, sequence_id, offset`` and, with ``keep``, ``ids``
    (little-endian unsigned 32-bit numbers).

    Groups are dealt at random, into as many as the number of pieces asks for, so none grows with the table. The
    pieces are written once, so that a task that is run again deals and cuts them alike.
    """
    docs = with_names(docs, id=id_col, text=text_col)
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        gc.disable()  # millions of short-lived lists and no cycles
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    yield _pieces(batch.slice(start, ROWS), tokenizer, capacity, end_id, keep)
        finally:
            gc.enable()
            trim()

    pieces = materialise(docs.mapInArrow(run, f"id {kind}, start long, length long, crc long, doc_tokens long, ids binary"))
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("group", F.floor(F.rand(SEED) * groups))
    return dealt.groupBy("group").applyInArrow(lambda g: _pack(g, capacity), f"id {kind}, start long, length long, crc long, doc_tokens long, sequence_id long, offset long, ids binary")
