"""Fill-in-middle transformation with a sparse index of multibyte characters.

A text is cut into words with the white space before them (white space at its end is a unit of its own). Two cuts, drawn from a hash of the row's id,
give prefix, middle and suffix; a part of the rows is put in the order suffix, prefix, middle (spm) or prefix, suffix,
middle (psm), each piece behind its mark. All cuts are byte positions; what is ASCII needs no table, and the
characters of several bytes are recorded alone, with their positions and excess bytes, so that a binary search
converts between bytes and code points.

Defined cases: a null or empty text, and one that holds a mark itself, stays plain; a null id is hashed as an empty
one; rows that repeat are transformed alike; texts of any length go through whole; an empty table gives an empty
result; columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import map_batches, row_chunks, text_bytes, with_names

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Exceptions:
    """The characters of several bytes of a UTF-8 text: where each begins, and the bytes beyond one up to it."""

    def __init__(self, flat: np.ndarray) -> None:
        self.at = np.flatnonzero(flat >= 0xC0)
        lead = flat[self.at]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))])
        self.at_char = self.at - self.excess[:-1]

    def chars(self, cut: np.ndarray) -> np.ndarray:
        """Code points before each byte position (of a character's first byte, or the end)."""
        return cut - self.excess[np.searchsorted(self.at, cut, side="left")]

    def bytes(self, cut: np.ndarray) -> np.ndarray:
        """The byte position of each code point."""
        return cut + self.excess[np.searchsorted(self.at_char, cut, side="left")]


def unit_ends(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The byte positions at which the units of all rows end, ascending."""
    space = SPACE[flat]
    ends = ~space & np.append(space[1:], True)[: len(space)]
    ends[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True  # the last byte of a row ends a unit
    return np.flatnonzero(ends) + 1


def draws(key: object, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def join(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle


def restore(output: bytes, form: str) -> bytes:
    """The text again; the pieces hold no mark, and no mark can arise where a piece meets one."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE, 1)
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, two = head.removeprefix(first).split(second, 1)
    return one + middle + two if form == "psm" else two + middle + one


def _transform(batch: pa.RecordBatch, seed: int, rate: int, spm: int, unit: str, keep: bool) -> pa.RecordBatch:
    keys = batch.column("id").to_pylist()
    flat, offsets = text_bytes(batch.column("text"))
    cols: list[list] = [[] for _ in range(7)]
    for a, b in row_chunks(offsets):
        part, at = flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        index = Exceptions(part)
        char_at = index.chars(at)
        if unit == "token":
            ends = unit_ends(part, at)
            first = np.searchsorted(ends, at, side="right")
            n = np.diff(first)
        else:
            n = np.diff(char_at)
        four = [draws(key, seed) for key in keys[a:b]]
        two = np.array([sorted((h[0] % (k + 1), h[1] % (k + 1))) for h, k in zip(four, n.tolist(), strict=True)], np.int64).reshape(-1, 2)
        if unit == "token":
            # the cut after k units is the k-th end of the row, after none its begin
            cuts = np.where(two > 0, np.append(ends, 0)[first[:-1, None] + two - 1], at[:-1, None])
        else:
            cuts = index.bytes(char_at[:-1, None] + two)
        chars = np.diff(np.column_stack([char_at[:-1], index.chars(cuts)]), axis=1).tolist()
        data, bounds, cut = part.tobytes(), at.tolist(), cuts.tolist()
        for r, h in enumerate(four):
            text = data[bounds[r] : bounds[r + 1]]
            plain = not text or h[2] % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text
            form = "plain" if plain else "spm" if h[3] % 100 < spm else "psm"
            i, j = cut[r][0] - bounds[r], cut[r][1] - bounds[r]
            out = text if plain else join(form, text[:i], text[i:j], text[j:])
            row = (int(n[r]), form, None if plain else chars[r][0], None if plain else chars[r][1], hashlib.sha256(out).hexdigest(), hashlib.sha256(restore(out, form)).hexdigest(), out.decode() if keep else None)
            for c, v in zip(cols, row, strict=True):
                c.append(v)
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    arrays = [batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))]
    return pa.RecordBatch.from_arrays(arrays, names=["id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, unit: str = "token", keep: bool = True) -> DataFrame:
    """Per row: ``n`` units, ``form``, the pieces' code points, digests and, unless ``keep`` is off, the ``output``.

    ``rate`` of a hundred rows are transformed, ``spm`` of a hundred of these in that order; ``unit``: "token" or
    "char" (cuts fall between code points).
    """
    if unit not in ("token", "char"):
        raise ValueError(f"unit must be token or char, not {unit}")
    docs = with_names(docs, id=id_col, text=text_col)
    schema = f"id {docs.schema['id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output string"
    return map_batches(docs, lambda batch: _transform(batch, seed, rate, spm, unit, keep), schema, rows=1000)
