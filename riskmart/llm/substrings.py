"""Exact substring deduplication: removes every word that lies in a window of `size` words which starts anywhere else too.

Each window has a Rabin-Karp hash: polynomials modulo the prime 2^61 - 1 in two bases, over two halves of a 128-bit BLAKE2 digest of each word, so 122 bits. Two
different windows have equal ones with a probability under 2^-110, for whatever words they hold; n windows, in about n^2 / 2^111 pairs. Equal windows count
in Spark, in two steps that give the same as counting all windows at once:

1. A window's anchor is the least hash of its runs of size / 3 words (the first of equal ones), taken where it stands. Equal windows have equal anchors at different
   places, so a window whose anchor stands in one place only occurs once. About one word in thirteen is an anchor; their hashes are counted.
2. Windows with a repeated anchor are counted by their own hashes. Those that occur again are merged into maximal intervals, which are cut out.

Documents are dealt by row into chunks of a few MB, in one shuffle that all steps read; a chunk sends each hash once, with its number of places, and gets back
those that repeat. So a window that is everywhere is a row for each chunk, rows are linear in the text at any size, and equal rows are no group. The deal
needs a df that gives the same rows in the same order when it is read again, as files and written tables do; pass stable=False for others, and it is written first.

Null text has no words. Repeated rows repeat each other's windows. Texts shorter than a window are kept as they are. A text is never cut: one text needs about 60 times its
bytes in a worker while its windows are hashed. An empty table gives no rows. Columns besides the two named ones can have any name.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskmart.llm import common, words

SIZE = 35
CHUNK_BYTES = 8_000_000
#: The modulus and the two bases of the windows' hashes: any large numbers below it.
PRIME = (1 << 61) - 1
BASES = (0x1B873593CC9E2D51 % PRIME, 0x165667B19E3779F9 % PRIME)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_P, _31, _30, _61, _1 = (np.uint64(x) for x in (PRIME, 31, 30, 61, 1))


def _times(x: np.ndarray, c: int) -> np.ndarray:
    """x c modulo the prime, for x below it."""
    high, low = x >> _31, x & _LOW31
    c_high, c_low = np.uint64(c >> 31), np.uint64(c & ((1 << 31) - 1))
    middle = high * c_low + low * c_high
    total = ((high * c_high) << _1) + (middle >> _30) + ((middle & _LOW30) << _31) + low * c_low
    total = (total & _P) + (total >> _61)
    return np.where(total >= _P, total - _P, total)


def _join(x: np.ndarray, n_x: int, y: np.ndarray, n_y: int, base: int) -> np.ndarray:
    """Hashes of runs of n_x + n_y words from those of n_x and of n_y."""
    n = max(min(len(x), len(y) - n_x), 0)
    total = _times(x[:n], pow(base, n_y, PRIME)) + y[n_x : n_x + n]
    return np.where(total >= _P, total - _P, total)


def runs(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """The hash of each run of `size` values, whatever text they belong to, by doubling."""
    out, n_out, now, n_now = None, 0, values, 1
    while True:
        if size & n_now:
            out, n_out = (now, n_now) if out is None else (_join(out, n_out, now, n_now, base), n_out + n_now)
        if 2 * n_now > size:
            return out
        now, n_now = _join(now, n_now, now, n_now, base), 2 * n_now


def digests(data: np.ndarray, found: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers below the prime for each word: halves of its digest."""
    n = len(found.start)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    ends = np.concatenate([[0], np.cumsum(found.end - found.start)])
    every = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[~words.SEPARATOR[data]]))])
    coded = every.dictionary_encode()
    _, at, content = coded.dictionary.buffers()
    content, at = content.to_pybytes(), np.frombuffer(at, np.int64)[: len(coded.dictionary) + 1].tolist()
    known = b"".join([blake2b(content[i:j], digest_size=16).digest() for i, j in zip(at[:-1], at[1:], strict=True)])
    halves = np.frombuffer(known, "<u8").reshape(-1, 2) % _P
    index = np.asarray(coded.indices)
    return halves[index, 0], halves[index, 1]


@dataclass
class Windows:
    """Of the texts of a slice: their words, the first word of each window, its two hashes, and the place and hash of its anchor (as far as wanted)."""

    data: np.ndarray
    offsets: np.ndarray
    found: words.Words
    at: np.ndarray
    hashes: tuple[np.ndarray, np.ndarray]
    place: np.ndarray
    anchor: np.ndarray


def windows(texts: pa.Array, size: int, hashes: bool = True, anchors: bool = True) -> Windows:
    data, offsets = common.text_bytes(texts)
    found = words.find(data, offsets)
    n, none = len(found.start) - size + 1, np.empty(0, np.uint64)
    out = Windows(data, offsets, found, np.empty(0, np.int64), (none, none), np.empty(0, np.int64), none)
    if n <= 0:
        return out
    halves = digests(data, found)
    text = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
    out.at = np.flatnonzero(text[:n] == text[size - 1 :])
    if hashes:
        out.hashes = tuple(runs(x, size, base)[out.at] for x, base in zip(halves, BASES, strict=True))
    if anchors:
        least = runs(halves[0], max(1, size // 3), BASES[0])
        place, reach = np.arange(len(least)), 1  # of the least of the next `reach` runs, the first of equal ones
        wanted = size - max(1, size // 3) + 1
        while reach < wanted:
            step = min(reach, wanted - reach)
            left, right = place[:-step], place[step:]
            place, reach = np.where(least[left] <= least[right], left, right), reach + step
        out.place = place[out.at]
        out.anchor = least[out.place]
    return out


def _texts(table: pa.Table):
    """A chunk's rows and texts in slices, so that arrays of numbers stay small."""
    return common.slices(iter(table.to_batches()))


class Known:
    """A set of hashes, one or two numbers below the prime each, sorted by the first and found by its leading bits."""

    def __init__(self, *numbers: np.ndarray):
        order = np.argsort(numbers[0])
        self.numbers = [x[order] for x in numbers]
        bits = max(1, len(order).bit_length())
        self.shift = np.uint64(61 - bits)
        self.slot = np.searchsorted(self.numbers[0], np.arange((1 << bits) + 1, dtype=np.uint64) << self.shift)

    def has(self, *numbers: np.ndarray) -> np.ndarray:
        lead = (numbers[0] >> self.shift).astype(np.int64)
        at, end = self.slot[lead], self.slot[lead + 1]
        out = np.zeros(len(lead), bool)
        left = np.flatnonzero(at < end)
        while len(left):
            now = at[left]
            hit = self.numbers[0][now] == numbers[0][left]
            for k in range(1, len(numbers)):
                hit &= self.numbers[k][now] == numbers[k][left]
            out[left[hit]] = True
            at[left] += 1
            left = left[~hit & (at[left] < end[left])]
        return out


def _longs(table: pa.Table, *names: str) -> tuple[np.ndarray, ...]:
    return tuple(table.column(x).to_numpy().astype(np.uint64) for x in names)


def _kept(data: np.ndarray, offsets: np.ndarray, found: words.Words, gone: np.ndarray, one_space: bool) -> pa.Array:
    """The texts without the words that are gone: words joined by one space, or with the white space that followed each word."""
    keep = np.zeros(len(data) + 1, bool)
    kept = ~gone
    step = np.zeros(len(data) + 1, np.int8)
    np.add.at(step, found.start[kept], 1)
    if one_space:
        data = np.append(data, np.uint8(32))
        text = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))[kept]
        np.add.at(step, found.end[kept], -1)
        keep = np.cumsum(step) > 0
        between = np.flatnonzero(text[:-1] == text[1:])  # kept words with another after them
        space = found.end[kept][between]
        data[space] = 32
        keep[space] = True
    else:
        data = np.append(data, np.uint8(32))
        step[:] = 0
        begin = found.start.copy()  # a word's share goes as far as the next word or the end of its text; what comes before the first word is the first's
        has = np.diff(found.first) > 0
        begin[found.first[:-1][has]] = offsets[:-1][has]
        end = np.append(begin[1:], 0)
        end[found.first[1:][has] - 1] = offsets[1:][has]
        np.add.at(step, begin[gone], 1)
        np.add.at(step, end[gone], -1)
        keep = np.cumsum(step) == 0
        keep[-1] = False
    lengths = np.concatenate([[0], np.cumsum(keep[: len(data) - 1] if not one_space else keep[:-1], dtype=np.int64)])[offsets]
    out = np.ascontiguousarray(data[:-1][keep[:-1]])
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(lengths.astype(np.int64)), pa.py_buffer(out)])


def remove_repeats(df: DataFrame, size: int = SIZE, one_space: bool = True, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, stable: bool = True) -> DataFrame:
    """doc_id, kept (text), n_words, n_removed, removed (intervals [first, last] of word numbers, as one flat array) and df's columns in carry, in front
    of which stands `carry_`."""
    docs = common.as_text(df, id_col, text_col, carry)
    if not stable:
        docs = common.materialise(docs, "texts")
    carried = "".join(f", `carry_{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(1, -(-total // chunk_bytes))
    chunked = docs.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_chunks)))

    def anchors(table: pa.Table) -> pa.Table:
        """Each anchor of the chunk and in how many places it stands."""
        found = []
        for _, texts in _texts(table):
            w = windows(texts, size, hashes=False)
            new = np.ones(len(w.place), bool)
            new[1:] = w.place[1:] != w.place[:-1]
            found.append(w.anchor[new])
        value, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
        return pa.table({"h": pa.array(value.astype(np.int64)), "chunk": pa.array(np.full(len(value), table.column("chunk")[0].as_py()), pa.int64()), "n": pa.array(n, pa.int64())})

    def candidates(table: pa.Table, known: pa.Table) -> pa.Table:
        """Each window of the chunk that has a repeated anchor, and how often it occurs."""
        again, found = Known(*_longs(known, "h")), [(np.empty(0, np.uint64),) * 2]
        for _, texts in _texts(table):
            w = windows(texts, size)
            some = again.has(w.anchor)
            found.append(tuple(h[some] for h in w.hashes))
        h, g = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))) if len(h) else np.empty(0, np.int64)
        n = np.diff(np.append(new, len(h)))
        chunk = table.column("chunk")[0].as_py() if table.num_rows else 0
        return pa.table({"h": pa.array(h[new].astype(np.int64)), "g": pa.array(g[new].astype(np.int64)), "chunk": pa.array(np.full(len(new), chunk), pa.int64()), "n": pa.array(n, pa.int64())})

    def cut(table: pa.Table, known: pa.Table) -> pa.Table:
        out, again = [], Known(*_longs(known, "h", "g"))
        for batch, texts in _texts(table):
            w = windows(texts, size, anchors=False)
            data, offsets, found = w.data, w.offsets, w.found
            flagged = np.zeros(len(found.start) + 1, np.int64)
            flagged[w.at[again.has(*w.hashes)] + 1] = 1
            run = np.cumsum(flagged)
            gone = run[1:] > run[np.maximum(np.arange(len(found.start)) + 1 - size, 0)]
            edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
            text = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
            split = np.zeros(len(gone) + 1, bool)  # an interval ends where its text ends
            split[1:-1] = gone[1:] & gone[:-1] & (text[1:] != text[:-1]) if len(gone) else False
            begin = np.flatnonzero((edge == 1) | split)
            last = np.flatnonzero((edge == -1) | split) - 1
            per = np.searchsorted(begin, found.first)
            origin = np.repeat(found.first[:-1], np.diff(per))
            spans = np.stack([begin - origin, last - origin], 1).ravel()
            removed = np.concatenate([[0], np.cumsum(gone)])[found.first]
            out.append(pa.table({"doc_id": batch.column(batch.schema.get_field_index("doc_id")), "kept": _kept(data, offsets, found, gone, one_space).cast(pa.string()), "n_words": pa.array(np.diff(found.first), pa.int64()), "n_removed": pa.array(np.diff(removed), pa.int64()), "removed": pa.ListArray.from_arrays(pa.array(per * 2, pa.int32()), pa.array(spans, pa.int64())), **{f"carry_{c}": batch.column(batch.schema.get_field_index(f"carry_{c}")) for c in carry}}))
        return pa.concat_tables(out)

    def repeated(rows: DataFrame, *key: str) -> DataFrame:
        """Of hashes by chunk: those with several places in all chunks together. A hash has one row for each chunk."""
        return rows.withColumn("places", F.sum("n").over(Window.partitionBy(*key))).where("places > 1").select("chunk", *key)

    by_chunk = chunked.groupBy("chunk")
    some = repeated(by_chunk.applyInArrow(anchors, "h long, chunk long, n long"), "h")
    same = repeated(by_chunk.cogroup(some.groupBy("chunk")).applyInArrow(candidates, "h long, g long, chunk long, n long"), "h", "g")
    return by_chunk.cogroup(same.groupBy("chunk")).applyInArrow(cut, f"doc_id long, kept string, n_words long, n_removed long, removed array<long>{carried}")
