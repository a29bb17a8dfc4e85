"""Best-fit packing of documents into sequences of a fixed length, by the sum-of-squares rule.

A document goes where, after it is placed, the sum over all gaps of the squared number of open sequences with that gap is
least (a new sequence is one of the places). Only documents longer than a sequence are cut; all pieces but the first are
then full. Pieces are packed in groups of about GROUP_DOCS documents, dealt by row, each longest piece first; a task streams
its groups and keeps open sequences only. Those still open at a group's end (two or three in a hundred) have nothing to come that the rule could save them for: they
are packed anew by least gap if that makes fewer of them.

Null text counts as empty text (one end id). Equal and null doc_ids are separate documents, equal rows too, and are dealt over all groups. Texts are encoded whole; a
long one gives as many pieces as it needs. An empty table gives no rows. Columns besides the two named ones can have any name. df must give the same rows in the same
order when it is read again, as files and written tables do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.llm import common, tokens

LENGTH = 1024
#: Documents in a packing group: enough that the sequences left open at its end (a few dozen) don't count.
GROUP_DOCS = 50_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", sequence_id long, offset long"


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first is shorter if n isn't a multiple of length."""
    first = n % length or length
    return [(0, first), *((a, length) for a in range(first, n, length))]


class SumOfSquares:
    """Places (size, item) pairs into bins, one after another; counts are the open bins for each gap."""

    def __init__(self, length: int):
        self.length, self.made = length, 0
        self.counts = np.zeros(length + 1, np.int64)
        self.bins: list[list[list]] = [[] for _ in range(length + 1)]

    def gap_for(self, size: int) -> int:
        """The gap to fill; that of a new bin is the whole length."""
        if size == self.length:
            return size
        c = self.counts
        gaps = np.flatnonzero(c[size : self.length]) + size
        if not len(gaps):
            return self.length
        change = 2 * (c[gaps - size] - c[gaps]) + 2
        if gaps[0] == size:  # the bin gets full and isn't counted again
            change[0] = 1 - 2 * c[size]
        best = int(change.argmin())
        return int(gaps[best]) if change[best] <= 2 * c[self.length - size] + 1 else self.length

    def place(self, size: int, item) -> list | None:
        """The bin's (size, item) pairs if it is full now."""
        gap = self.gap_for(size)
        if gap == self.length:
            into = []
            self.made += 1
        else:
            into = self.bins[gap].pop()
            self.counts[gap] -= 1
        into.append((size, item))
        if gap == size:
            return into
        self.bins[gap - size].append(into)
        self.counts[gap - size] += 1
        return None

    def rest(self) -> list[list]:
        """The bins still open at the end: as they are, or packed anew, longest first into the least gap, if those are fewer."""
        open_ = [x for bins in self.bins for x in bins]
        anew: list[list] = []
        gaps: list[list[list]] = [[] for _ in range(self.length + 1)]
        for size, item in sorted((y for x in open_ for y in x), key=lambda y: -y[0]):
            gap = next((g for g in range(size, self.length) if gaps[g]), 0)
            into = gaps[gap].pop() if gap else []
            if not gap:
                anew.append(into)
            into.append((size, item))
            gaps[(gap or self.length) - size].append(into)
        return anew if len(anew) < len(open_) else open_


def pieces(df: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = tokens.END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every whole text with their checksums; ids themselves stay where they were made."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer, 2 * tokens.REMEMBERED)  # little else is in memory here
        for batch, texts in common.slices(batches, most=tokens.SLICE_BYTES):
            ids, offsets = enc.encode(texts)
            out = []
            for doc_id, a, b in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:], strict=True):
                own = np.append(ids[a:b], np.uint32(end_id))
                out += [(doc_id, k, s, n, common.crc32(own[s : s + n])) for k, (s, n) in enumerate(cuts(len(own), length))]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.as_text(df, id_col, text_col).mapInArrow(cut, _PIECES)


def pack(pieces_: DataFrame, n_docs: int, length: int = LENGTH, group_docs: int = GROUP_DOCS) -> DataFrame:
    """pieces_ with the sequence and the offset of each."""
    n_groups = max(1, round(n_docs / group_docs))
    keyed = pieces_.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_groups)))  # by row: equal ones are no group

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer, number, out = None, SumOfSquares(length), 0, []

        def close(full: list) -> None:
            nonlocal number
            offset = 0
            for size, item in full:
                out.append((*item, group << 40 | number, offset))
                offset += size
            number += 1

        def batch_out() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * 7
            made = pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), *[pa.int64()] * 5), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
            out.clear()
            return made

        for batch in batches:
            for *item, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    for x in packer.rest():
                        close(x)
                    group, packer, number = g, SumOfSquares(length), 0
                if full := packer.place(item[3], item):
                    close(full)
            yield batch_out()
        for x in packer.rest():
            close(x)
        yield batch_out()

    order = [F.col("group"), F.col("length").desc(), F.col("doc_id").asc_nulls_first(), F.col("piece"), F.col("ids_crc32")]
    return keyed.repartition(n_groups, "group").sortWithinPartitions(*order).mapInArrow(place, _PACKED)


def pack_documents(df: DataFrame, tokenizer: str | None = None, length: int = LENGTH, group_docs: int = GROUP_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(pieces(df, tokenizer, length, id_col=id_col, text_col=text_col), df.count(), length, group_docs)
