"""Benchmark decontamination: every passage of the training texts is a query against a BM25 index of the benchmark's items.

Words are runs of ASCII letters and digits and all non-ASCII characters, lower-cased. Items are indexed by length: those of up to S words, S being STRIDE
times a power of two, form a class. Its passages are 2 S words, one every S words, so an item within a text is within a passage, and a
long item changes nothing for short ones. A passage's score for an item is the sum of BM25 weights (k1, b) of the item's terms that are in the passage, and
its share is that over the sum of all of the item's weights; all pairs with a share of THRESHOLD are retrieved.

Retrieval is block-max WAND. Items are in blocks of BLOCK, and each term's list has its largest share over all items and in each block. First, for a batch of
passages at once, the block maxima of the passage's terms are summed up (an item's most frequent terms, which hold at most half the threshold, count with
one bound for the block); a passage without a block that reaches the threshold has no pivot. The others are walked in step (`wand`): each has a cursor in the list
of each of its terms, in order of items; the pivot is the first item at which the lists' maxima can reach the threshold; where the maxima of its block can't, the
cursors skip the block; else they move up to the pivot, which is scored once all are there. Nothing is skipped that could reach the threshold.

A retrieved pair counts as contamination if the passage holds OVERLAP of the word triples of the item's question and of its answer: the answer is the
item's last sentence, the question what comes before it; of a single sentence, the last quarter and the rest. A part of one or two words counts if the
passage holds it: it is compared with the passage's windows of as many words.

Items go to the executors in shards of SHARD_BYTES of text, one after the other (the texts are read once for each); document frequencies and the mean
length are of all items. Null texts have no words, null items and those without words match nothing, repeated texts are matched each on
their own, benchmark rows with equal id and text are one item. Texts are read whole, however long. Empty tables give no rows. Only the named columns are
read, so others can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.llm import common, words

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP = 0.6, 0.5
LOW = THRESHOLD - 1e-9
STRIDE, BLOCK, TRIPLE = 64, 16, 3
SHARD_BYTES = 16_000_000
SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_FOUND = "doc_id long, item_id long, passage long, score double, share double, question double, answer double"


def _word_hashes(texts: pa.Array) -> tuple[words.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their hashes, and the lower-cased bytes with the texts' offsets in them."""
    data, offsets = common.text_bytes(pc.utf8_lower(texts))
    found = words.find(data, offsets, SEPARATOR)
    return found, words.hashes(data, found.start, found.end), data, offsets


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (a number for each row), item_id, position, word, answer (its word is part of the answer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.slices(batches):
            found, h, raw, offsets = _word_hashes(texts)
            n = np.diff(found.first)
            text = np.repeat(np.arange(len(n)), n)
            # A sentence ends where a mark is followed by white space; the last one is the answer.
            ends = np.isin(raw, [33, 46, 63]) & np.append(words.SEPARATOR[raw[1:]], False)
            last = np.zeros(len(n), np.int64)
            marks = np.flatnonzero(ends)
            owner = np.searchsorted(offsets, marks, "right") - 1
            begins = found.start[np.maximum(found.first[1:] - 1, 0)] if len(h) else np.zeros(len(n), np.int64)
            before = marks < begins[owner]
            np.maximum.at(last, owner[before], marks[before])
            position = np.arange(len(h)) - found.first[:-1][text]
            answer = np.where(last[text] > 0, found.start > last[text], position >= (n - n // 4)[text])
            yield pa.record_batch({"item": batch.column(2).take(pa.array(text)), "item_id": batch.column(0).take(pa.array(text)), "position": pa.array(position), "word": pa.array(h.view(np.int64)), "answer": pa.array(answer)})

    rows = common.as_text(items, id_col, text_col).withColumn("item", F.xxhash64("doc_id", "text"))
    return rows.mapInArrow(run, "item long, item_id long, position long, word long, answer boolean").dropDuplicates(["item", "position"])


@dataclass
class Index:
    """Of one length class. term: sorted word hashes; slot: first of them with the leading bits. Lists, each as offsets and values: an item's terms are in
    pairs; of_term: a term's (item, share) in order of items, with the largest as top; of_blocks: a term's blocks with the largest share in each (whole), and
    the largest among items of which it is one of the rarest terms (rare). block_rest: what the other terms of an item can add in a block."""

    item_id: np.ndarray
    term: np.ndarray
    slot: np.ndarray
    of_term: np.ndarray
    item: np.ndarray
    share: np.ndarray
    weight: np.ndarray
    top: np.ndarray
    of_blocks: np.ndarray
    block: np.ndarray
    whole: np.ndarray
    rare: np.ndarray
    block_rest: np.ndarray
    parts: list
    stride: int


_SLOT_BITS = 22


def _offsets(key: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(key, np.arange(n + 1))


def _expand(offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number in at, position in the values) of all values of the lists at."""
    n = offsets[at + 1] - offsets[at]
    total = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(np.arange(len(at)), n), np.repeat(offsets[at] - total[:-1], n) + np.arange(total[-1])


def stride_of(n: int) -> int:
    """Of the class of items of n words."""
    stride = STRIDE
    while stride < n:
        stride *= 2
    return stride


def build(rows: pa.Table, n_items: int, mean_length: float) -> list[Index]:
    """An index for each length class; rows: item, item_id, position, word, answer, df of a shard, sorted by item and position; df is over all n_items."""
    item, h, answer, df = (rows.column(x).to_numpy() for x in ("item", "word", "answer", "df"))
    first = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
    ids = rows.column("item_id").take(pa.array(first)).to_pylist()
    ends = np.append(first[1:], len(item))
    strides = np.array([stride_of(n) for n in (ends - first).tolist()])
    out = []
    for stride in np.unique(strides).tolist():
        own = np.flatnonzero(strides == stride)
        at = np.concatenate([np.arange(first[k], ends[k]) for k in own])
        length = ends[own] - first[own]
        out.append(_index([ids[k] for k in own], length, h[at].astype(np.int64).view(np.uint64), answer[at], df[at], n_items, mean_length, stride))
    return out


def _index(item_id: list, length: np.ndarray, h: np.ndarray, answer: np.ndarray, df: np.ndarray, n_items: int, mean_length: float, stride: int) -> Index:
    n = len(length)
    number = np.repeat(np.arange(n), length)
    term, index = np.unique(h, return_inverse=True)
    frequency = np.zeros(len(term))
    frequency[index] = df
    idf = np.log1p((n_items - frequency + 0.5) / (frequency + 0.5))
    pair, tf = np.unique(number * len(term) + index, return_counts=True)
    pi, pt = pair // len(term), pair % len(term)
    weight = idf[pt] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[pi] / mean_length))
    share = weight / np.bincount(pi, weight)[pi]
    # Rarest first; what is left after the rare ones is at most half the threshold.
    order = np.lexsort((-share, frequency[pt], pi))
    before = np.cumsum(share[order]) - share[order]
    before -= before[np.searchsorted(pi[order], pi[order])]
    rare = np.zeros(len(pair), bool)
    rare[order] = 1 - before > THRESHOLD / 2
    n_blocks = n // BLOCK + 1
    block_rest = np.zeros(n_blocks)
    np.maximum.at(block_rest, np.arange(n) // BLOCK, np.bincount(pi[~rare], share[~rare], n))
    by_term = np.lexsort((pi, pt))
    pi, pt, share, weight, rare = (x[by_term] for x in (pi, pt, share, weight, rare))
    key, at = np.unique(pt * n_blocks + pi // BLOCK, return_inverse=True)
    whole, most_rare, top = np.zeros(len(key)), np.zeros(len(key)), np.zeros(len(term))
    np.maximum.at(whole, at, share)
    np.maximum.at(most_rare, at[rare], share[rare])
    np.maximum.at(top, pt, share)
    parts, ends = [], np.cumsum(length)
    for a, b in zip((ends - length).tolist(), ends.tolist(), strict=True):
        cut = b - int(answer[a:b].sum())
        parts.append(tuple((min(TRIPLE, len(part)), np.unique(_windows(part, min(TRIPLE, len(part))))) for part in (h[a:cut], h[cut:b])))
    slot = np.searchsorted(term, np.arange((1 << _SLOT_BITS) + 1, dtype=np.uint64) << np.uint64(64 - _SLOT_BITS))
    slot[-1] = len(term)
    return Index(np.array(item_id, object), term, slot.astype(np.int32), _offsets(pt, len(term)), pi, share, weight, top, _offsets(key // n_blocks, len(term)), key % n_blocks, whole, most_rare, block_rest, parts, stride)


def _windows(h: np.ndarray, size: int) -> np.ndarray:
    return words.windows(h, np.array([0, len(h)]), size)[1] if size else np.empty(0, np.uint64)


def look_up(x: Index, h: np.ndarray) -> np.ndarray:
    """The number of each word's term, -1 for words of no item."""
    lead = (h >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
    at, end = x.slot[lead], x.slot[lead + 1]
    out = np.full(len(h), -1, np.int32)
    left = np.flatnonzero(at < end)
    at, end = at[left], end[left]
    while len(left):
        hit = x.term[at] == h[left]
        out[left[hit]] = at[hit]
        at = at + 1
        go = ~hit & (at < end)
        left, at, end = left[go], at[go], end[go]
    return out


def with_pivot(x: Index, passage: np.ndarray, term: np.ndarray) -> np.ndarray:
    """The passages in which the block maxima of some block reach the threshold; the rows are distinct and sorted."""
    n_blocks = len(x.block_rest)
    i, at = _expand(x.of_blocks, term)
    has = x.rare[at] > 0
    i, at = i[has], at[has]
    key, back = np.unique(passage[i] * n_blocks + x.block[at], return_inverse=True)
    bound = np.bincount(back, x.rare[at], len(key))
    return np.unique(key[bound + x.block_rest[key % n_blocks] >= LOW] // n_blocks)


def wand(x: Index, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """passage, item, score, share of all pairs at the threshold, sorted, from the distinct (passage, term) rows, sorted. All passages take a step at a time."""
    n = len(x.item_id)
    key = np.repeat(np.arange(len(x.term)), np.diff(x.of_term)) * n + x.item  # sorted: by term, then item
    block_key = np.repeat(np.arange(len(x.term)), np.diff(x.of_blocks)) * len(x.block_rest) + x.block
    at, end = x.of_term[term], x.of_term[term + 1]
    found: list[tuple[np.ndarray, ...]] = []
    while len(at):
        now = x.item[at]
        order = np.lexsort((now, passage))
        passage, term, at, end, now = passage[order], term[order], at[order], end[order], now[order]
        first = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        owner = np.cumsum(np.append(True, passage[1:] != passage[:-1])) - 1
        reach = np.cumsum(x.top[term])
        reach -= (reach[first] - x.top[term[first]])[owner]
        enough = np.flatnonzero(reach >= LOW)
        left, where = np.unique(owner[enough], return_index=True)
        if not len(left):
            break
        # Passages without a pivot are done.
        pivot = np.full(len(first), n)
        pivot[left] = now[enough[where]]
        keep = pivot[owner] < n
        passage, term, at, end, now, to = passage[keep], term[keep], at[keep], end[keep], now[keep], pivot[owner[keep]]
        owner = np.cumsum(np.append(True, passage[1:] != passage[:-1])) - 1
        low = now <= to
        # The block's maxima, of the lists that have come as far as the pivot.
        wanted = term * len(x.block_rest) + to // BLOCK
        place = np.minimum(np.searchsorted(block_key, wanted), len(block_key) - 1)
        best = np.bincount(owner, np.where(low & (block_key[place] == wanted), x.whole[place], 0.0))
        skip = (best < LOW)[owner]
        # A skipped block ends before its last item if another list begins before that.
        last = np.full(len(best), n)
        np.minimum.at(last, owner[~low], now[~low])
        over = np.minimum((to // BLOCK + 1) * BLOCK, last[owner])
        here = np.flatnonzero(~skip & (now == to))
        ready = np.ones(len(best), bool)
        ready[owner[~skip & (now < to)]] = False  # lists that are still before the pivot move up first
        here = here[ready[owner[here]]]
        if len(here):
            own, share, score = owner[here], np.bincount(owner[here], x.share[at[here]], len(best)), np.bincount(owner[here], x.weight[at[here]], len(best))
            which, some = np.unique(own, return_index=True)
            ok = share[which] >= LOW
            found.append((passage[here[some[ok]]], to[here[some[ok]]], score[which[ok]], share[which[ok]]))
        target = np.where(skip & low, over, np.where(low, np.where(ready[owner], to + 1, to), now))
        at = np.maximum(at, np.searchsorted(key, term * n + target))
        more = at < end
        passage, term, at, end = passage[more], term[more], at[more], end[more]
    if not found:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0),) * 2
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    order = np.lexsort((columns[1], columns[0]))
    return tuple(c[order] for c in columns)


def passages(x: Index, found: words.Words, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (passage, term) rows of all texts, sorted, and the number of each text's first passage."""
    n = np.diff(found.first)
    row = np.flatnonzero(term >= 0)
    text = np.repeat(np.arange(len(n)), n)[row]
    step = (row - found.first[text]) // x.stride
    many = np.maximum(1, -(-n // x.stride) - 1)
    base = np.concatenate([[0], np.cumsum(many)])
    keys = np.unique(np.concatenate([((base[text] + s) * len(x.term) + term[row])[(s >= 0) & (s < many[text])] for s in (step, step - 1)]))
    return keys // len(x.term), keys % len(x.term), base


def matches(indexes: list[Index], texts: pa.Array) -> list[tuple]:
    """(number of the text, item_id, passage, score, share, question, answer) of each text and item that it holds."""
    found, h, _, _ = _word_hashes(texts)
    rows = []
    for x in indexes:
        passage, term, base = passages(x, found, look_up(x, h))
        some = np.isin(passage, with_pivot(x, passage, term))
        best: dict[tuple[int, int], tuple] = {}
        for p, i, score, share in zip(*(c.tolist() for c in wand(x, passage[some], term[some])), strict=True):
            t = int(np.searchsorted(base, p, "right")) - 1
            number = p - int(base[t])
            a = int(found.first[t]) + number * x.stride
            own = h[a : min(a + 2 * x.stride, int(found.first[t + 1]))]
            both = [float(np.isin(part, _windows(own, size)).mean()) if size else 1.0 for size, part in x.parts[i]]
            if min(both) >= OVERLAP and (old := best.get((t, i), (0,) * 3))[2] < share - 1e-12:  # of equal ones the first passage
                best[t, i] = (number, score, share, *both)
        rows += [(t, x.item_id[i], *v) for (t, i), v in best.items()]
    return rows


def _shards(benchmark: DataFrame, item_col: str, item_text_col: str, shard_bytes: int) -> Iterator[tuple[list[Index], bool]]:
    """The indexes of one shard after the other, each of bounded size, and whether it is the last."""
    every = item_words(benchmark, item_col, item_text_col)
    frequency = every.select("item", "word").distinct().groupBy("word").agg(F.count("*").alias("df"))
    every = common.materialise(every.join(frequency, "word").select("item", "item_id", "position", "word", "answer", "df"), "benchmark")
    n_items, mean, total = every.groupBy("item").agg(F.count("*").alias("n")).agg(F.count("*"), F.avg("n"), F.sum("n")).first()
    n_shards = max(1, -(-int(total or 0) * 6 // shard_bytes))  # a word is six bytes, about
    for k in range(n_shards):
        rows = every.where(F.pmod(F.xxhash64("item"), F.lit(n_shards)) == k).sort("item", "position").toArrow()
        yield build(rows, n_items, float(mean)) if rows.num_rows else [], k + 1 == n_shards
    common.discard(every)


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each text and item that it holds: where (the passage's number, in passages of the item's class), the score, its share and both overlaps."""
    spark = df.sparkSession
    docs = common.as_text(df, id_col, text_col)
    found = []
    for indexes, last in _shards(benchmark, item_col, item_text_col, shard_bytes):
        shared = spark.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, texts in common.slices(batches):
                ids = batch.column(0).to_pylist()
                rows = [(ids[t], *v) for t, *v in matches(shared.value, texts)]
                columns = zip(*rows, strict=True) if rows else [()] * 7
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.float64()] * 4, strict=True)], ["doc_id", "item_id", "passage", "score", "share", "question", "answer"])

        found.append(docs.mapInArrow(run, _FOUND))
        if not last:  # one shard's index at a time
            found[-1] = common.materialise(found[-1], "contaminated")
            shared.destroy()
    return reduce(DataFrame.unionByName, found)


def flag(df: DataFrame, benchmark: DataFrame, name: str = "is_contaminated", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """df with one more boolean column (which replaces one of this name): whether the text holds an item. Rows are flagged where they are, without a shuffle."""
    common.ship(df.sparkSession)
    df = df.drop(name)
    names, out = df.columns, df
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BooleanType())])
    for k, (indexes, last) in enumerate(_shards(benchmark, item_col, item_text_col, shard_bytes)):
        shared = df.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            for batch, texts in common.slices(batches, text_col):
                found = np.asarray(batch.column(len(names)).to_numpy(zero_copy_only=False)).copy() if k else np.zeros(batch.num_rows, bool)
                found[[r[0] for r in matches(shared.value, texts)]] = True
                yield pa.record_batch([*(batch.column(c) for c in range(len(names))), pa.array(found)], [*names, name])

        out = out.mapInArrow(run, schema)
        if not last:
            out = common.materialise(out, "flagged")
            shared.destroy()
    return out
