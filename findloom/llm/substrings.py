"""Repeated substrings: shards of candidate stretches, each with a Burrows-Wheeler transform whose intervals are expanded backwards up to the minimum length."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findloom.llm.common import saved, shared_dir, table

#: Bytes of the grams whose least hash, in every stretch of the minimum length, names the shard of the stretch.
GRAM = 16
#: Bytes of text that are worked on at once in a document, in short documents together, and of stretches in a transform of whole shards.
SEGMENT, PIECE, BLOCK = 8 << 20, 1 << 16, 1 << 20
#: A gram in more rows than this is hot: its stretches are split by a second gram, and equal ones are one before they meet.
HOT = 10_000
#: Starts in a stretch of one repeated gram, at most.
LONG = 1 << 10
#: Symbols that the first sort of a transform compares: seven of nine bits each.
FIRST = 7
_rng = np.random.default_rng(50)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = [np.uint64(x) for x in (_rng.integers(1, 1 << 62, 6) * 2 + 1)]
_PLACE = np.uint64((1 << 24) - 1)
_NEVER = (1 << 63) - 1


def _grams(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes."""
    h, size = _BYTE[b], 1
    for step in _STEP[:4]:
        h = h[:-size] * step + h[size:]
        h ^= h >> np.uint64(29)
        size *= 2
    return h * _STEP[4]


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """The place of the least of each `span` hashes; of equal ones the first."""
    low, size = h & ~_PLACE | np.arange(len(h), dtype=np.uint64), 1
    while 2 * size <= span:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    if span > size:
        low = np.minimum(low[: -(span - size)], low[span - size :])
    return (low & _PLACE).astype(np.int64)


def _marks(h: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, half: int) -> np.ndarray:
    """Two bytes for grams of texts that go from begin to end: what stands on the `half` bytes before each one, and on those after it; 0 where the text is too short for that."""
    left, right = at >= begin + half, at + half + GRAM <= end
    far = np.clip(np.stack([at - half, at + half]), 0, len(h) - 1)
    near = np.clip(np.stack([at - half // 2, at + half // 2]), 0, len(h) - 1)
    m = ((h[far] * _STEP[0] + h[near]) * _STEP[1] >> np.uint64(40)) % np.uint64(255) + np.uint64(1)
    return np.where(left, m[0], 0) << np.uint64(8) | np.where(right, m[1], 0)


def _binary(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary array without nulls."""
    wide = pa.types.is_large_binary(a.type)
    offsets = np.frombuffer(a.buffers()[1], np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2] if len(a) else None
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8), offsets - offsets[0]


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each begin, so many as its size."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about PIECE bytes, one row at least."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        yield i, j
        i = j


def stretches(texts: pa.Array, least: int, second: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, gram, marks or second gram, first start, number of starts) of the runs of starts whose `least` bytes have their least gram, and with
    `second` their least one by another order too, in one place. A gram is 47 bits of its hash, so that 16 bits of marks beside it leave the sign alone.

    Equal strings have their least gram in the same place inside, so they meet under one gram. Short texts are hashed together, long ones by segments.
    """
    span = least - GRAM + 1
    data, offsets = _binary(texts)
    for i, j in _pieces(offsets):
        size = int(offsets[j] - offsets[i])
        for base in range(0, max(1, size - least + 1), SEGMENT) if j == i + 1 else (0,):
            low = offsets[i] + base
            b = data[low : min(low + SEGMENT + least - 1, offsets[j]) if j == i + 1 else offsets[j]]
            if len(b) < least:
                continue
            edges = np.minimum(offsets[i : j + 1] - offsets[i], len(b)) if base == 0 else np.array([0, len(b)])
            h = _grams(b)
            at = _least(h, span)
            sizes = np.maximum(np.diff(edges) - least + 1, 0)
            start = _spread(edges[:-1], sizes)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = at[start]
            new = at[1:] != at[:-1]
            if second:
                other = _least(h * _STEP[5], span)[start]
                new |= other[1:] != other[:-1]
            first = np.concatenate([[0], np.flatnonzero(new) + 1]) if len(at) else np.empty(0, np.int64)
            who, place = row[first], at[first]
            extra = h[other[first]] if second else _marks(h, place, edges[who], edges[who + 1], (least - GRAM + 1) // 2)
            yield who + i, (h[place] >> np.uint64(17)).astype(np.int64), extra.astype(np.int64), start[first] - edges[who] + base, np.diff(np.append(first, len(at)))


def transform(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix order, Burrows-Wheeler transform, where suffixes differ from the one before in FIRST symbols); suffixes are ordered by `least` symbols or more."""
    padded = np.concatenate([text.astype(np.int64), np.zeros(FIRST, np.int64)])
    key = padded[: len(text)].copy()
    for k in range(1, FIRST):
        key = key << 9 | padded[k : k + len(text)]
    order = np.argsort(key)
    differ = np.concatenate([[True], np.diff(key[order]) != 0])
    rank = np.empty(len(text), np.int64)
    rank[order] = np.cumsum(differ) - 1
    bits, size = max(1, int(len(text)).bit_length()), FIRST
    while size < least:
        after = np.zeros_like(rank)
        after[:-size] = rank[size:] + 1
        after += rank * (int(rank.max()) + 2)
        if 3 * bits < 63:  # ranks and places in one number sort fastest
            after = np.sort(after << bits | np.arange(len(text)))
            order, after = after & (1 << bits) - 1, after >> bits
        else:
            order = np.argsort(after, kind="stable")
            after = after[order]
        rank[order] = np.cumsum(np.concatenate([[False], after[1:] != after[:-1]]))
        size *= 2
    return order, text[order - 1], differ


def common_prefixes(text: np.ndarray, bwt: np.ndarray, differ: np.ndarray, least: int) -> np.ndarray:
    """Where neighbours in suffix order share fewer than `least` symbols: about how many (a bound), else -1.

    Intervals of the suffixes that begin with one string, at first of FIRST symbols, are extended backwards by every symbol, all strings of a length together. An
    end that no shorter string had gets the length as its common prefix and goes on; others stop. Lengths up to `least` are enough.
    """
    n = len(text)
    column = np.sort(text)
    last_to_first = np.empty(n, np.int64)
    last_to_first[np.argsort(bwt, kind="stable")] = np.arange(n)
    low = np.flatnonzero(differ)
    high = np.append(low[1:], n)
    shared = np.full(n + 1, -1, np.int64)
    shared[low] = shared[high] = 0
    new_symbol = np.concatenate([[True], column[1:] != column[:-1]])
    owner = np.full(n + 1, -1, np.int64)
    for length in range(FIRST, least):
        sizes = high - low
        source = np.repeat(np.arange(len(low)), sizes)
        at = last_to_first[np.arange(len(source)) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)]
        owner[at] = source
        at.sort()
        mine = owner[at]
        edge = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (mine[1:] != mine[:-1]) | new_symbol[at[1:]]])
        owner[at] = -1
        starts = np.flatnonzero(edge)
        ends = at[np.append(starts[1:], len(at)) - 1] + 1
        keep = shared[ends] < 0
        low, high = at[starts[keep]], ends[keep]
        shared[high] = length
        if not len(low):
            break
    return shared[:n]


def _holders(data: np.ndarray, sizes: np.ndarray, holders: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For contexts of so many bytes each: the number of their starts, and for each start the least holder of any context that has the same `least` bytes."""
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.ones(len(data) + len(sizes) + 1, np.uint16)
    text[_spread(starts, sizes)] = data
    text[_spread(starts, sizes)] += 2
    text[-1] = 0
    order, bwt, differ = transform(text, least)
    group = np.cumsum(common_prefixes(text, bwt, differ, least) >= 0) - 1
    n = sizes - least + 1
    begins = _spread(starts, n)
    holder = np.full(len(text), _NEVER)
    holder[begins] = np.repeat(holders, n)
    least_of = np.minimum.reduceat(holder[order], np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1]))
    out = np.empty(len(text), np.int64)
    out[order] = least_of[group]
    return n, out[begins]


def first_holders(contexts: list[bytes], holders: np.ndarray, least: int) -> list[np.ndarray]:
    """For each context, by start: the least holder of any context that has the same `least` bytes."""
    n, found = _holders(np.frombuffer(b"".join(contexts), np.uint8), np.array([len(c) for c in contexts]), holders, least)
    return np.split(found, np.cumsum(n)[:-1])


def _shared_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, 2 * gram + hot) of sorted (gram and marks, row) ones whose gram another row has with what's before or after it. Of a gram in more
    than HOT rows all are hot; they pass as they come, so no gram is held whole."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    hot = None

    def told(row: np.ndarray, gram: np.ndarray, flag: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(gram * 2 + flag)], ["row", "tag"])

    def judged(key: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
        gram, fine = key >> 16, np.zeros(len(key), bool)
        counts = np.diff(np.append(np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])), len(gram)))
        many = np.repeat(counts > HOT, counts)
        for mark in (key >> 8 & 255, key & 255):
            k = gram << 8 | mark
            order = np.argsort(k, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], np.diff(k[order]) != 0]))
            some = np.minimum.reduceat(row[order], cut) < np.maximum.reduceat(row[order], cut)
            fine[order] |= np.repeat(some, np.diff(np.append(cut, len(k)))) & (mark[order] > 0)
        for flag, rows in ((0, fine & ~many), (1, many)):
            if rows.any():
                yield told(row[rows], gram[rows], flag)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        last = held[-1][0][-1] >> 16
        if hot is None and sum(len(k) for k, _ in held) < 1 << 18:
            continue
        key, row = (np.concatenate(x) for x in zip(*held))
        if hot is not None:
            n = np.searchsorted(key >> 16, hot, "right")
            if n:
                yield told(row[:n], key[:n] >> 16, 1)
            key, row, hot = key[n:], row[n:], hot if last == hot else None
        n = np.searchsorted(key >> 16, last) if len(key) else 0
        if n:
            yield from judged(key[:n], row[:n])
        if len(key) - n > HOT:
            yield told(row[n:], key[n:] >> 16, 1)
            n, hot = len(key), last
        held = [(key[n:], row[n:])] if len(key) > n else []
    if held:
        yield from judged(*(np.concatenate(x) for x in zip(*held)))


def _judge(least: int, every: bool = False):
    """Rows (shard, who, rank, first, context), sorted by shard, to the runs of starts whose strings a smaller rank has in the shard (all runs with
    `every`): who, rank, first start, starts, the least rank. Equal contexts are one; those that stand alone in their shard need no transform."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        shard, rank, first = (rows.column(i).to_numpy() for i in (0, 2, 3))
        coded = rows.column(4).combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy()
        sizes = np.diff(_binary(coded.dictionary)[1])
        holder = np.full(len(sizes), _NEVER)
        np.minimum.at(holder, code, rank)
        shard_of = np.empty(len(sizes), np.int64)
        shard_of[code] = shard  # a context has its grams, so equal ones are in one shard
        _, number, count = np.unique(shard_of, return_inverse=True, return_counts=True)
        several = np.flatnonzero(count[number] > 1)
        # Runs of starts with one holder: the context's code, the first start, the holder.
        alone = np.flatnonzero(count[number] == 1)
        run = [alone, np.zeros(len(alone), np.int64), holder[alone]]
        if len(several):
            n, h = _holders(_binary(coded.dictionary.take(pa.array(several)))[0], sizes[several], holder[several], least)
            begins = np.cumsum(n) - n
            cut = np.concatenate([[True], h[1:] != h[:-1]])
            cut[begins] = True
            cut = np.flatnonzero(cut)
            at = np.searchsorted(begins, cut, "right") - 1
            run = [np.concatenate(x) for x in zip(run, (several[at], cut - begins[at], h[cut]))]
        order = np.lexsort((run[1], run[0]))
        owner, begin, h = (x[order] for x in run)
        end = np.append(begin[1:], 0)
        ends = np.append(owner[1:] != owner[:-1], True)
        end[ends] = sizes[owner[ends]] - least + 1
        number = np.bincount(owner, minlength=len(sizes))
        of = np.repeat(np.arange(len(code)), number[code])
        at = _spread((np.cumsum(number) - number)[code], number[code])
        if not every:
            held = h[at] < rank[of]
            of, at = of[held], at[held]
        who = rows.column(1).combine_chunks().take(pa.array(of))
        return pa.RecordBatch.from_arrays([who, *map(pa.array, (rank[of], first[of] + begin[at], end[at] - begin[at], h[at]))], ["who", "rank", "first", "n", "holder"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, (_, offsets) = batch.column(0).to_numpy(), _binary(batch.column(4))
            began = 0
            while began < batch.num_rows:  # whole shards, with BLOCK bytes or more of contexts
                whole = np.flatnonzero(offsets[began:] - offsets[began] >= BLOCK - size)
                i = min(began + int(whole[0]), batch.num_rows) if len(whole) else batch.num_rows
                last = shard[i - 1] if i else held[-1].column(0)[-1].as_py()
                j = int(np.searchsorted(shard, last, "right")) if len(whole) else i
                held.append(batch.slice(began, j - began))
                size += int(offsets[j] - offsets[began])
                if j < batch.num_rows:
                    yield done(pa.Table.from_batches(held))
                    held, size = [], 0
                began = j
        if held:
            yield done(pa.Table.from_batches(held))

    return judge


def _by_row(d: DataFrame, name: str) -> DataFrame:
    """d as a table that is bucketed by `row` in the shared folder, so that joins by row move the texts only once."""
    spark = d.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{name}_{uuid.uuid4().hex}"
    d.repartition(n, "row").write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(n, "row").saveAsTable(name)
    return spark.table(name)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 50) -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    Removed is each byte inside a string of `least` bytes that also starts in a document with a smaller doc_id; strings are judged on the input and never
    cross documents. Rows go by doc_id and a digest of the text, so a shared or null doc_id mixes nothing. Of equal texts only those with the least doc_id are
    searched; the others lose all if they're long enough. Stretches are named by their least gram. Only grams and rows are shuffled to find which grams
    rows share; then each such stretch goes to its gram's shard, and shards of whole grams get a transform each. Stretches of grams in more than HOT rows are split by a
    second gram, and equal ones are one before they're compared. Null texts count as empty, null doc_ids as larger than all and as one
    another's equals; rows that share a doc_id and a text are equal. A text shorter than `least` loses nothing. doc_id is a number. Other columns
    are ignored; an empty table gives an empty result.
    """
    assert least >= 2 * GRAM
    kind = docs.select(F.col(f"`{doc_id}`").alias("x")).dtypes[0][1]
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    d = d.withColumns({"rank": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NEVER)), "content": F.md5("text")})
    name = lambda rank: F.xxhash64(rank, "content")
    d = _by_row(d.withColumn("row", name("rank")), "texts")
    classes = d.groupBy("content").agg(F.min("rank").alias("least"))
    firsts = saved(classes.select(name("least").alias("row"), "content", "least"), "firsts")
    own = firsts.groupBy("row").agg(F.collect_set("content").alias("own"))  # an array, so that the join stays one by row and moves no text
    searched = d.join(own, "row").where(F.array_contains("own", F.col("content"))).select("row", "rank", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            for who, g, marks, _, _ in stretches(batch.column(1), least):
                key = g << 16 | marks
                order = np.lexsort((key, who))
                who, key = who[order], key[order]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (who[1:] != who[:-1])])[: len(key)]
                yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(names[who[new]])], ["key", "row"])

    def cutter(hot: bool):
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, ranks = (batch.column(i).to_numpy() for i in (0, 1))
                offsets = _binary(batch.column(2))[1]
                text = memoryview(_binary(batch.column(2))[0])
                tags, listed = batch.column(3).flatten().to_numpy(), batch.column(3).value_lengths().to_numpy()
                ends = np.cumsum(listed)
                tags = tags ^ np.repeat(np.arange(len(listed)), listed) << 47  # a row's own; more than the tagged ones would do no harm
                for who, g, extra, first, n in stretches(batch.column(2), least, hot):
                    if not len(who):
                        continue
                    at = np.flatnonzero(np.isin(g ^ who << 47, tags[ends[who[0]] - listed[who[0]] : ends[who[-1]]]))
                    who, first, last = who[at], first[at], first[at] + n[at]
                    shard = (g[at] * 31 ^ extra[at]) if hot else g[at]
                    # Neighbours under one gram, as in text of a short period, are one stretch.
                    new = np.concatenate([[True], (shard[1:] != shard[:-1]) | (who[1:] != who[:-1]) | (first[1:] != last[:-1])])[: len(at)]
                    new = np.flatnonzero(new | np.concatenate([[True], np.diff((first - first[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]) // LONG) != 0])[: len(at)])
                    if not len(new):
                        continue
                    who, shard, first, last = who[new], shard[new], first[new], last[np.append(new[1:], len(at)) - 1]
                    a = offsets[who] + first
                    contexts = [bytes(text[i:j]) for i, j in zip(a.tolist(), (a + last - first + least - 1).tolist())]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (shard, names[who], ranks[who], first)), pa.array(contexts, pa.binary())], ["shard", "row", "rank", "first", "context"])

        tagged = searched.join(tags.where(F.col("tag") % 2 == int(hot)).groupBy("row").agg(F.collect_set(F.shiftright("tag", 1)).alias("tags")), "row")
        return tagged.select("row", "rank", "text", "tags").mapInArrow(cut, "shard long, row long, rank long, first long, context binary")

    found = "rank long, first long, n long, holder long"
    whole = lambda x, every, who: x.repartition("shard").sortWithinPartitions("shard").mapInArrow(_judge(least, every), f"who {who}, {found}")
    held = searched.select("row", "text").mapInArrow(grams, "key long, row long")
    tags = saved(held.repartition(F.shiftright("key", 16)).sortWithinPartitions("key").mapInArrow(_shared_grams, "row long, tag long"), "tags")
    cold = whole(cutter(False), False, "long").select(F.col("who").alias("row"), "rank", "first", "n")
    many = saved(cutter(True).withColumn("key", F.md5(F.concat(F.col("shard").cast("string").cast("binary"), "context"))), "stretches")
    one = many.groupBy("key", "shard").agg(F.min("rank").alias("rank"), F.first("context").alias("context"))
    judged = whole(one.select("shard", "key", "rank", F.lit(0).cast("long").alias("first"), "context"), True, "string").select("who", F.col("first").alias("after"), "n", "holder")
    hot = many.select("row", "rank", "first", "key").join(judged, F.col("key") == F.col("who")).where("holder < rank").select("row", "rank", (F.col("first") + F.col("after")).alias("first"), "n")
    copies = d.select("row", "rank", "content").join(firsts.select("content", "least"), "content").where("rank > least").select("row", "rank", F.lit(0).cast("long").alias("first"), F.lit(-1).cast("long").alias("n"))
    spans = cold.unionByName(hot).unionByName(copies.distinct()).groupBy("row").agg(F.collect_list(F.struct("rank", "first", "n")).alias("spans"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, (data, offsets) = batch.column(1).to_numpy(), _binary(batch.column(2))
            sizes, spans = np.diff(offsets), batch.column(3)
            listed = spans.value_lengths().fill_null(0).to_numpy()
            rank, first, n = (x.to_numpy() for x in spans.flatten().flatten())
            who = np.repeat(np.arange(len(sizes)), listed)
            end = np.where(n < 0, sizes[who], first + n + least - 1)
            good = (rank == ranks[who]) & (least <= end) & (end <= sizes[who])
            who, first, end = who[good], first[good], end[good]
            cols: list[list] = [[], [], []]
            for i, j in _pieces(offsets):
                edges = offsets[i : j + 1] - offsets[i] + np.arange(j - i + 1)  # one place more for each text, where a span may end
                mine = slice(*np.searchsorted(who, (i, j)))
                at = edges[who[mine] - i]
                step = np.zeros(edges[-1], np.int32)
                np.add.at(step, at + first[mine], 1)
                np.subtract.at(step, at + end[mine], 1)
                gone = np.cumsum(step, dtype=np.int32) > 0
                begins = gone & ~np.concatenate([[False], gone[:-1]])
                for c, x in zip(cols, (gone, begins)):
                    c.append(np.add.reduceat(x, edges[:-1], dtype=np.int64))
                inside = np.ones(len(gone), bool)
                inside[edges[1:] - 1] = False
                cols[2].append(data[offsets[i] : offsets[j]][~gone[inside]])
            removed, found, kept = (np.concatenate(c) if c else np.empty(0, np.int64) for c in cols)
            ends = np.concatenate([[0], np.cumsum(sizes - removed)]).astype(np.int32)
            texts = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(kept.astype(np.uint8).tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(removed), pa.array(found), texts], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return d.join(spans, "row", "left").select("doc_id", "rank", "text", "spans").mapInArrow(strip, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
