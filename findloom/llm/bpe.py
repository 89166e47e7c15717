"""BPE encoding and decoding; long texts are encoded in pieces that are joined as a tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findloom.llm.common import fresh, saved, table, without
from findloom.llm.tokens import chunks, encoder, tokenizer

#: Texts of more characters than this are encoded in pieces of so many.
PIECE = 1 << 16
#: Pre-tokens that a worker remembers; the workers that decode need room beside it.
REMEMBERED = 250_000
#: Characters on either side of a join that are encoded anew at first.
FIRST_WINDOW = 64


def _offsets(path: str, text: str) -> tuple[list[int], list[tuple[int, int]]]:
    got = tokenizer(path).encode(text, add_special_tokens=False)
    return got.ids, got.offsets


def join(path: str, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray, first: int = FIRST_WINDOW) -> np.ndarray:
    """ids of left + right from those of both sides.

    A window around the join starts and ends at white space and is encoded anew, as are its own halves within left and right. When
    the window begins with what left ends with, up to a token before the join, and ends with what right begins with, from
    a token after the join, the rest of either side can't change and the middle is replaced. Otherwise it grows; a window over all of both is exact.
    Where all of a window is one run of letters, or of digits, it may start and end inside it (see join_inside).
    """
    size = first
    while True:
        if (ids := join_inside(path, left, left_ids, right, right_ids, size)) is not None:
            return ids
        a, b = _space_before(left, len(left) - size), _space_after(right, size)
        whole = a == 0 and b == len(right)
        ids, spans = _offsets(path, left[a:] + right[:b])
        if whole:
            return np.array(ids, np.int32)
        tail, tail_spans = _offsets(path, left[a:])
        head, head_spans = _offsets(path, right[:b])
        cut = len(left) - a
        same_left = sum(1 for _ in _agree(zip(ids, spans), zip(tail, tail_spans), lambda s: s[1] < cut))
        shifted = [(i, (s + cut, e + cut)) for i, (s, e) in zip(head, head_spans)]
        same_right = sum(1 for _ in _agree(zip(reversed(ids), reversed(spans)), reversed(shifted), lambda s: s[0] > cut))
        sides = (a == 0 or (same_left and np.array_equal(left_ids[max(0, len(left_ids) - len(tail)) :], tail))) and (b == len(right) or (same_right and np.array_equal(right_ids[: len(head)], head)))
        if sides and same_left + same_right <= len(ids):
            return np.concatenate([left_ids[: len(left_ids) - len(tail)], ids, right_ids[len(head) :]]).astype(np.int32)
        size *= 2


def join_inside(path: str, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray, size: int) -> np.ndarray | None:
    """join within one run of ASCII letters or digits that has no white space near; None where the window's sides don't agree.

    In a run a list of tokens is what the whole run gives when each two neighbours are what their own text gives. So one token that the window shares with left,
    and a later one that it shares with right, carry both sides' proofs over the join. Tokens at the edges that a cut made are passed over.
    """
    tail, head = left[-size:], right[:size]
    run = tail + head
    if len(tail) < size or len(head) < size or not (run.isascii() and (run.isalpha() or run.isdigit())):
        return None
    (t_ids, t_spans), (h_ids, h_spans), (ids, spans) = (_offsets(path, x) for x in (tail, head, run))
    at = dict(zip(spans, range(len(ids))))
    same_tail = _same(reversed(t_ids), left_ids[-len(t_ids) :][::-1].tolist())
    same_head = _same(h_ids, right_ids[: len(h_ids)].tolist())
    for i in range(max(1, len(t_ids) - same_tail + 1), len(t_ids) - 1):
        k = at.get(t_spans[i])
        if k is None or ids[k] != t_ids[i]:
            continue
        for j in range(1, same_head - 1):
            m = at.get((h_spans[j][0] + size, h_spans[j][1] + size))
            if m is not None and m > k and ids[m] == h_ids[j]:
                return np.concatenate([left_ids[: len(left_ids) - (len(t_ids) - i)], ids[k:m], right_ids[j:]]).astype(np.int32)
        return None
    return None


def _same(a, b) -> int:
    """How many items two sequences share from their start."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            return n
        n += 1
    return n


def _agree(a, b, inside) -> Iterator[int]:
    for (i, s), (j, t) in zip(a, b):
        if i != j or s != t or not inside(s):
            return
        yield i


def _space_before(text: str, at: int) -> int:
    """The last place up to `at` of a plain space between two letters or digits, or 0."""
    while at > 0 and not _cut(text, at):
        at -= 1
    return max(at, 0)


def _space_after(text: str, at: int) -> int:
    while at < len(text) and not _cut(text, at):
        at += 1
    return min(at, len(text))


def _cut(text: str, at: int) -> bool:
    return text[at] == " " and 0 < at < len(text) - 1 and all(c.isascii() and c.isalnum() for c in (text[at - 1], text[at + 1]))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", piece: int = PIECE) -> DataFrame:
    """docs with `ids`, equal to the tokenizers library's encode of each whole text (null and empty: no ids).

    Texts of up to `piece` characters are encoded where they are. Longer ones, each different text once, are cut into pieces that are dealt out and encoded
    in parallel; neighbours are then joined two by two, one shuffle a level, so 2**k pieces take k levels. Repeated rows share one
    result; an empty table gives an empty one; other columns pass through and an input column named as `ids` is replaced.
    """
    own = fresh(docs, "text")
    d = without(docs.withColumn(own, F.col(f"`{text}`").cast("string")), *([ids] if ids.lower() != text.lower() else []))
    short, long = _by_length(d, piece, own)

    def whole(texts: pa.Array) -> pa.Array:
        out = [encoder(path, REMEMBERED).encode(part) for _, part in chunks(texts)]
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

    short = short.withColumn(ids, F.arrow_udf(whole, T.ArrayType(T.IntegerType()))(own))
    return short.unionByName(_tree(long, path, ids, piece, own)).drop(own)


def _by_length(d: DataFrame, piece: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows whose texts are encoded where they are, and the others."""
    long = F.coalesce(F.length(text), F.lit(0)) > piece
    return d.where(~long), d.where(long)


def _tree(long: DataFrame, path: str, ids: str, piece: int, text: str = "text") -> DataFrame:
    """Long rows with `ids`, from pieces joined two by two until a text has one."""
    key = fresh(long, "key")
    long = long.withColumn(key, F.sha2(text, 256))
    different = long.select(F.col(key).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    last = F.floor((F.length("text") - 1) / piece).cast("int")
    cut = different.select("key", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("at"), "text")
    cut = cut.select("key", "at", "last", F.expr(f"substring(text, at * {piece} + 1, {piece})").alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, REMEMBERED).encode
        for batch in batches:
            for at, part in chunks(batch.column(3)):
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(part)).columns, encode(part)], [*batch.schema.names, "ids"])

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []

        def told() -> pa.RecordBatch:
            keys, places, lasts, texts, ids = zip(*out)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(places, pa.int32()), pa.array(lasts, pa.int32()), pa.array(texts), lists], ["key", "at", "last", "text", "ids"])

        for batch in batches:
            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
                ids = batch.column(4)[i].values.to_numpy()
                key, at, last, text = row
                if held and held[0] == key and held[1] == at - 1 and at % 2:
                    out.append((key, at // 2, last // 2, held[3] + text, join(path, held[3], held[4], text, ids)))
                    held = None
                else:
                    if held:
                        out.append((held[0], held[1] // 2, held[2] // 2, *held[3:]))
                    held = (*row, ids)
                if len(out) >= 64:
                    yield told()
        if held:
            out.append((held[0], held[1] // 2, held[2] // 2, *held[3:]))
        if out:
            yield told()

    shape = "key string, at int, last int, text string, ids array<int>"
    tree = saved(cut.repartition("key", "at").mapInArrow(encoded, shape), "pieces")
    levels = int(tree.agg(F.max("last")).first()[0] or 0).bit_length()
    for _ in range(levels):
        tree = tree.repartition("key", F.floor(F.col("at") / 2)).sortWithinPartitions("key", "at").mapInArrow(paired, shape)
    return long.join(tree.select(F.col("key").alias(key), F.col("ids").alias(ids)), key).drop(key)


@cache
def pieces(path: str) -> pa.Array | None:
    """The text of each id where a file has no decoder (decode() then puts a space between tokens); None where it has one."""
    t = tokenizer(path)
    return None if t.decoder is not None else pa.array([t.id_to_token(i) or "" for i in range(t.get_vocab_size())])


def _joined(words: pa.Array, ids: pa.ListArray) -> pa.Array:
    """The words of each list of ids with a space between two."""
    flat = words.take(ids.flatten())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))]), pa.int32()), flat), " ")


def _decoded(path: str, ids: pa.ListArray) -> pa.Array:
    words = pieces(path)
    if words is not None:
        return _joined(words, ids)
    return pa.array(tokenizer(path).decode_batch([x or [] for x in ids.to_pylist()], skip_special_tokens=False), pa.string())


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with `text`, the library's decode of each list of ids with special tokens kept (null and empty: an empty text). An input column named as `text` is replaced."""
    def texts(lists: pa.Array) -> pa.Array:
        parts = [_decoded(path, lists[at : at + 256]) for at in range(0, len(lists), 256)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return docs.withColumn(text, F.arrow_udf(texts, T.StringType())(ids))


@cache
def _numbers(size: int) -> pa.Array:
    return pa.array(range(size)).cast(pa.string())


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", piece: int = PIECE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids with a space between two), decoded_sha256 of each row. Texts are encoded, decoded and digested in one
    pass, long ones as in encode()."""
    kind = docs.select(F.col(f"`{doc_id}`").alias("doc_id")).dtypes[0][1]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def told(keys: pa.Array, ids: pa.ListArray) -> pa.RecordBatch:
        numbers = _joined(_numbers(tokenizer(path).get_vocab_size()), ids)
        shas = [pa.array([hashlib.sha256(x.as_buffer() if x.is_valid else b"").hexdigest() for x in text.cast(pa.binary())]) for text in (numbers, _decoded(path, ids))]
        return pa.RecordBatch.from_arrays([keys, pc.fill_null(pc.list_value_length(ids), 0).cast(pa.int64()), *shas], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, REMEMBERED).encode
        for batch in batches:
            for at, part in chunks(batch.column(1)):
                yield told(batch.column(0).slice(at, len(part)), encode(part))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield told(batch.column(0).slice(at, 64), batch.column(1).slice(at, 64))

    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col("text").cast("string").alias("text"))
    short, long = _by_length(d, piece)
    out = short.mapInArrow(whole, schema)
    return out.unionByName(_tree(long, path, "ids", piece).select("doc_id", "ids").mapInArrow(listed, schema))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
