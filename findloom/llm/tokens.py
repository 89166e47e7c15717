"""Encoding with a tokenizer file of the tokenizers library, one pre-token at a time, so that each different one is merged once per task."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts made of these only are split here; the library splits and encodes all others. In these ranges all rules of the two files' patterns,
#: case and NFC are the same in Python, in Arrow and in the library.
PLAIN = "\t\n\r\x20-\x7eÀ-įı-ɏЀ-ҁҊ-ԯ‐-‧€ぁ-ゖァ-ヺ一-龥가-힣"
#: The split patterns of the two files.
SPLITS = {
    "byte_bpe": re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"),
    "word_bpe": re.compile(r"[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d|\d|(?:[^\s\w]|_)+"),
}
#: Pre-tokens that a task remembers, and the longest of them.
REMEMBERED, LONGEST = 500_000, 64


@cache
def tokenizer(path: str):
    """The library's tokenizer of a file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: White space that doesn't stand alone, or at a text's end more than once: such texts are split by the whole pattern.
RUNS = r"[\t\r]|  | \n|\n |\n\n\n|\n\n$| $"
#: Stands for the lack of a space before what follows.
BARE = "\x01"
#: Bytes of texts that are encoded at once.
CHUNK = 2 << 20


class Encoder:
    """ids of whole texts, equal to the library's encode(text, add_special_tokens=False).

    Texts are cut at white space, where pre-tokens always end; the different pieces of many texts are looked up together. The library encodes each new piece; what
    it says is remembered. In the byte files a piece has a space before it unless it starts with BARE.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.tokenizer, kind = tokenizer(path), os.path.basename(path)[:8]
        self.split, self.lower = SPLITS.get(kind), kind == "word_bpe"
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.long: list[str] = []

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """The pieces of plain texts without RUNS."""
        if self.lower:
            return pc.utf8_split_whitespace(pc.utf8_lower(texts))
        marked = pc.replace_substring(texts, "\n", f" {BARE}\n {BARE}")
        return pc.split_pattern(pc.binary_join_element_wise(pa.scalar(BARE, pa.large_string()), marked, pa.scalar("", pa.large_string())), " ")

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text (null: none) as int32 lists."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.or_(pc.match_substring_regex(texts, f"[^{PLAIN}]"), pc.match_substring(texts, "<|"))
        if not self.split:
            odd = pa.array(np.ones(len(texts), bool))
        runs = pa.array(np.zeros(len(texts), bool)) if self.lower else pc.match_substring_regex(texts, RUNS)
        odd, runs = (x.to_numpy(zero_copy_only=False) for x in (odd, runs))
        alone = {i: self._alone(texts[i].as_py(), bool(odd[i])) for i in np.flatnonzero(odd | runs).tolist()}
        flat, ends = self._together(texts if not alone else texts.filter(pa.array(~(odd | runs))))
        if alone:
            counts = np.zeros(len(texts), np.int64)
            counts[~(odd | runs)] = np.diff(ends)
            for i, ids in alone.items():
                counts[i] = len(ids)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            out = np.empty(offsets[-1], np.int32)
            own = counts[~(odd | runs)]
            out[np.repeat(offsets[:-1][~(odd | runs)] - ends[:-1], own) + np.arange(len(flat))] = flat
            for i, ids in alone.items():
                out[offsets[i] : offsets[i + 1]] = ids
            flat, ends = out, offsets
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

    def _alone(self, text: str, odd: bool) -> np.ndarray:
        """ids of one text: by the library, or by the whole pattern where only its white space is odd."""
        if odd:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        pieces = [x[1:] if x[0] == " " and x != " " else BARE + x for x in self.split.findall(text)]
        self._need(set(pieces))
        out = np.frombuffer(b"".join(map(self.ids.__getitem__, pieces)), "<i4")
        self._forget()
        return out

    def _together(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's end) of texts that can be cut."""
        cut = self._cut(texts)
        coded = cut.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._need(set(pieces))
        found = list(map(self.ids.__getitem__, pieces))
        self._forget()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        known = np.frombuffer(b"".join(found), "<i4")
        which = coded.indices.to_numpy()
        n = sizes[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = known[np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], n) + np.arange(ends[-1])]
        offsets = cut.offsets.to_numpy()
        return flat, ends[offsets - offsets[0]]

    def _forget(self) -> None:
        for w in self.long:  # used once
            self.ids.pop(w, None)
        self.long = []

    def _learn(self, pieces: set[str]) -> None:
        words, several = set(), []
        for x in pieces:
            if x.isalpha():
                words.add(x)
                continue
            own = self.split.findall(self._text(x))
            if not self.lower:
                own = [w[1:] if w[0] == " " and w != " " else BARE + w for w in own]
            if own == [x]:
                words.add(x)
            else:
                several.append((x, own))
                words.update(w for w in own if w not in self.ids)
        self._words(words)
        for x, own in several:
            self.ids[x] = b"".join(map(self.ids.__getitem__, own))

    def _text(self, piece: str) -> str:
        return piece if self.lower else piece[1:] if piece[:1] == BARE else " " + piece

    def _words(self, words: set[str]) -> None:
        """Remembers pre-tokens. Plain words are split again where they stand when they're put together, which costs less than a call for each."""
        plain = [w for w in words if w.isalpha() and len(w) <= LONGEST]
        other = list(words.difference(plain))
        joined = " ".join(plain) if self.lower else "".join([" " + w for w in plain])
        for part, got in ((plain, self.tokenizer.encode(joined, add_special_tokens=False)), (other, self.tokenizer.encode([self._text(w) for w in other], is_pretokenized=True, add_special_tokens=False))):
            counts = np.bincount(np.array(got.word_ids, np.int64), minlength=len(part))
            assert len(counts) == len(part)
            flat, at = np.array(got.ids, "<u4").tobytes(), 0
            for w, end in zip(part, (4 * np.cumsum(counts)).tolist(), strict=True):
                self.ids[w] = flat[at:end]
                at = end
        self.long += [w for w in words if len(w) > LONGEST]

    def _need(self, pieces: set[str]) -> None:
        """Has the ids of all pieces at hand. When `remembered` are held, only those used since the last time stay."""
        if len(self.ids) > self.remembered:
            self.ids, self.older = {}, self.ids
        new = pieces.difference(self.ids)
        if self.older:
            kept = {w: self.older[w] for w in new if w in self.older}
            self.ids.update(kept)
            new.difference_update(kept)
        if new:
            self.long = [w for w in new if len(w) > LONGEST]
            self._learn(new)


@cache
def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One for each worker process, so that tasks go on with what it has learnt."""
    return Encoder(path, remembered)


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """(start, slice) of a column of texts, of about `size` bytes each; a longer text stands alone."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(column)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield a, column.slice(a, b - a)
