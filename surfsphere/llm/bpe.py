"""Token ids of whole corpora by a byte-level BPE vocabulary (problem 7).

Texts are cut into words by the vocabulary's pattern. The different words of a task are merged together in
rounds over one flat array of symbols: all neighbouring pairs are looked up by binary search in the sorted
pair keys, each word takes its pair of lowest rank, and all its occurrences become one symbol.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Folder of the public vocabulary files; a parameter, the files are never copied.
FOLDER = os.environ.get("TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the published word pattern of the vocabulary, and the same for texts of ASCII only.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII = r"""'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"""
#: Different words kept by a task before it starts anew, and characters of text handled at once.
WORDS, CHARS = 1_000_000, 4_000_000
NO_RANK = np.iinfo(np.int32).max


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, others follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIndex(dict):
    """Numbers words in the order they are met; the new ones are put down in ``fresh``."""

    def __init__(self, fresh: list[str]):
        super().__init__()
        self.fresh = fresh

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = number = len(self)
        return number


class ByteBpe:
    """Encoder of one task; keeps the ids of the words it has met."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = FOLDER):
        import regex

        with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], model["merges"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.merged = key[order], order.astype(np.int32), merged
        self.first = np.zeros(256, np.int32)
        for char, byte in byte_symbols().items():
            self.first[byte] = vocab[char]
        self.any, self.ascii = regex.compile(PATTERN).findall, re.compile(ASCII).findall
        self.reset()

    def reset(self) -> None:
        self.fresh: list[str] = []
        self.index = WordIndex(self.fresh)
        self.length = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after the other; the number of ids of each)."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), n)
        done_sym, done_word = [], []
        while len(sym):
            pair = sym[:-1].astype(np.int64) << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
            known = (self.key[at] == pair) & (word[:-1] == word[1:])
            rank = np.append(np.where(known, self.rank[at], NO_RANK), NO_RANK).astype(np.int32)
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, begin)
            best = np.repeat(best, np.diff(np.append(begin, len(word))))
            over = best == NO_RANK
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                if over.all():
                    break
                going = ~over
                sym, word, rank, best = sym[going], word[going], rank[going], best[going]
            hit = rank == best
            # Of pairs that overlap, as in a run of one symbol, every other one counts from the left.
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
            hit &= (place - run) % 2 == 0
            sym = np.where(hit, self.merged[np.minimum(rank, len(self.merged) - 1)], sym)
            keep = ~np.append(False, hit[:-1])
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.zeros(0, np.int32), n
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def words_of(self, text: str) -> list[str]:
        return self.ascii(text) if text.isascii() else self.any(text)

    def _learn(self) -> None:
        if self.fresh:
            ids, n = self.merge([w.encode("utf-8", "surrogatepass") for w in self.fresh])
            self.length = np.concatenate([self.length, n.astype(np.int32)])
            self.ids = np.concatenate([self.ids, ids])
            self.start = np.concatenate([[0], np.cumsum(self.length[:-1], dtype=np.int64)])
            self.fresh.clear()

    def lookup(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(index of every word of all texts, the number of words of each text)."""
        if len(self.index) > WORDS:
            self.reset()
        get, at, counts = self.index.__getitem__, [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                words = self.words_of(text)
                counts[i] = len(words)
                at.append(np.fromiter(map(get, words), np.int64, len(words)))
        self._learn()
        return np.concatenate(at) if at else np.zeros(0, np.int64), counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, the number of ids of each); a null or empty text has none."""
        at, words = self.lookup(texts)
        n = self.length[at].astype(np.int64)
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.start[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        text_ends = np.append(0, ends)[np.cumsum(words)]
        return ids, np.diff(np.append(0, text_ends))

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        at, words = self.lookup(texts)
        ends = np.append(0, np.cumsum(self.length[at], dtype=np.int64))
        return np.diff(np.append(0, ends[np.cumsum(words)]))


def slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of a batch of some CHARS bytes each, so that memory doesn't follow the batch's size."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + CHARS)))
        yield at, texts.slice(at, to - at).to_pylist()
        at = to


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """key, ids: the token ids of each row's whole text, without special tokens.

    Null and empty texts have an empty list, blank ones the ids of their spaces. Repeated rows stay
    repeated, an empty table gives none, and other columns are ignored. Texts of any length are encoded
    whole. There is no shuffle: each task encodes its part of the scan.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(name, folder)
        for b in batches:
            for at, texts in slices(b[1]):
                ids, n = bpe.encode(texts)
                offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b[0].slice(at, len(texts)), pa.ListArray.from_arrays(offsets, pa.array(ids))], [key, "ids"])

    return df.select(key, text).mapInArrow(kernel, f"{key} {dict(df.dtypes)[key]}, ids array<int>")


def count_tokens(df: DataFrame, text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """The input's other columns with ``n_tokens``, the number of ids of the whole text."""
    rest = [c for c in df.columns if c != text]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c != text), "n_tokens bigint"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(name, folder)
        for b in batches:
            n = [bpe.count(texts) for _, texts in slices(b[text])]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in rest), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], [*rest, "n_tokens"])

    return df.select(*rest, text).mapInArrow(kernel, schema)
