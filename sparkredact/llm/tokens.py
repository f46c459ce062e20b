"""Token ids of whole texts with the tokenizers library, at the cost of their distinct words.

A byte-level BPE with the usual split pattern never joins what stands before a single space with the
space and what follows, so a text may be cut in front of its spaces and the parts encoded once each.
The exceptions are a space inside a longer run of white space and the strings of added tokens, such as
``<|endoftext|>``, which are tokens of their own; texts with either are encoded whole.
Parts are kept in a cache of bounded size. Those of at most 15 bytes are looked up all at once, by their
bytes and length as two integers, and no strings are made of them. Unknown parts are cut by the split pattern
into words, and unknown words go to the library's model in groups, as they are rarer than unknown parts.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain, islice

import numpy as np

CACHE_PARTS = 200_000
BATCH_CHARS = 1_000_000
#: Words that go to the model at once.
GROUP = 100
#: Bytes of a part that two integers hold beside its length.
KEY_BYTES = 15
#: The split pattern of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space that white space precedes and white space or the end follows.
UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: White space and a space, which every text has that ``UNSAFE`` matches; searching for them is cheaper.
PAIRS = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]
ASCII_PAIRS = [p for p in PAIRS if p.isascii()]


class _Words(dict):
    """Number of each word; unknown ones get the next number and wait in ``pending``."""

    def __init__(self) -> None:
        self.pending: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.pending.append(word)
        return n


#: What of a little-endian integer the first bytes are.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def short_keys(data: bytes, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two integers for each slice of ``data``, equal for slices of at most ``KEY_BYTES`` bytes only where these are equal."""
    ints = np.frombuffer(data + bytes(24 - len(data) % 8), dtype="<u8").astype(np.uint64, copy=False)
    at, by = starts >> 3, ((starts & 7) << 3).astype(np.uint64)
    rest, one = np.uint64(63) - by, np.uint64(1)
    first, middle, last = ints[at], ints[at + 1], ints[at + 2]
    lo = (first >> by | middle << one << rest) & _FIRST[np.minimum(lens, 8)]
    hi = (middle >> by | last << one << rest) & _FIRST[np.clip(lens - 8, 0, 7)]
    return lo, hi | np.minimum(lens, KEY_BYTES + 1).astype(np.uint64) << np.uint64(56)


class _Table:
    """Numbers below ``size`` of keys of two integers: a hash table with open addressing, at most half full."""

    def __init__(self, size: int) -> None:
        bits = (2 * size).bit_length()
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        self.lo, self.hi = np.zeros(max(1, size), np.uint64), np.zeros(max(1, size), np.uint64)  # by number

    def _home(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        mixed = lo * np.uint64(0x9E3779B97F4A7C15) + hi * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> self.shift).astype(np.int64)

    def find(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The keys' numbers; -1 for those that are not there."""
        at = self._home(lo, hi)
        out = self.slots[at]
        left = np.flatnonzero((out >= 0) & ((self.lo[out] != lo) | (self.hi[out] != hi)))
        while len(left):
            at[left] = at[left] + 1 & self.last
            out[left] = found = self.slots[at[left]]
            left = left[(found >= 0) & ((self.lo[found] != lo[left]) | (self.hi[found] != hi[left]))]
        return out

    def add(self, numbers: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Keys that differ and are not there yet, by numbers of their own."""
        self.lo[numbers], self.hi[numbers] = lo, hi
        at = self._home(lo, hi)
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]
            lost = self.slots[at] != numbers
            numbers, at = numbers[lost], at[lost] + 1 & self.last


class _Store:
    """Id lists by number, one after the other, in arrays that grow by doubling."""

    def __init__(self) -> None:
        self.n = 0
        self.ends, self.flat = np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.uint32)  # ends[i]: where list i starts

    def add(self, lens: np.ndarray, flat: np.ndarray) -> None:
        n, at = self.n + len(lens), self.ends[self.n]
        while len(self.ends) <= n:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(self.flat) < at + len(flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.ends[self.n + 1 : n + 1] = at + np.cumsum(lens)
        self.flat[at : at + len(flat)] = flat
        self.n = n

    def cut(self, n: int) -> None:
        self.n = n

    def gather(self, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the lists numbered ``idx`` and their ids in a row."""
        starts = self.ends[idx]
        lens = self.ends[idx + 1] - starts
        ends = np.cumsum(lens)
        return lens, self.flat[np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]


def byte_alphabet() -> dict[int, str]:
    """The printable character by which byte-level BPE writes each byte: itself where it is visible in Latin-1, else the next one from 256 up."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class TextEncoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, cache_parts: int = CACHE_PARTS):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # a normalised text may hold an added token that the text itself doesn't, so then all texts are encoded whole
        self.added = [""] if self.tokenizer.normalizer is not None else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word = Tokenizer(self.tokenizer.model)
        self.by_word.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        # every token stands for as many bytes as it has characters
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.token_bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        self.token_bytes[list(vocab.values())] = list(map(len, vocab))
        self.split = regex.compile(SPLIT).findall
        self.limit, self.alphabet = cache_parts, byte_alphabet()
        self.short, self.long, self.part_ids = _Table(cache_parts), {}, _Store()
        self.words, self.word_ids = _Words(), _Store()

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn_words(self) -> None:
        new, self.words.pending = self.words.pending, []
        odd = [i for i, w in enumerate(new) if "\n" in w]
        for i in odd:
            new[i], odd[odd.index(i)] = "x", (i, new[i])
        if not new:
            return
        rows = ["\n".join(new[at : at + GROUP]).encode() for at in range(0, len(new), GROUP)]
        flat = [np.array(e.ids, dtype=np.uint32) for e in self.by_word.encode_batch_fast([r.decode("latin-1").translate(self.alphabet).replace(self.alphabet[10], "\n") for r in rows], add_special_tokens=False)]
        # a word ends with a token, so the tokens' bytes tell where
        flat, ends = np.concatenate(flat), np.flatnonzero(np.frombuffer(b"\n".join([*rows, b""]), dtype=np.uint8) == 10)
        lens = np.diff(np.searchsorted(np.cumsum(self.token_bytes[flat]), ends - np.arange(len(ends))), prepend=-1)
        if odd:
            each = np.split(flat, np.cumsum(lens)[:-1])
            for i, w in odd:
                each[i] = self._plain(w)
                lens[i] = len(each[i])
            flat = np.concatenate(each)
        self.word_ids.add(lens, flat)

    def _by_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        idx = np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))
        self._learn_words()
        return self.word_ids.gather(idx)

    def _by_split(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each part with a space before it, and these ids in a row."""
        row = f" {b' '.join(parts).decode()} "
        words, starts = [], []
        # without empty parts and white space at a part's end each begins with a word that starts with a space, and no other does
        if not any(p in row or p[::-1] in row for p in (ASCII_PAIRS if row.isascii() else PAIRS)):
            words = self.split(row[:-1])
            starts = np.array([i for i, w in enumerate(words) if w[0] == " "])
        if len(starts) != len(parts):
            each = [self.split(" " + p.decode()) for p in parts]
            words = list(chain.from_iterable(each))
            starts = np.cumsum([0, *map(len, each)])[:-1]
        lens, flat = self._by_words(words)
        return np.add.reduceat(lens, starts), flat

    def _by_parts(self, data: bytes, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for slices of ``data`` that stand between spaces; what the cache has no room for is forgotten afterwards."""
        lo, hi = short_keys(data, starts, lens)
        idx = self.short.find(lo, hi).astype(np.int64)
        cut = lambda which: [data[a:b] for a, b in zip(starts[which].tolist(), (starts + lens)[which].tolist(), strict=True)]
        far = np.flatnonzero(lens > KEY_BYTES)
        far_parts = cut(far)
        idx[far] = [self.long.get(p, -1) for p in far_parts]
        new = np.flatnonzero((idx < 0) & (lens <= KEY_BYTES))
        new = new[np.lexsort((lo[new], hi[new]))]
        first = np.append(True, (lo[new][1:] != lo[new][:-1]) | (hi[new][1:] != hi[new][:-1]))[: len(new)]
        known, one = self.part_ids.n, new[first]
        idx[new] = known + np.cumsum(first) - 1
        new_far: dict[bytes, int] = {}
        for i, p in zip(far.tolist(), far_parts, strict=True):
            if idx[i] < 0:
                idx[i] = new_far.setdefault(p, known + len(one) + len(new_far))
        if len(one) or new_far:
            self.part_ids.add(*self._by_split([*cut(one), *new_far]))
            one = one[: max(0, self.limit - known)]
            self.short.add(np.arange(known, known + len(one)), lo[one], hi[one])
            self.long |= {p: n for p, n in new_far.items() if n < self.limit}
        found = self.part_ids.gather(idx)
        self.part_ids.cut(min(self.part_ids.n, self.limit))
        return found

    def _forget(self) -> None:
        """Back to the words that came first, once a batch has brought more than the cache holds."""
        if len(self.words) > self.limit:
            for k in list(islice(reversed(self.words), len(self.words) - self.limit)):
                del self.words[k]
            self.word_ids.cut(self.limit)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= BATCH_CHARS):
                chars += len(texts[end])
                end += 1
            out += self._batch(texts[at:end])
            at = end
        return out

    def _is_whole(self, text: str) -> bool:
        spaced = any(p in text for p in (ASCII_PAIRS if text.isascii() else PAIRS))
        return spaced and UNSAFE.search(text) is not None or any(a in text for a in self.added)

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        whole = {i: self._plain(t) for i, t in enumerate(texts) if self._is_whole(t)}
        rows = [b"" if i in whole else t.encode() for i, t in enumerate(texts)]
        data = b" ".join(rows)
        spaces = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32)
        starts, ends = np.append(0, spaces + 1), np.append(spaces, len(data))
        first = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in rows[:-1])]))  # of each text
        heads = [self.split(data[a:b].decode()) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        head_lens, head_ids = self._by_words(list(chain.from_iterable(heads)))
        lens, ids = self._by_parts(data, np.delete(starts, first), np.delete(ends - starts, first))
        bounds = lambda own, n: np.concatenate([[0], np.cumsum(own)])[np.cumsum([0, *n])]
        head_at, at = bounds(head_lens, map(len, heads)), bounds(lens, np.diff(first, append=len(starts)) - 1)
        self._forget()
        return [whole[i] if i in whole else np.concatenate([head_ids[head_at[i] : head_at[i + 1]], ids[at[i] : at[i + 1]]]) for i in range(len(texts))]


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder for each worker process, which has one core: the library's threads would take memory, and time to wait."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return TextEncoder(path)


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))


def encode_column(texts: Iterable[str | None], path: str, end_id: int) -> list[np.ndarray]:
    """Ids of each text (null: none) with ``end_id`` appended."""
    end = np.array([end_id], dtype=np.uint32)
    return [np.concatenate([x, end]) for x in encoder(path).encode([t or "" for t in texts])]
