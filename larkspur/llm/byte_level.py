"""Ids of whole Arrow columns of texts by a byte-level file of the ``tokenizers`` library.

The library splits texts for such a file by
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Where its matches begin follows
from the classes of neighbouring characters, so the matches of a column are found at once, on its
bytes. The class of a character is asked of the library when it first occurs. Each different match is
merged by the library's own model once, and remembered from column to column within a bound of bytes.
A file that is not of this kind is found out, and then the library encodes each text as a whole.
"""

from __future__ import annotations

import os
from itertools import pairwise

import numpy as np
import pyarrow as pa

#: Bytes of the matches that are remembered, with their ids.
CACHE_BYTES = 8 << 20
#: Bytes of matches that the library gets as one string.
RUN_BYTES = 16 << 10
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4  # classes of characters; 0 is not known yet


class ByteLevelEncoder:
    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer, self.cache_bytes = Tokenizer.from_file(path), cache_bytes
        self.tokenizer.encode_special_tokens = True
        whole, split, model = self.tokenizer, self.tokenizer.pre_tokenizer, self.tokenizer.model
        vocabulary = whole.get_vocab(with_added_tokens=False)
        chars = byte_chars()
        self.splits = (
            isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space
            and isinstance(model, models.BPE) and not model.dropout and not model.continuing_subword_prefix and not model.end_of_word_suffix
            and whole.normalizer is whole.truncation is whole.padding is None
            and all(t.special for t in whole.get_added_tokens_decoder().values()) and vocabulary.keys() >= set(chars)
        )
        if self.splits:
            self.merger = Tokenizer(model)
            self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.chars = np.array([ord(c) for c in chars], "<u2")
            self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int32)  # bytes of each token
            self.sizes[list(vocabulary.values())] = [len(t) for t in vocabulary]
            self.kinds = np.zeros(0x110000, np.uint8)
            self.kinds[:128] = [self.kind_of(chr(c)) for c in range(128)]
            self.forget()

    def forget(self) -> None:
        self.words, self.ids, self.counts = pa.array([], pa.binary()), np.zeros(0, "<u4"), np.zeros(0, np.int32)

    def held(self) -> int:
        return self.words.nbytes + self.ids.nbytes + self.counts.nbytes

    def kind_of(self, char: str) -> int:
        """The class of a character: it is matched as one with a character of its own class before it."""
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        return next((kind for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, ".")) if len(split(before + char)) == 1), SPACE)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        ids, stops = self.encode_column(pa.array(texts, pa.large_string()))
        data = ids.tobytes()
        return [data[a:b] for a, b in pairwise([0, *(4 * stops).tolist()])]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's end; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.splits:
            made = [np.array(self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, "<u4") for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, "<u4"), *made]), np.cumsum([len(x) for x in made], dtype=np.int64)
        texts.validate(full=True)
        data, offsets = flat(texts, np.int64)
        begins = self.matches(data, offsets)
        index = self.look_up(pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(data)]))
        counts = self.counts[index]
        ends = np.append(0, np.cumsum(counts, dtype=np.int64))
        at = np.repeat((np.cumsum(self.counts, dtype=np.int64) - self.counts)[index] - ends[:-1], counts)
        at += np.arange(ends[-1])
        ids, stops = self.ids[at], ends[np.searchsorted(begins, offsets[1:])]
        self.bound(index)
        return ids, stops

    def classes(self, data: np.ndarray) -> np.ndarray:
        """The class of the character that each byte of UTF-8 belongs to."""
        kinds = self.kinds[:256][data]
        lead = np.flatnonzero(data >= 0xC0)
        size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        code = data[lead] & (0x7F >> size)
        code = code.astype(np.int32)
        for k in (1, 2, 3):
            more = size > k
            code[more] = code[more] << 6 | data[lead[more] + k] & 0x3F
        for c in np.unique(code[self.kinds[code] == 0]).tolist():
            self.kinds[c] = self.kind_of(chr(c))
        kind = self.kinds[code]
        for k in range(4):
            more = size > k
            kinds[lead[more] + k] = kind[more]
        return kinds

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the matches of the pattern begin in texts that lie one after the other, and where the last one ends."""
        n = len(data)
        data, kinds = np.append(data, np.zeros(3, np.uint8)), np.append(self.classes(data), np.zeros(3, np.uint8))
        text = np.zeros(n + 3, bool)  # where a text begins
        text[offsets] = text[n:] = True
        begins = text.copy()
        begins[1:] |= kinds[1:] != kinds[:-1]
        # the last white space before something else stands apart from what is before it; a space goes with what follows it
        after = np.flatnonzero(begins[1:] & ~text[1:] & (kinds[:-1] == SPACE)) + 1
        last = after - 1
        for _ in range(3):
            last -= data[last] & 0xC0 == 0x80
        begins[last] = True
        begins[after[data[after - 1] == 32]] = False
        quote = np.flatnonzero(begins & (data == 39))
        a, b = data[quote + 1], data[quote + 2]
        inside = ~text[quote + 1]
        one = quote[inside & np.isin(a, list(b"stmd"))]
        two = quote[inside & ~text[quote + 2] & (((b == 101) & ((a == 114) | (a == 118))) | ((a == 108) & (b == 108)))]
        begins[one + 1] = begins[two + 1] = False
        begins[one + 2] = begins[two + 3] = True
        return np.flatnonzero(begins[: n + 1]).astype(np.int32)

    def look_up(self, words: pa.Array) -> np.ndarray:
        """The numbers of the words among those that are remembered, to which new ones are added."""
        if not len(words):
            return np.zeros(0, np.int32)
        known = len(self.words)
        coded = pa.chunked_array([self.words, words]).dictionary_encode().chunks[-1]  # an empty chunk goes away
        self.words = coded.dictionary
        if len(self.words) > known:
            ids, counts = self.merge(self.words[known:])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        return coded.indices.to_numpy()

    def merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has."""
        data, offsets = flat(words, np.int32)
        spaced = np.insert(self.chars[data], offsets[:-1], ord(" ")).tobytes().decode("utf-16-le")
        firsts = np.unique(np.searchsorted(offsets, np.arange(0, len(data), RUN_BYTES)))  # the first word of each run
        cuts = np.append(offsets[firsts] + firsts, len(spaced)).tolist()
        made = (self.merger.encode_batch_fast([spaced[a:b]], add_special_tokens=False)[0] for a, b in pairwise(cuts))
        ids = np.concatenate([np.array(e.ids, "<u4") for e in made])
        stops = np.searchsorted(np.cumsum(self.sizes[ids], dtype=np.int64), offsets[1:]) + 1  # a word's tokens have its bytes
        return ids, np.diff(stops, prepend=0).astype(np.int32)

    def bound(self, used: np.ndarray) -> None:
        """When too much is remembered, only the words of the last column are kept, if they are few enough."""
        if self.held() > self.cache_bytes:
            keep = np.zeros(len(self.words), bool)
            keep[used] = True
            self.words, self.ids, self.counts = self.words.filter(pa.array(keep)), self.ids[np.repeat(keep, self.counts)], self.counts[keep]
            if self.held() > self.cache_bytes:
                self.forget()


def flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings or binaries with offsets of the type ``kind``, and the offsets in them."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_chars() -> list[str]:
    """The character by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]
