"""Encoding of texts chunk by chunk, with a cache that is bounded in bytes.

The split pattern of common byte-level vocabularies never lets a match run past a space that stands
between two characters that aren't white space, and that space opens the next match. Texts are
therefore cut at single spaces, and each chunk is encoded with the space before it. A text in which
white space meets a space is encoded as a whole. A pattern that doesn't treat such spaces so is found
out by :func:`cuts_at_spaces`, and then every text is encoded as a whole.

Texts are encoded in groups of a bounded number of characters, and chunks are remembered from group to
group; the bytes of all that is remembered are counted as it is added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from string import punctuation

#: Bytes that a cache may hold, with OVERHEAD for each entry.
CACHE_BYTES = 96 << 20
OVERHEAD = 200
#: Characters of the texts that are encoded at once; a longer text is a group of its own.
GROUP_CHARS = 8 << 20
#: Longer chunks and pre-tokens are not remembered.
LONG = 64


class ByteCache:
    """Packed ids by string, in two generations that count their bytes.

    When the younger one would exceed half of ``most`` it becomes the older one, and what the older one
    held is forgotten, but for what was looked up since: that has moved to the younger one.
    """

    def __init__(self, most: int = CACHE_BYTES):
        self.most, self.held = most, 0
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def remember(self, key: str, ids: bytes | None) -> None:
        size = OVERHEAD + 2 * len(key) + len(ids or b"")
        if self.held + size > self.most // 2:
            self.young, self.old, self.held = {}, self.young, 0
        self.young[key] = ids
        self.held += size

    def known(self, keys: Iterable[str]) -> dict[str, bytes | None]:
        """The ids of the keys that are remembered."""
        young, old = self.young, self.old
        found = {k: young[k] for k in keys if k in young}
        if old:
            again = {k: old[k] for k in keys if k in old and k not in found}
            for k, ids in again.items():
                self.remember(k, ids)
            found.update(again)
        return found


def cuts_at_spaces(find: Callable[[str], list[str]]) -> bool:
    """Whether the pattern splits before a single space between any two of some characters of each kind."""
    kinds = ["a", "Z", "é", "漢", "ß", "1", "٣", "²", ".", "'", "-", "(", "_", "€", "😀", "́", "’", "'s", "can't", "1,2", "a1", "\x00"]
    return all(find(f"{x} {y}") == find(x) + find(f" {y}") for x in kinds for y in kinds)


def groups(texts: list[str | None], most_chars: int = GROUP_CHARS) -> Iterator[list[str | None]]:
    group, held = [], 0
    for text in texts:
        size = len(text or "")
        if group and held + size > most_chars:
            yield group
            group, held = [], 0
        group.append(text)
        held += size
    if group:
        yield group


class ChunkEncoder:
    cut = True  # whether the pattern lets texts be cut at single spaces
    group_chars = GROUP_CHARS

    def __init__(self, cache_bytes: int = CACHE_BYTES) -> None:
        self.chunks = ByteCache(cache_bytes)  # what stands after a space -> packed ids of the space and it

    def encode_each(self, strings: list[str]) -> list[bytes]:
        """Packed ids of each string, without any cut at spaces."""
        raise NotImplementedError

    def learn(self, chunks: list[str]) -> dict[str, bytes | None]:
        """The ids of chunks, each after a space; None where white space meets the space.

        Punctuation after a letter opens a match of its own, so a word is encoded once with all that
        may follow it.
        """
        made: dict[str, bytes | None] = {}
        split, words, tails = [], set(), set()
        for chunk in chunks:
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                made[chunk] = None
            else:
                word = chunk.rstrip(punctuation)
                if not word or not word[-1].isalpha():
                    word = chunk
                split.append((chunk, word, chunk[len(word) :]))
                words.add(word)
                tails.add(split[-1][2])
        stem = {w: ids for w, ids in self.chunks.known(words).items() if ids is not None}
        new, ends = list(words.difference(stem)), list(tails)
        ids = self.encode_each([" " + w for w in new] + ends)
        stem.update(zip(new, ids, strict=False))
        end = dict(zip(ends, ids[len(new) :], strict=True))
        made.update((chunk, stem[word] + end[tail] if tail else stem[word]) for chunk, word, tail in split)
        return made

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        if not self.cut:
            return [x for group in groups(texts, self.group_chars) for x in self.encode_each([t or "" for t in group])]
        return [x for group in groups(texts, self.group_chars) for x in self.encode_group(group)]

    def encode_group(self, texts: list[str | None]) -> list[bytes]:
        different: set[str] = set()
        for text in texts:
            if text:
                different.update(text.split(" ")[1:])
        ids_of = self.chunks.known(different)
        made = self.learn(list(different.difference(ids_of)))
        ids_of.update(made)
        out: list[bytes] = []
        first: list[tuple[int, str]] = []  # what is still to be encoded as a whole, and put before the rest
        for text in texts:
            start, *rest = text.split(" ") if text else [""]
            try:
                ids = b"".join(map(ids_of.__getitem__, rest))
                if start[-1:].isspace():
                    start, ids = text, b""
            except TypeError:  # a chunk without ids of its own
                start, ids = text, b""
            if start:
                first.append((len(out), start))
            out.append(ids)
        for (k, _), ids in zip(first, self.encode_each([x for _, x in first]), strict=True):
            out[k] = ids + out[k]
        for chunk, ids in made.items():
            if len(chunk) <= LONG:
                self.chunks.remember(chunk, ids)
        return out
