"""Ids of words, each different word encoded once per Python worker while it stays in use."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from tracewell.llm.text import Rolling, gather


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array with room for `size` values at least."""
    return array if size <= len(array) else np.resize(array, max(size, 2 * len(array)))


class Words:
    """Words as stretches of one byte buffer, with a hash of each."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
        self.first, self.length = offs[:-1] - offs[0], np.diff(offs)
        self.hash = Rolling(self.data)(self.first, self.first + self.length)

    def list(self, at: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a : a + n] for a, n in zip(self.first[at].tolist(), self.length[at].tolist())]


class Generation:
    """Words with their ids, found by hash and compared by their bytes."""

    def __init__(self):
        self.hash, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.n = self.text_used = self.ids_used = 0
        self.text, self.ids = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint32)
        self.text_at, self.length, self.ids_at, self.count = (np.zeros(1 << 12, np.int64) for _ in range(4))

    def find(self, words: Words, at: np.ndarray) -> np.ndarray:
        """Places of the words, -1 for those that are not here."""
        if not self.n or not len(at):
            return np.full(len(at), -1, np.int64)
        where = np.minimum(np.searchsorted(self.hash, words.hash[at]), self.n - 1)
        place = self.place[where]
        length = words.length[at]
        same = (self.hash[where] == words.hash[at]) & (self.length[place] == length)
        # equal hashes are no proof: the bytes of both are laid side by side
        size = np.where(same, length, 0)
        differ = gather(words.data, words.first[at], size) != gather(self.text, self.text_at[place], size)
        if differ.any():
            same[np.repeat(np.arange(len(at)), size)[differ]] = False
        return np.where(same, place, -1)

    def add(self, words: Words, at: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Places of new words, ids given one after another."""
        n, length = len(at), words.length[at]
        text = gather(words.data, words.first[at], length)
        self.text, self.ids = grown(self.text, self.text_used + len(text)), grown(self.ids, self.ids_used + len(ids))
        self.text[self.text_used : self.text_used + len(text)] = text
        self.ids[self.ids_used : self.ids_used + len(ids)] = ids
        new = slice(self.n, self.n + n)
        for name, values in (
            ("text_at", self.text_used + np.cumsum(length) - length), ("length", length),
            ("ids_at", self.ids_used + np.cumsum(count) - count), ("count", count),
        ):
            setattr(self, name, grown(getattr(self, name), self.n + n))
            getattr(self, name)[new] = values
        place = np.arange(self.n, self.n + n)
        order = np.argsort(words.hash[at])
        where = np.searchsorted(self.hash, words.hash[at][order])
        self.hash = np.insert(self.hash, where, words.hash[at][order])
        self.place = np.insert(self.place, where, place[order])
        self.n, self.text_used, self.ids_used = self.n + n, self.text_used + len(text), self.ids_used + len(ids)
        return place


class IdMemory:
    """Remembers the ids of words in two generations.

    When the young one has `limit` words it becomes the old one; words of the old one that come
    again are copied to the young one, so words in use are never encoded anew, and at most
    twice `limit` are held. `encode` gives the ids of a list of words, and how many each has.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 500_000):
        self.encode, self.limit = encode, limit
        self.young, self.old = Generation(), Generation()

    def places(self, words: Words) -> np.ndarray:
        """Places in the young generation of different words."""
        every = np.arange(len(words.hash))
        place = self.young.find(words, every)
        missing = every[place < 0]
        if self.young.n and self.young.n + len(missing) > self.limit:
            self.old, self.young = self.young, Generation()
            missing = every
        before = self.old.find(words, missing)
        known, new = missing[before >= 0], missing[before < 0]
        if len(known):
            before = before[before >= 0]
            count = self.old.count[before]
            place[known] = self.young.add(words, known, gather(self.old.ids, self.old.ids_at[before], count), count)
        if len(new):
            place[new] = self.young.add(words, new, *self.encode(words.list(new)))
        return place

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, where each word's ids begin and the total)."""
        coded = words.dictionary_encode()
        word = self.places(Words(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)]
        counts = self.young.count[word]
        return gather(self.young.ids, self.young.ids_at[word], counts), np.concatenate([[0], np.cumsum(counts)])
