"""Ids of many short texts at once: stretches of arrays, and a compact store of texts and their ids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def gather(ids: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches (start, count) of ``ids`` one after the other, and where each one of them begins and the last ends."""
    begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
    return ids[np.repeat(start - begin[:-1], count) + np.arange(begin[-1])], begin


def joined(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The same of whole arrays."""
    ids = np.concatenate([*each, np.empty(0, np.uint32)])
    return ids, np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in each], dtype=np.int64)])


def binary(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column of little-endian ids; a row's begin at ``at``, the last one's end there too."""
    at = at * ids.itemsize
    if at[-1] > np.iinfo(np.int32).max:
        raise ValueError("too many ids for one column")
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])


class Store:
    """Texts that were met and their ids, in a few flat arrays. Beyond ``limit`` texts it begins anew."""

    def __init__(self, limit: int):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.texts, self.ids, self.begin = pa.array([""]), np.empty(0, np.uint32), np.zeros(2, np.int64)

    def add(self, texts: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(counts, dtype=np.int64)])
        self.ids = np.concatenate([self.ids, ids])
        self.texts = pa.concat_arrays([self.texts, texts])

    def find(self, texts: pa.Array, learn: Callable[[pa.Array], tuple[pa.Array, np.ndarray, np.ndarray]]) -> np.ndarray:
        """The places of ``texts``; ``learn`` tells (texts, ids, counts) of those that are new."""
        if len(self.texts) > self.limit:
            self.forget()
        place = pc.index_in(texts, value_set=self.texts)
        if place.null_count:
            self.add(*learn(texts.filter(pc.is_null(place))))
            place = pc.index_in(texts, value_set=self.texts)
        return place.to_numpy()

    def take(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at ``place``, one after the other, and where each one's begin and the last one's end."""
        return gather(self.ids, self.begin[place], self.begin[place + 1] - self.begin[place])
