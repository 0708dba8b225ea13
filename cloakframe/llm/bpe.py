"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

How far right must one look before a token is certain? Bytes that are still to come change the symbols before them only
through a chain of merges in rank order, each of which takes the symbol left of the last one. ``Merges.lookahead`` is the
longest such chain in bytes, found in one pass over the merge list. ``WordStream`` holds a window of a word, emits each
token that ends at least so far before the window's end, and starts anew there, so its memory is constant however long a
word grows. ``Encoder`` cuts text as it comes into words, holding back only what later text could still change.

Decoding maps ids to bytes and bytes to text by an incremental UTF-8 state machine that keeps an unfinished character only.

Defined cases: null is the empty text, which has no ids and decodes to itself. The added tokens of the file are found in
texts, as the tokenizers library does. Repeated rows get equal results; an empty table gives an empty result. Columns
other than id and text are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_for, let_go, slices, vocabulary_file
from .ids import Store, binary, gather, joined

WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
RUNS = tuple(regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+"))
CUT = re.compile(r" (?=\S)")
ODD = re.compile(r" (?=\s|\Z)")
PIECE = 1 << 16  # characters that are fed at once
HOLD = 4096  # characters without a safe cut after which a word is streamed
LONG = 64  # bytes from which a word goes through the window
CACHE = 30_000  # entries of a generation of a cache
STORE = 300_000  # different chunks whose ids are kept
SLICE = 2 << 20  # bytes of text that are encoded before they are passed on


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """A merge list: ranks of pairs of ids, bytes of ids, and the lookahead after which a token is certain."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: token.encode() for token, i in self.added.items()}
        self.first = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        # Of a pair (left << BITS | right): its rank and what it becomes (rank << BITS | id), as plain numbers.
        self.rank: dict[int, int] = {}
        for k, (a, b) in enumerate(pairs):
            self.rank.setdefault(vocab[a] << BITS | vocab[b], k << BITS | vocab[a + b])
        self.lookahead = self.chain()

    def chain(self) -> int:
        """Bytes of the longest chain of merges of rising rank in which each right part begins with the last left part."""
        size = {i: len(b) for i, b in self.bytes_of.items()}
        lefts: dict[int, set[int]] = {}  # of a token: the tokens that its merges build first, from its left end
        best: dict[int, int] = {}  # of a token: the longest chain that ends with a merge that takes it as its left part
        longest = max(size.values())
        for pair, made in sorted(self.rank.items(), key=lambda x: x[1]):
            a, b, ab = pair >> BITS, pair & MASK, made & MASK
            reach, seen, todo = 0, set(), [b]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    reach = max(reach, best.get(x, 0))
                    todo += lefts.get(x, ())
            best[a] = max(best.get(a, 0), size[a] + reach)
            lefts.setdefault(ab, set()).add(a)
            longest = max(longest, best[a])
        return longest

    def word(self, data: bytes) -> list[int]:
        """The ids of a whole word: pairs are merged by rank, the leftmost first."""
        ids = [self.first[b] for b in data]
        if len(ids) > LONG:
            return self.long_word(ids)
        get = self.rank.get
        found = [get(a << BITS | b, NEVER) for a, b in pairwise(ids)]
        while found and (least := min(found)) < NEVER:
            k = found.index(least)
            ids[k] = made = least & MASK
            del ids[k + 1], found[k]
            # Only the pairs on either side change. Further places of the same pair follow: they have the same rank.
            if k:
                found[k - 1] = get(ids[k - 1] << BITS | made, NEVER)
            if k < len(found):
                found[k] = get(made << BITS | ids[k + 1], NEVER)
        return ids

    def long_word(self, ids: list[int]) -> list[int]:
        """The same with a heap of (rank and what it becomes, place, pair) over a linked list."""
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        pairs = [a << BITS | b for a, b in pairwise(ids)]
        heap = [(self.rank[p], k, p) for k, p in enumerate(pairs) if p in self.rank]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            made, k, p = heapq.heappop(heap)
            j = after[k] if alive[k] else -1
            if j < 0 or ids[k] << BITS | ids[j] != p:
                continue
            ids[k], alive[j], after[k] = made & MASK, False, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (q := ids[a] << BITS | ids[b]) in self.rank:
                    heapq.heappush(heap, (self.rank[q], a, q))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]


BITS = 24  # of an id
MASK, NEVER = (1 << BITS) - 1, 1 << 62


class WordStream:
    """One word, fed in pieces: ids come out as soon as they are certain."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, b""
        self.window = 4 * merges.lookahead + 256

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for s in range(0, len(data), self.window):
            self.held += data[s : s + self.window]
            if len(self.held) >= self.window:
                at, upto = 0, len(self.held) - self.merges.lookahead
                for i in self.merges.word(self.held):
                    end = at + len(self.merges.bytes_of[i])
                    if end > upto:
                        break
                    out.append(i)
                    at = end
                self.held = self.held[at:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.merges.word(self.held) if self.held else [], b""
        return out


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Cache:
    """What was met lately, in two generations: when the young one is full, the old one is forgotten."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        if (x := self.young.get(key)) is None and (x := self.old.get(key)) is not None:
            self.put(key, x)
        return x

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= CACHE:
            self.young, self.old = {}, self.young
        self.young[key] = value


class Encoder:
    """Text in, ids out (little-endian unsigned 32-bit), in pieces of any length. Caches hold words and spaced chunks."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.chunks, self.words = Cache(), Cache()
        self.special = re.compile("|".join(map(re.escape, sorted(merges.added, key=len, reverse=True)))) if merges.added else None
        self.held, self.run, self.stream = "", None, WordStream(merges)

    def encode(self, text: str) -> bytes:
        out = [self.feed(text[s : s + PIECE]) for s in range(0, len(text), PIECE)]
        return b"".join([*out, self.finish()])

    def feed(self, text: str) -> bytes:
        self.held += text
        out: list[bytes] = []
        if self.special:
            while m := self.special.search(self.held):
                rest, self.held = self.held[m.end() :], self.held[: m.start()]
                out += [self.plain(last=True), packed([self.merges.added[m[0]]])]
                self.held = rest
        kept = self.open_special()
        tail = self.held[len(self.held) - kept :]
        self.held = self.held[: len(self.held) - kept]
        out.append(self.plain(last=False))
        self.held += tail
        return b"".join(out)

    def finish(self) -> bytes:
        return self.plain(last=True)

    def open_special(self) -> int:
        """The length of the end of the held text that could be the beginning of an added token."""
        longest = max(map(len, self.merges.added), default=1) - 1
        for n in range(min(longest, len(self.held)), 0, -1):
            if any(x.startswith(self.held[-n:]) for x in self.merges.added):
                return n
        return 0

    def plain(self, last: bool) -> bytes:
        """What is certain of the held text, which has no added token; all of it if the text ends here."""
        out: list[bytes] = []
        if self.run is not None:
            out.append(self.go_on(last))
        if last:
            out.append(self.spaced(self.held))
            self.held = ""
        elif self.run is None:
            # A space before a character that is none always begins a word, whatever stands before it or comes later.
            cut = self.held.rfind(" ")
            while cut > 0 and (cut + 1 == len(self.held) or self.held[cut + 1].isspace()):
                cut = self.held.rfind(" ", 0, cut)
            if cut > 0:
                out.append(self.spaced(self.held[:cut]))
                self.held = self.held[cut:]
            if len(self.held) > HOLD:
                out.append(self.unspaced())
        return b"".join(out)

    def spaced(self, text: str) -> bytes:
        """The ids of a text that words of other texts don't reach into, chunk by chunk; spaces go with what follows."""
        if not text:
            return b""
        parts = CUT.split(text) if ODD.search(text) else text.split(" ")
        found = list(map(self.chunks.young.get, parts[1:]))
        if None in found:
            for k, x in enumerate(found):
                if x is None:
                    part = parts[k + 1]
                    if (x := self.chunks.get(part)) is None:
                        x = self.chunk(" " + part)
                        if len(part) <= 40:
                            self.chunks.put(part, x)
                    found[k] = x
        return (self.chunk(parts[0]) if parts[0] else b"") + b"".join(found)

    def chunk(self, text: str) -> bytes:
        return b"".join(map(self.word, WORDS.findall(text)))

    def word(self, text: str) -> bytes:
        if (x := self.words.get(text)) is None:
            data = text.encode()
            if len(data) > self.stream.window:
                stream = WordStream(self.merges)
                return packed(stream.feed(data)) + packed(stream.finish())
            x = packed(self.merges.word(data))
            if len(data) <= 40:
                self.words.put(text, x)
        return x

    def unspaced(self) -> bytes:
        """All words of the held text but the last, which is open: it goes through the window as far as it is certain."""
        out, at = [], 0
        for m in WORDS.finditer(self.held):
            if m.end() > len(self.held) - 3:
                break
            out.append(self.word(m[0]))
            at = m.end()
        self.held = self.held[at:]
        if len(self.held) > HOLD:
            skip = self.held[0] == " " and not self.held[1].isspace()
            self.run = next(r for r in RUNS if r.match(self.held, int(skip)))
            out.append(packed(self.stream.feed(self.held[: int(skip)].encode())))
            self.held = self.held[int(skip) :]
            out.append(self.go_on(False))
        return b"".join(out)

    def go_on(self, last: bool) -> bytes:
        """Continues the open word; its end is certain once another kind of character follows (of white space, the last
        character goes with what follows)."""
        m = self.run.match(self.held)
        end = m.end() if m else 0
        closed = last or end < len(self.held)
        blank = self.run is RUNS[3]
        if blank and not (last and end == len(self.held)):
            end = max(0, end - 1)
        out = self.stream.feed(self.held[:end].encode())
        self.held = self.held[end:]
        if closed:
            out += self.stream.finish()
            self.run = None
        return packed(out)


class ColumnEncoder:
    """Many texts at once. Their chunks, which words don't reach over, are told apart first, so that each different one
    passes the transducer once while it is remembered. Long texts and odd ones (added tokens, several spaces in a row)
    pass it as a whole."""

    ODD = r" (?:[\s\v\x1c-\x1f\x{85}\p{Z}]|$)"

    def __init__(self, merges: Merges):
        self.encoder = Encoder(merges)
        self.store, self.heads = Store(STORE), Store(STORE)
        self.odd = "|".join([self.ODD, *map(re.escape, merges.added)])

    def learn(self, before: str):
        def each(chunks: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
            ids = [self.encoder.chunk(before + x) for x in chunks.to_pylist()]
            return chunks, np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)

        return each

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each one's begin and the last one's end)."""
        texts = pc.fill_null(texts, "")
        whole = pc.or_(pc.match_substring_regex(texts, self.odd), pc.greater(pc.binary_length(texts), SLICE))
        cut = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        chunks = cut.values.dictionary_encode()
        first = cut.offsets.to_numpy()[:-1]  # the chunk that a text begins with has no space before it
        heads = cut.values.take(pa.array(first)).dictionary_encode()
        rest_ids, rest_at = self.store.take(self.store.find(chunks.dictionary, self.learn(" ")))
        head_ids, head_at = self.heads.take(self.heads.find(heads.dictionary, self.learn("")))
        index = chunks.indices.to_numpy().copy()
        index[first] = len(chunks.dictionary) + heads.indices.to_numpy()
        ids = np.concatenate([rest_ids, head_ids])
        begin = np.concatenate([rest_at[:-1], len(rest_ids) + head_at])
        stop = np.concatenate([rest_at[1:], len(rest_ids) + head_at[1:]])
        ids, at = gather(ids, begin[index], stop[index] - begin[index])
        at = at[cut.offsets.to_numpy()]
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if len(odd):
            found = np.split(ids, at[1:-1])
            for k in odd:
                found[k] = np.frombuffer(self.encoder.encode(texts[int(k)].as_py()), "<u4")
            return joined(found)
        return ids, at


class Decoder:
    """Ids in, text out: an incremental UTF-8 machine keeps the bytes of an unfinished character."""

    def __init__(self, merges: Merges):
        self.table = [merges.bytes_of.get(i, b"") for i in range(max(merges.bytes_of) + 1)]
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        return self.piece(np.frombuffer(ids, "<u4"))

    def piece(self, ids: np.ndarray) -> str:
        return self.machine.decode(b"".join(map(self.table.__getitem__, ids.tolist())))

    def text(self, ids: np.ndarray) -> str:
        return "".join([self.piece(ids[s : s + PIECE]) for s in range(0, len(ids), PIECE)]) + self.finish()

    def finish(self) -> str:
        out = self.machine.decode(b"", True)
        self.machine.reset()
        return out


def codec(path: str) -> tuple[ColumnEncoder, Decoder]:
    """The coders of a vocabulary, one of each in a worker."""
    own = held_for("bpe")
    if path not in own:
        merges = Merges(vocabulary_file(path))
        own[path] = ColumnEncoder(merges), Decoder(merges)
        let_go()  # what reading the vocabulary took
    return own[path]


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): each text's ids as little-endian unsigned 32-bit integers, and the text that they decode to."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = codec(path)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
            for part in slices(batch, sizes, SLICE):
                ids, at = encoder.column(part.column("text"))
                texts = [decoder.text(ids[a:b]) for a, b in pairwise(at.tolist())]
                yield pa.RecordBatch.from_arrays([part.column("id"), binary(ids, at), pa.array(texts, pa.string())], names=["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, f"id {rows.schema['id'].dataType.simpleString()}, ids binary, decoded string").withColumnRenamed("id", id_col)


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return coded.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


VOCABULARY = "byte_bpe_50k.json"


def production_path() -> str:
    return vocabulary_file(VOCABULARY)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), VOCABULARY))
