"""Token-id files coded by a static range asymmetric numeral system.

One frequency table, counted over all ids and scaled to a power of two, serves every file. A file holds blocks that are
coded independently; in a block, LANES states take turns over the ids and share one stream of 32-bit words. Checkpoints in
a block hold the states and the place in the stream, so decoding can begin at any of them; all stretches between
checkpoints of a file are decoded side by side. Every block has a checksum of its bytes and of its ids.

File: MAGIC, version, header length, header (JSON: table checksum), blocks, documents (Arrow stream of id and number of
ids), index (one INDEX record a block), TAIL, MAGIC. Numbers are little-endian. A writer passes blocks on as ids come and
keeps the list of documents and the index only, so a file may be far larger than the memory of its task; a reader holds
those two and a group of blocks.

Texts are encoded by the tokenizers library (``LibraryEncoder``); a slice of SLICE bytes of text, or one longer text, is in
memory at a time. Ids are kept in 16 bits where the vocabulary allows it, in 32 otherwise; one that doesn't fit is an error.

Defined cases: a null text is empty; a document without ids still has its end id. Null ids come first; rows that repeat an
id follow each other in the order of their ids' first HEAD bytes. An empty table writes no file. Columns other than id and text are
not read.
"""

from __future__ import annotations

import io
import json
import os
import posixpath
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import held_for, replace_file, shared_dir, slices, store, vocabulary_file, written
from .ids import Store, binary, gather, joined

END = 2
SCALE = 20  # bits of the frequency table's sum
LANES, BLOCK, STRETCH, GROUP = 32, 1 << 15, 256, 32  # states, ids a block, steps between checkpoints, blocks coded at once
LOW = np.uint64(1 << 32)
MAGIC, VERSION = b"RANSTOK1", 2
TAIL = struct.Struct("<QQI")  # where the documents and the index begin, and the checksum of both
SLICE, ROWS, HEAD = 4 << 20, 1 << 14, 8  # bytes of text that are encoded at once, documents that are read at once, bytes of a tie-break
INDEX = np.dtype([("offset", "<u8"), ("bytes", "<u4"), ("ids", "<u4"), ("crc", "<u4"), ("ids_crc", "<u4")])


class Table:
    """Frequencies scaled to 2**SCALE, each id that occurs at least 1; their running sums; the id of each slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    @classmethod
    def scaled(cls, counts: np.ndarray) -> Table:
        total, room = int(counts.sum()), 1 << SCALE
        if not total:
            return cls(np.zeros(len(counts), np.int64))
        if int((counts > 0).sum()) > room:
            raise ValueError("more ids than slots")
        freq = np.where(counts > 0, np.maximum(1, np.round(counts / total * room)), 0).astype(np.int64)
        over = int(freq.sum()) - room
        order = np.argsort(-freq, kind="stable")
        if over < 0:
            freq[order[0]] -= over
        for i in order:  # the largest give way first, by a half each at most
            if over <= 0:
                break
            give = min(over, int(freq[i]) // 2)
            freq[i] -= give
            over -= give
        return cls(freq)


def code(table: Table, ids: np.ndarray) -> list[bytes]:
    """Blocks of ``ids`` (BLOCK each, the last shorter), coded side by side."""
    count = -(-len(ids) // BLOCK)
    steps = -(-min(len(ids), BLOCK) // LANES) if count == 1 else BLOCK // LANES
    room = np.full(count * steps * LANES, -1, np.int64)
    room[: len(ids)] = ids
    sym = room.reshape(count, steps, LANES)
    x = np.full((count, LANES), LOW)
    emits, words, marks = np.zeros((steps, count, LANES), bool), np.zeros((steps, count, LANES), np.uint32), {}
    bits, half = np.uint64(SCALE), np.uint64(32)
    whole = room.min(initial=0) >= 0
    for t in range(steps - 1, -1, -1):
        s = sym[:, t]
        there = None if whole else s >= 0
        s = s if whole else np.maximum(s, 0)
        f, c = table.freq[s], table.start[s]
        out = (x >> np.uint64(64 - SCALE)) >= f
        if there is not None:
            out &= there
            f = np.maximum(f, np.uint64(1))
        emits[t], words[t] = out, x.astype(np.uint32)
        y = np.where(out, x >> half, x)
        q = y // f
        y = (q << bits) + (y - q * f) + c
        x = y if there is None else np.where(there, y, x)
        if t % STRETCH == 0:
            marks[t] = x
    blocks = []
    for b in range(count):
        held = emits[:, b]
        before = np.cumsum(held.sum(axis=1)) - held.sum(axis=1)
        points = sorted(marks)
        head = struct.pack("<II", len(points), int(held.sum()))
        spots = b"".join(struct.pack("<II", t, int(before[t])) + marks[t][b].astype("<u8").tobytes() for t in points)
        blocks.append(head + spots + words[:, b][held].astype("<u4").tobytes())
    return blocks


def stretches(data: bytes, ids: int) -> tuple[list[tuple[int, int, np.ndarray]], np.ndarray, int]:
    """Of a block: its checkpoints (step, place, states), its words, and its number of steps."""
    points, n = struct.unpack_from("<II", data)
    size = 8 + 8 * LANES
    marks = [(*struct.unpack_from("<II", data, 8 + k * size), np.frombuffer(data, "<u8", LANES, 16 + k * size)) for k in range(points)]
    return marks, np.frombuffer(data, "<u4", n, 8 + points * size), -(-ids // LANES)


def decode(table: Table, blocks: list[tuple[bytes, int]]) -> list[np.ndarray]:
    """The ids of blocks (bytes, number of ids); all stretches of all blocks are decoded side by side."""
    states, place, left, stop, owner, begin, words, base = [], [], [], [], [], [], [], 0
    for b, (data, n) in enumerate(blocks):
        marks, w, steps = stretches(data, n)
        for k, (t, at, x) in enumerate(marks):
            last = k + 1 == len(marks)
            states.append(x)
            place.append(base + at)
            left.append(max(0, min(n, (steps if last else marks[k + 1][0]) * LANES) - t * LANES))
            stop.append(base + (len(w) if last else marks[k + 1][1]))
            owner.append(b)
            begin.append(t)
        words.append(w)
        base += len(w)
    x, at, left = np.array(states, np.uint64), np.array(place), np.array(left)
    flow = np.concatenate([*words, np.zeros(1, np.uint32)]).astype(np.uint64)
    steps = int(-(-left.max(initial=0) // LANES))
    out = np.zeros((len(x), steps, LANES), np.uint32)
    mask, bits, half, lane = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32), np.arange(LANES)
    for t in range(steps):
        there = (t * LANES + lane)[None] < left[:, None]
        slot = x & mask
        s = table.slot[slot]
        out[:, t] = s
        y = table.freq[s] * (x >> bits) + slot - table.start[s]
        need = (y < LOW) & there
        upto = np.cumsum(need, axis=1)
        spot = np.minimum(at[:, None] + upto - 1, len(flow) - 1)
        x = np.where(there, np.where(need, (y << half) | flow[spot], y), x)
        at += upto[:, -1]
    if (at != np.array(stop)).any():
        raise ValueError("a block's stream doesn't end where its states do")
    found: list[list[np.ndarray]] = [[] for _ in blocks]
    for k, b in enumerate(owner):
        found[b].append(out[k].ravel()[: left[k]])
    return [np.concatenate(f) if f else np.empty(0, np.uint32) for f in found]


class Writer:
    """One file, written as ids come: blocks leave in groups, and only the list of documents and the index are kept."""

    def __init__(self, out: io.RawIOBase, table: Table):
        self.out, self.table = out, table
        self.held: list[np.ndarray] = []
        self.size = self.at = self.ids = 0
        self.index: list[tuple] = []
        head = json.dumps({"table": table.crc}).encode()
        self.put(MAGIC + struct.pack("<II", VERSION, len(head)) + head)

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def feed(self, ids: np.ndarray) -> None:
        for s in range(0, len(ids), BLOCK * GROUP):
            part = ids[s : s + BLOCK * GROUP]
            self.held.append(part)
            self.size += len(part)
            if self.size >= BLOCK * GROUP:
                self.flush(False)

    def flush(self, last: bool) -> None:
        every = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        upto = len(every) if last else len(every) // (BLOCK * GROUP) * BLOCK * GROUP
        for s in range(0, upto, BLOCK * GROUP):
            part = every[s : min(upto, s + BLOCK * GROUP)]
            for k, data in enumerate(code(self.table, part)):
                own = part[k * BLOCK : (k + 1) * BLOCK]
                self.index.append((self.at, len(data), len(own), zlib.crc32(data), zlib.crc32(own.astype("<u4").tobytes())))
                self.put(data)
        self.held, self.size = [every[upto:]], len(every) - upto
        self.ids += upto

    def finish(self, docs: pa.Table) -> None:
        """``docs`` (id, n): the documents whose ids were fed, in order."""
        self.flush(True)
        docs_at, sink = self.at, pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema) as w:
            w.write_table(docs)
        listed = sink.getvalue().to_pybytes()
        self.put(listed)
        index_at, index = self.at, np.array(self.index, INDEX).tobytes()
        self.put(index + TAIL.pack(docs_at, index_at, zlib.crc32(index, zlib.crc32(listed))) + MAGIC)


def doc_table(ids: pa.Array | pa.ChunkedArray, counts: np.ndarray) -> pa.Table:
    return pa.table({"id": ids, "n": pa.array(counts, pa.uint32())})


def write_file(out: io.RawIOBase, table: Table, docs: list[tuple[object, int]], ids: Iterator[np.ndarray], kind: pa.DataType) -> None:
    """One file of documents (id, number of ids) whose ids come in pieces of any length."""
    writer = Writer(out, table)
    for part in ids:
        writer.feed(part)
    writer.finish(doc_table(pa.array([d for d, _ in docs], kind), np.array([n for _, n in docs])))


def open_file(data: io.RawIOBase, size: int, table: Table) -> tuple[pa.Table, Iterator[np.ndarray]]:
    """The documents (id, n) of a file, and its ids block by block, a group of blocks read and decoded at a time."""
    data.seek(0)
    first = data.read(16)
    version, n = struct.unpack("<II", first[8:])
    if first[:8] != MAGIC or version != VERSION:
        raise ValueError("not a token file of this version")
    if json.loads(data.read(n))["table"] != table.crc:
        raise ValueError("the file was written with another frequency table")
    end = size - TAIL.size - len(MAGIC)
    data.seek(end)
    docs_at, index_at, crc = TAIL.unpack(data.read(TAIL.size))
    data.seek(docs_at)
    listed = data.read(end - docs_at)
    if zlib.crc32(listed) != crc:
        raise ValueError("the list of documents or the index is damaged")
    index = np.frombuffer(listed, INDEX, offset=index_at - docs_at)

    def blocks() -> Iterator[np.ndarray]:
        for s in range(0, len(index), GROUP):
            held = []
            for e in index[s : s + GROUP]:
                data.seek(int(e["offset"]))
                own = data.read(int(e["bytes"]))
                if zlib.crc32(own) != e["crc"]:
                    raise ValueError("a block is damaged")
                held.append((own, int(e["ids"])))
            for ids, e in zip(decode(table, held), index[s : s + GROUP], strict=True):
                if zlib.crc32(ids.astype("<u4").tobytes()) != e["ids_crc"]:
                    raise ValueError("a block's ids don't match their checksum")
                yield ids

    return pa.ipc.open_stream(listed[: index_at - docs_at]).read_all(), blocks()


def pieces(counts: np.ndarray, flow: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The ids of each document from those of the blocks."""
    held, used = np.empty(0, np.uint32), 0
    for n in counts.tolist():
        parts = [held[used : used + n]]
        got = len(parts[0])
        used += got
        while got < n:
            held, used = next(flow), min(n - got, BLOCK)
            parts.append(held[:used])
            used = len(parts[-1])
            got += used
        yield parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_file(data: io.RawIOBase, size: int, table: Table) -> Iterator[tuple[object, np.ndarray]]:
    """(id, ids) of each document of a file."""
    docs, flow = open_file(data, size, table)
    yield from zip(docs.column("id").to_pylist(), pieces(docs.column("n").to_numpy(), flow), strict=True)


class LibraryEncoder:
    """Ids as the library gives them for whole texts.

    Vocabularies of a known form (``KNOWN``) drop white space and split words into letters, digits and marks. Their texts
    are cut at ASCII white space, and each different chunk of a slice of texts goes to the library once. Chunks of letters
    and marks only are cut further by what that form says, so that their words can be shared among chunks, and go to the
    library's own model without the normaliser; every word's last id is an end-of-word id, which tells them apart. Texts with
    an added token's string in any case, and texts for vocabularies of another form, go to the library whole.
    """

    # The form of vocabulary that allows texts to be cut.
    KNOWN = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    }
    LETTERS, MARKS = "a-zß-öø-ÿ", r"!-&(-/:-@\[-`{-~"  # of Latin-1, in lower case; of ASCII, but the apostrophe
    OUTSIDE = r"[^\x{00}-\x{FF}]"
    CACHE = 150_000
    JOIN = 1000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab, self.ends = spec["model"], self.library.get_vocab(), np.zeros(0, bool)
        suffix = model.get("end_of_word_suffix")
        self.known = all(spec[k] == v for k, v in self.KNOWN.items()) and bool(suffix) and not model.get("dropout") and not model.get("ignore_merges")
        if self.known:
            self.known = all(c + suffix in vocab for c in byte_letters())  # so no word ends without one
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.added = "(?i)" + "|".join(map(re.escape, added)) if added else None
        self.light = Tokenizer(self.library.model)
        self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.store = Store(self.CACHE)

    def ask(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The ids of new words and chunks."""
        simple = pc.match_substring_regex(words, f"^(?:[{self.LETTERS}]+|[{self.MARKS}]+)$")
        own, more = words.filter(simple), words.filter(pc.invert(simple))
        plain, others = own.to_pylist(), more.to_pylist()
        lines = [" ".join(plain[k : k + self.JOIN]) for k in range(0, len(plain), self.JOIN)]
        coded = [np.array(x.ids, np.uint32) for x in self.light.encode_batch_fast(lines, add_special_tokens=False)]
        first = np.concatenate([*coded, np.empty(0, np.uint32)])
        stops = np.flatnonzero(self.ends[first]) + 1
        if len(stops) != len(plain):
            raise ValueError("the vocabulary's words can't be told apart")
        rest = self.ask(others)
        return pa.concat_arrays([own, more]), np.concatenate([first, *rest]), np.concatenate([np.diff(stops, prepend=0), [len(x) for x in rest]]).astype(np.int64)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each one's begin and the last one's end)."""
        texts = pc.fill_null(texts, "")
        if not self.known:
            return self.whole(texts.to_pylist())
        # Lower case is the library's next step: within Latin-1 it is the same character by character.
        low = pc.if_else(pc.match_substring_regex(texts, self.OUTSIDE), texts, pc.utf8_lower(texts))
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False)) if self.added else []
        if len(odd):
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            low = pc.if_else(pa.array(mask), "", low)
        cut = pc.ascii_split_whitespace(low)
        chunks = cut.values.dictionary_encode()
        plain = pc.match_substring_regex(chunks.dictionary, f"^[{self.LETTERS}{self.MARKS}]+$")
        spaced = pc.if_else(plain, pc.replace_substring_regex(chunks.dictionary, f"([{self.MARKS}]+)", r" \1 "), chunks.dictionary)
        parts = pc.ascii_split_whitespace(spaced)
        words = parts.values.dictionary_encode()
        place = self.store.find(words.dictionary, self.learn)[words.indices.to_numpy()]
        ids, at = self.store.take(place)
        at = at[parts.offsets.to_numpy()]  # of each different chunk
        index = chunks.indices.to_numpy()
        ids, at = gather(ids, at[index], (at[1:] - at[:-1])[index])
        at = at[cut.offsets.to_numpy()]
        if len(odd):
            found = np.split(ids, at[1:-1])
            for k, x in zip(odd, self.ask([texts[int(k)].as_py() for k in odd]), strict=True):
                found[k] = x
            return joined(found)
        return ids, at

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return joined(self.ask(texts))

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, at = self.column(pa.array(texts, pa.string()))
        return [x.astype("<u4").tobytes() for x in np.split(ids, at[1:-1])][: len(texts)]


def id_type(size: int) -> np.dtype:
    """The narrowest unsigned integers that hold all ids below ``size``."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def fitted(ids: np.ndarray, kind: np.dtype) -> np.ndarray:
    if len(ids) and int(ids.max()) > np.iinfo(kind).max:
        raise ValueError(f"id {int(ids.max())} doesn't fit into {kind}")
    return ids.astype(kind)


def vocabulary_size(path: str, end: int = END) -> int:
    with open(vocabulary_file(path), encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"]), end])


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, size: int | None = None) -> DataFrame:
    """(id, ids as little-endian unsigned integers of ``id_type(size)``, the end id last); ``size`` is the vocabulary's."""
    kind = id_type(size or vocabulary_size(path, end))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held_for("rans")
        if path not in own:
            own[path] = LibraryEncoder(vocabulary_file(path))
        encoder = own[path]
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
            for part in slices(batch, sizes, SLICE):
                ids, at = encoder.column(part.column("text"))
                ids = np.insert(fitted(ids, kind), at[1:], end)
                yield pa.RecordBatch.from_arrays([part.column("id"), binary(ids, at + np.arange(len(at)))], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, f"id {rows.schema['id'].dataType.simpleString()}, ids binary")


def flat(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column without nulls, and how many each row has."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
    ids = np.frombuffer(data or b"", kind, (int(at[-1]) - int(at[0])) // kind.itemsize, int(at[0]))
    return ids, np.diff(at) // kind.itemsize


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """How often each id below ``size`` occurs in all rows; ``size`` bounds what comes to the driver."""
    kind = id_type(size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids, _ = flat(batch.column("ids"), kind)
            for s in range(0, len(ids), 1 << 20):
                total += np.bincount(ids[s : s + (1 << 20)], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["token", "n"])

    found = rows.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[found["token"]] = found["n"]
    return out


def write_ids(rows: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """Files of (id, ids) in ascending order of id, as (part, file, docs, ids), and the frequencies they are coded with."""
    table = Table.scaled(frequencies(rows, size))
    base = shared_dir(rows.sparkSession, "tokens")
    freq, kind = table.freq.astype(np.int64), id_type(size)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((x for x in batches if len(x)), None)
        if first is None:
            return
        part, own = first.column("part")[0].as_py(), Table(freq)
        name = posixpath.join(base, f"part-{part:06d}.rans")
        names, counts, total = [], [], 0

        def whole(out) -> None:
            nonlocal total
            writer = Writer(out, own)
            for batch in chain([first], batches):
                ids, n = flat(batch.column("ids"), kind)
                writer.feed(ids)
                # A copy: the batch itself goes.
                names.append(pa.concat_arrays([batch.column("id"), batch.column("id").slice(0, 0)]))
                counts.append(n)
            writer.finish(doc_table(pa.chunked_array(names), np.concatenate(counts)))
            total = writer.ids

        replace_file(name, whole)
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "docs": [sum(map(len, counts))], "ids": [total]})

    # Rows of one id, even with the same ids, need not be in one task: the head of their ids and their places deal them too.
    keyed = rows.withColumn("head", F.substring("ids", 1, HEAD)).withColumn("row", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange("id", "head", "row").sortWithinPartitions("id", "ids")
    # The range's number: a task that writes several ranges has one of its own, which tells neither their files nor their order.
    dealt = dealt.select("id", "ids", F.spark_partition_id().alias("part"))
    return written(dealt.mapInArrow(write, "part long, file string, docs long, ids long"), "token-files"), freq


def read_ids(files: DataFrame, freq: np.ndarray, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    starts = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, path = store(name)
                with fs.open_input_file(path) as data:
                    docs, flow = open_file(data, data.size(), table)
                    each = pieces(docs.column("n").to_numpy(), flow)
                    for s in range(0, len(docs), ROWS):
                        part = docs.slice(s, ROWS).combine_chunks()
                        n = part.column("n").to_numpy().astype(np.int64)
                        at = start + np.cumsum(n) - n
                        crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in islice(each, len(part))]
                        start += int(n.sum())
                        cols = [part.column("id").combine_chunks(), pa.array(at), pa.array(n), pa.array(crc, pa.int64())]
                        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts.repartition(max(1, files.count())).mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def production_path() -> str:
    return vocabulary_file("word_bpe_49k.json")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    path = "word_bpe_49k.json"
    size = vocabulary_size(path)
    rows = written(encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, size=size), "token-ids")
    return read_ids(*write_ids(rows, size))
