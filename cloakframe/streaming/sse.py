"""Streams: event frames re-chunked so that no placeholder is cut, restored, and text tokenized batch by batch.

Text arrives in deltas that may end within a placeholder. A delta is let out up to the last separator, and not beyond the
beginning of what could become a placeholder; at most HOLD bytes are held back by the first rule, and a placeholder that
stands whole is never cut, whatever it holds. Tool input is held whole. All other frames pass through as they came.

Frames of a stream are numbered from 0 by ``seq``. A frame waits until all before it were seen, in whatever batch or order
they come; one that was seen already is dropped. A gap is given up, in the order of seq, when WAITING frames are behind it
or (``timed``) the stream falls silent.

Python is called for a bucket of streams at once, as a call takes far longer than a short stream's frames: a bucket's state
holds that of its streams. Streams that are timed are called one by one, since each falls silent on its own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.entities import SHAPES, shape_pattern

SEPARATORS = " \t\n\r`\"',;()[]{}|"
HOLD = 128
IDLE_MS = 60_000
BUFFERED = ("text", "tool_use", "mcp_tool_use")
BODY_BYTES = 64 << 20
OPEN = regex.compile("|".join([*(shape_pattern(e) for e in SHAPES), r"198\.1[89]\.[0-9]{1,3}\.[0-9]{1,3}", r"240\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", r"fd00:c0de:[0-9a-f:]+"]))
WAITING = 10_000
BUCKETS = 4096  # by which state is kept: not to be changed under a checkpoint
CHUNKS = "stream_id string, index long, seq long, part int, kind string, text string, event string, data string"
EVENT = "struct<index:long,action:string,kind:string,part:string>"
STATE = "held string"
TEXT, JSON_KINDS, FRAME, VERBATIM = "text", ("tool_use", "mcp_tool_use"), "frame", "verbatim"


def flush_boundary(text: str) -> int:
    """Where text can be cut: after the last separator, but so that at most HOLD bytes stay."""
    safe = max(text.rfind(c) for c in SEPARATORS) + 1
    held = text[safe:].encode()
    if len(held) > HOLD:
        cut = len(held) - HOLD
        while cut and held[cut] & 0xC0 == 0x80:  # not within a character
            cut -= 1
        safe += len(held[:cut].decode())
    return safe


def placeholders(text: str) -> tuple[list[tuple[int, int]], int]:
    """(where placeholders stand whole, where one begins that the end of the text cuts off, or else the text's length)."""
    at, whole = 0, []
    while at <= len(text):
        m = OPEN.search(text, at, partial=True)
        if m is None:
            break
        if m.partial:
            return whole, m.start()
        whole.append(m.span())
        at = max(m.end(), at + 1)
    return whole, len(text)


def safe_point(text: str) -> int:
    """The longest beginning that doesn't end within what could be a placeholder."""
    return placeholders(text)[1]


def cut_point(text: str) -> int:
    """The longest beginning that can leave now: by both rules, and not within a whole placeholder."""
    whole, cut = placeholders(text)
    cut = min(cut, flush_boundary(text))
    return next((s for s, e in whole if s < cut < e), cut)


def step(kind: str, held: str, over: bool, action: str, part: str) -> tuple[str, str, bool]:
    """(text let out, text held, over the limit) after one delta or stop of a block."""
    held += part
    if over or kind not in BUFFERED:
        return held, "", over
    if action == "stop":
        return held, "", over
    if kind == TEXT:
        cut = cut_point(held)
        return held[:cut], held[cut:], False
    if 4 * len(held) > BODY_BYTES and len(held.encode()) > BODY_BYTES:
        return held, "", True
    return "", held, False


# The delta that each kind of block is held back from.
DELTAS = {"text": ("text_delta", "text"), "tool_use": ("input_json_delta", "partial_json"), "mcp_tool_use": ("input_json_delta", "partial_json")}


def read_event(data: str) -> tuple[int, str, str, str]:
    """(block index, action, kind, text) of a frame's data. Actions: start (kind: the block's), delta (kind: the delta's),
    stop, end, pass (anything else)."""
    try:
        event = json.loads(data)
        name, index = event.get("type", ""), int(event.get("index", -1))
        if name == "content_block_start":
            block = event["content_block"]
            return index, "start", block.get("type", ""), block.get("text", "") or ""
        if name == "content_block_delta":
            delta = event["delta"]
            kind = delta.get("type", "")
            field = next((f for t, f in DELTAS.values() if t == kind), None)
            return index, "delta", kind, (delta.get(field, "") or "") if field else ""
        if name == "content_block_stop":
            return index, "stop", "", ""
        if name in ("message_stop", "error"):
            return index, "end", "", ""
    except (ValueError, KeyError, AttributeError, TypeError):
        pass
    return -1, "pass", "", ""


def without_text(data: str) -> str:
    """A start frame whose text, if it has any, comes as a delta."""
    event = json.loads(data)
    event["content_block"]["text"] = ""
    return json.dumps(event, ensure_ascii=False)


class Stream:
    """The state of one stream: the next seq, frames that wait for it, and open blocks. Rows go to ``out``."""

    def __init__(self, stream_id: str, held: str | None):
        state = json.loads(held) if held else {"next": 0, "wait": {}, "blocks": {}}
        self.id, self.next, self.wait, self.blocks = stream_id, state["next"], {int(k): v for k, v in state["wait"].items()}, state["blocks"]
        self.out: list[tuple] = []
        self.parts = 0

    def held(self) -> str:
        return json.dumps({"next": self.next, "wait": self.wait, "blocks": self.blocks})

    def put(self, seq: int, index: int, kind: str, text: str, event: str | None, data: str | None) -> None:
        self.out.append((self.id, index, seq, self.parts, kind, text, event, data))
        self.parts += 1

    def come(self, frames: list[tuple]) -> None:
        """Frames (seq, index, action, kind, part, event, data), in any order."""
        for seq, *frame in frames:
            if seq >= self.next:
                self.wait.setdefault(seq, frame)
        self.go_on()
        while len(self.wait) > WAITING:
            self.next = min(self.wait)
            self.go_on()

    def go_on(self) -> None:
        while self.next in self.wait:
            self.take(self.next, *self.wait.pop(self.next))
            self.next += 1

    def give_up(self) -> None:
        """What waits leaves in the order of seq, then what open blocks hold."""
        while self.wait:
            self.next = min(self.wait)
            self.go_on()
        self.close(self.next)

    def close(self, seq: int) -> None:
        for index in sorted(self.blocks, key=int):
            self.let(seq, int(index), "stop", "")
        self.blocks.clear()

    def let(self, seq: int, index: int, action: str, part: str) -> None:
        kind, held, over = self.blocks[str(index)]
        text, held, now = step(kind, held, over, action, part)
        if text:
            self.put(seq, index, VERBATIM if now else kind, text, "content_block_delta", None)
        self.blocks[str(index)] = [kind, held, now]

    def take(self, seq: int, index: int, action: str, kind: str, part: str, event: str, data: str) -> None:
        """One frame, whose turn it is."""
        self.parts = 0
        block = self.blocks.get(str(index))
        if action == "delta" and block and not block[2] and DELTAS.get(block[0], ("",))[0] == kind:
            self.let(seq, index, action, part)
            return
        if action == "stop" and block:
            self.let(seq, index, action, "")
            del self.blocks[str(index)]
        elif action == "end":
            self.close(seq)
        elif action == "start":
            if kind in BUFFERED:
                self.blocks[str(index)] = [kind, "", False]
            if kind == TEXT and part:
                data = without_text(data)
        self.put(seq, index, FRAME, "", event, data)
        if action == "start" and kind == TEXT and part:
            self.let(seq, index, "delta", part)


def _events(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_event(d or "") for d in data], columns=["index", "action", "kind", "part"])


def _blocks(frames: Iterator[pd.DataFrame], state: GroupState, timed: bool) -> Iterator[pd.DataFrame]:
    """The frames of some streams; what each holds is the state. It stays after a message's end, so that frames that come twice are known."""
    held = dict(json.loads(state.get[0])) if state.exists else {}
    streams: dict[str | None, Stream] = {}
    if state.hasTimedOut:
        streams = {i: Stream(i, h) for i, h in held.items()}
        for stream in streams.values():
            stream.give_up()
        state.remove()
    else:
        for part in frames:
            of: dict[str | None, list[tuple]] = {}
            for i, *frame in zip(*(part[c].tolist() for c in ("stream_id", "seq", "index_", "action", "kind", "part", "event", "data")), strict=True):
                of.setdefault(i, []).append(frame)
            for i, own in of.items():
                if i not in streams:
                    streams[i] = Stream(i, held.get(i))
                streams[i].come(own)
        state.update((json.dumps(list((held | {i: s.held() for i, s in streams.items()}).items())),))
        if timed:
            state.setTimeoutDuration(IDLE_MS)
    yield pd.DataFrame([row for s in streams.values() for row in s.out], columns=[c.split()[0] for c in CHUNKS.split(", ")])


def rechunk(frames: DataFrame, timed: bool = False) -> DataFrame:
    """CHUNKS from a stream of (stream_id, seq, event, data). A stream's rows are in order by (seq, part).

    A row of kind FRAME is a frame that passes through (its text is empty); any other row is a delta that is to be made of
    ``text``, which is to be restored unless its kind is VERBATIM (tool input over the limit).
    ``timed``: a stream that says nothing for IDLE_MS is closed, and what it held is let out. It keeps a query running, so
    it is not for one that ends with its input.
    """
    read = frames.withColumn("e", F.pandas_udf(_events, EVENT)("data")).select("stream_id", "seq", F.col("e.index").alias("index_"), "e.action", "e.kind", "e.part", F.coalesce("event", F.lit("")).alias("event"), F.coalesce("data", F.lit("")).alias("data"))
    by = F.col("stream_id") if timed else F.pmod(F.xxhash64("stream_id"), F.lit(BUCKETS))
    return read.withColumn("bucket", by).groupBy("bucket").applyInPandasWithState(
        lambda key, rows, state: _blocks(rows, state, timed), CHUNKS, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if timed else GroupStateTimeout.NoTimeout
    )


def restored_frames(redactor, chunks: DataFrame) -> DataFrame:
    """(stream_id, seq, part, event, data): frames to be sent on, with the values back in text and tool input."""
    plain = F.col("kind").isin(FRAME, VERBATIM)
    back = redactor.detokenize(chunks.where(~plain), "text", F.col("kind").isin(*JSON_KINDS)).unionByName(chunks.where(plain))
    text = F.struct(F.lit("text_delta").alias("type"), "text")
    tool = F.struct(F.lit("input_json_delta").alias("type"), F.col("text").alias("partial_json"))
    made = lambda delta: F.to_json(F.struct(F.lit("content_block_delta").alias("type"), "index", delta.alias("delta")))
    data = F.when(F.col("kind") == FRAME, F.col("data")).when(F.col("kind") == TEXT, made(text)).otherwise(made(tool))
    return back.select("stream_id", "seq", "part", "event", data.alias("data"))


def restore_stream(redactor, frames: DataFrame, sink: str, checkpoint: str, timed: bool = False):
    """Starts a query that re-chunks and restores frames and writes them batch by batch; a batch that runs again overwrites its own."""

    def batch(df: DataFrame, n: int) -> None:
        df = df.persist()  # it is read thrice, and each time all of its streams would be re-chunked
        try:
            restored_frames(redactor, df).write.mode("overwrite").parquet(f"{sink}/batch={n}")
        finally:
            df.unpersist()

    return rechunk(frames, timed).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch)


def tokenize_stream(redactor, stream: DataFrame, id_col: str, text_col: str, sink: str, checkpoint: str, watcher=None):
    """Starts a query that tokenizes each batch and appends it to ``sink``. The vault's batch is named after the stream's
    checkpoint and batch; one that runs again mints nothing new and overwrites its own output. ``watcher``: rules that may change between batches."""

    own = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def batch(df: DataFrame, n: int) -> None:
        if watcher is not None:
            redactor.rules = watcher.check()
        with redactor.tokenize(df, id_col, text_col, name=f"stream-{own}-{n}") as done:
            done.rows.write.mode("overwrite").parquet(f"{sink}/rows/batch={n}")
            done.rejects.write.mode("overwrite").parquet(f"{sink}/rejects/batch={n}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
