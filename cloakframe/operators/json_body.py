"""JSON message bodies: which strings are scanned, and how they are put back byte by byte.

A body is parsed once into nodes with their places. Fields are the string literals to be scanned, each split into segments
of which some stay verbatim. Tokenizing is strict: text that isn't JSON, a repeated key, or a block whose type or shape is
not known rejects the body. Restoring takes what it finds and leaves a body that it can't read as it is.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Block types that are never read, and the only keys of blocks that pass through.
SKIPPED = frozenset(
    """thinking redacted_thinking server_tool_use web_search_tool_result web_fetch_tool_result code_execution_tool_result
    bash_code_execution_tool_result text_editor_code_execution_tool_result tool_search_tool_result image document container_upload""".split()
)
REMINDERS = ("<total_tokens>", "Available agent types for the Agent tool:", "## Auto Mode Active",
             "The following skills are available for use with the Skill tool:", "## Exited Plan Mode")
CONTEXT = "As you answer the user's questions, you can use the following context:\n"
SCANNED_SECTIONS = ("claudeMd", "gitStatus")
SCHEMA_MAPS = ("properties", "patternProperties", "$defs", "definitions", "dependentSchemas", "anyOf", "oneOf", "allOf", "prefixItems")
SCHEMA_ONES = ("items", "additionalProperties", "not", "if", "then", "else", "contains", "propertyNames")
SCHEMA_VALUES = ("default", "const", "enum", "examples")
SAFEGUARD_KEYS = ("type", "tool_use_ids")
REMINDER = re.compile(r"<system-reminder>([\s\S]*?)</system-reminder>")
SECTION = re.compile(r"^# ([^ \t\n\f\r]+)\n", re.M)
BLANK = re.compile(r"[ \t\n\r]*")
ATOM = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")
STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
FIELDS = "struct<fields:array<struct<start:int,end:int,segs:array<struct<text:string,scan:boolean>>>>,error:string>"


class BadBody(ValueError):
    """Why a body is rejected; never holds text of it but names of keys and types."""


@dataclass
class Node:
    """A JSON value and where it stands. ``items``: of an object (key node, value node), of an array value nodes."""

    kind: str
    start: int
    end: int = 0
    text: str = ""
    items: list = field(default_factory=list)

    def get(self, *path: str) -> Node | None:
        node = self
        for name in path:
            node = next((v for k, v in node.items if k.text == name), None) if node and node.kind == "object" else None
        return node

    def string(self, name: str) -> str | None:
        node = self.get(name)
        return node.text if node and node.kind == "string" else None


def parse(text: str) -> Node:
    """The value that is the whole of ``text``; a repeated key at any depth is an error."""
    at = 0

    def skip() -> None:
        nonlocal at
        at = BLANK.match(text, at).end()

    def expect(chars: str) -> str:
        nonlocal at
        skip()
        if at >= len(text) or text[at] not in chars:
            raise BadBody("not JSON")
        at += 1
        return text[at - 1]

    def string() -> Node:
        nonlocal at
        skip()
        m = STRING.match(text, at)
        if not m:
            raise BadBody("not JSON")
        at = m.end()
        try:
            return Node("string", m.start(), at, json.loads(m[0]).encode("utf-16", "surrogatepass").decode("utf-16"))
        except UnicodeDecodeError as e:
            raise BadBody("half a surrogate pair") from e

    def value(depth: int) -> Node:
        nonlocal at
        skip()
        if depth > 500:
            raise BadBody("nested too deeply")
        c, start = text[at : at + 1], at
        if c == '"':
            return string()
        if c in ("{", "["):
            at += 1
            node = Node("object" if c == "{" else "array", start)
            close, seen = ("}" if c == "{" else "]"), set()
            skip()
            if text[at : at + 1] == close:
                at += 1
            else:
                while True:
                    if c == "{":
                        key = string()
                        if key.text in seen:
                            raise BadBody("a key is repeated")
                        seen.add(key.text)
                        expect(":")
                        node.items.append((key, value(depth + 1)))
                    else:
                        node.items.append(value(depth + 1))
                    if expect("," + close) == close:
                        break
            node.end = at
            return node
        m = ATOM.match(text, at)
        if not m:
            raise BadBody("not JSON")
        at = m.end()
        return Node("atom", start, at, m[0])

    at = 1 if text.startswith("﻿") else 0
    root = value(0)
    skip()
    if at != len(text):
        raise BadBody("text after the value")
    return root


def shape(node: Node | None, *allowed: str) -> None:
    if node is None or node.kind != "object" or any(k.text not in allowed for k, _ in node.items):
        raise BadBody("a block of an unknown shape")


def leaves(node: Node | None, keys: bool = False, without: tuple = ()):
    """String values below a node, with ``keys`` their keys too."""
    if node is None:
        return
    if node.kind == "string":
        yield node
    for item in node.items:
        if node.kind == "object":
            if item[0].text in without:
                continue
            if keys:
                yield item[0]
            yield from leaves(item[1], keys, without)
        else:
            yield from leaves(item, keys, without)


def schema_texts(node: Node | None):
    """Descriptions, titles and example values of a JSON schema; only keywords that hold schemas are followed."""
    for key, v in node.items if node is not None and node.kind == "object" else ():
        if key.text in ("description", "title"):
            if v.kind == "string":
                yield v
        elif key.text in SCHEMA_VALUES:
            yield from leaves(v)
        elif key.text in SCHEMA_MAPS or (key.text in SCHEMA_ONES and v.kind == "array"):
            for item in v.items:
                yield from schema_texts(item[1] if v.kind == "object" else item)
        elif key.text in SCHEMA_ONES:
            yield from schema_texts(v)


def tool_texts(tool: Node):
    if (tool.string("name") or "").startswith("mcp__"):
        if (d := tool.get("description")) and d.kind == "string":
            yield d
        yield from schema_texts(tool.get("input_schema"))


def tool_change(block: Node) -> None:
    shape(block, "type", "tool", "cache_control")
    tool = block.get("tool")
    kind = tool.string("type") if tool else None
    if kind == "tool_reference":
        shape(tool, "type", "name")
    elif kind == "tool_definition" and block.string("type") == "tool_addition":
        shape(tool, "type", "definition")
        shape(tool.get("definition"), *(k.text for k, _ in (tool.get("definition") or Node("", 0)).items))
    else:
        raise BadBody("a block of an unknown shape")


def search_texts(block: Node):
    shape(block, "type", "source", "title", "content", "citations", "cache_control")
    content, found = block.get("content"), [block.get("source"), block.get("title")]
    if content is None or content.kind != "array":
        raise BadBody("a block of an unknown shape")
    for item in content.items:
        shape(item, "type", "text")
        if item.string("type") != "text":
            raise BadBody("a block of an unknown shape")
        found.append(item.get("text"))
    if (c := block.get("citations")) is not None:
        shape(c, "enabled")
        if (e := c.get("enabled")) is not None and e.text not in ("true", "false"):
            raise BadBody("a block of an unknown shape")
    if any(x is None or x.kind != "string" for x in found):
        raise BadBody("a block of an unknown shape")
    yield from found


def block_texts(block: Node, strict: bool, inner: bool = False):
    """Strings of one content block. What isn't known is an error if ``strict``, and else has no strings."""
    kind = block.string("type") or ""
    if kind in SKIPPED:
        return
    try:
        if kind == "text":
            if (t := block.get("text")) and t.kind == "string":
                yield t
        elif kind == "search_result" and inner:
            yield from list(search_texts(block))
        elif kind == "tool_reference" and inner:
            shape(block, "type", "tool_name", "cache_control")
        elif inner:
            raise BadBody(f"unknown block type {kind[:40]!r}")
        elif kind in ("tool_result", "mcp_tool_result"):
            content = block.get("content")
            if content is not None and content.kind == "string":
                yield content
            elif content is not None and content.kind == "array":
                for item in content.items:
                    yield from block_texts(item, strict, inner=True)
        elif kind in ("tool_use", "mcp_tool_use"):
            yield from leaves(block.get("input"), keys=True)
        elif kind in ("tool_addition", "tool_removal"):
            tool_change(block)
            if (d := block.get("tool", "definition")) is not None:
                yield from tool_texts(d)
        elif kind == "fallback":
            shape(block, "type", "from", "to")
            for side in ("from", "to"):
                shape(block.get(side), "model")
                if block.get(side).string("model") is None:
                    raise BadBody("a block of an unknown shape")
        elif kind == "compaction":
            shape(block, "type", "content", "encrypted_content", "tool_changes", "cache_control")
            content, secret, changes = block.get("content"), block.get("encrypted_content"), block.get("tool_changes")
            if (content and content.kind != "string" and content.text != "null") or (secret and secret.kind != "string") or (changes and changes.kind != "array"):
                raise BadBody("a block of an unknown shape")
            for change in changes.items if changes else ():
                if change.string("type") not in ("tool_addition", "tool_removal"):
                    raise BadBody("a block of an unknown shape")
                tool_change(change)
        else:
            raise BadBody(f"unknown block type {kind[:40]!r}")
    except BadBody:
        if strict:
            raise


def message_texts(node: Node, strict: bool):
    """Strings of a request or response: messages, tools, safeguards, content; never the system prompt."""
    for message in (m.items if (m := node.get("messages")) and m.kind == "array" else ()):
        content = message.get("content")
        if content is not None and content.kind == "string":
            yield content
        for block in content.items if content is not None and content.kind == "array" else ():
            yield from block_texts(block, strict)
    for tool in (t.items if (t := node.get("tools")) and t.kind == "array" else ()):
        yield from tool_texts(tool)
    yield from leaves(node.get("safeguards"), without=SAFEGUARD_KEYS)
    for block in (c.items if (c := node.get("content")) and c.kind == "array" else ()):
        yield from block_texts(block, strict)


def body_texts(body: str, strict: bool = True) -> list[Node]:
    """All string literals that are scanned, in order of place: of the body, its batched requests, its batch result."""
    root = parse(body)
    found = list(message_texts(root, strict))
    for request in (r.items if (r := root.get("requests")) and r.kind == "array" else ()):
        if (params := request.get("params")) is not None and params.kind == "object":
            found += message_texts(params, strict)
    if (message := root.get("result", "message")) is not None and message.kind == "object":
        found += message_texts(message, strict)
    return sorted({n.start: n for n in found}.values(), key=lambda n: n.start)


def segments(text: str) -> list[tuple[str, bool]]:
    """(piece, whether it is scanned): reminders with fixed beginnings stay, and of a context only some sections are read."""
    out, at = [], 0
    for m in REMINDER.finditer(text):
        out.append((text[at : m.start()], True))
        body = m[1]
        begins = body.lstrip("\n")
        out.append(("<system-reminder>", False))
        if begins.startswith(REMINDERS):
            out.append((body, False))
        elif begins.startswith(CONTEXT):
            heads = list(SECTION.finditer(body))
            out.append((body[: heads[0].start()] if heads else body, False))
            for k, h in enumerate(heads):
                end = heads[k + 1].start() if k + 1 < len(heads) else len(body)
                out += [(h[0], False), (body[h.end() : end], h[1] in SCANNED_SECTIONS)]
        else:
            out.append((body, True))
        out.append(("</system-reminder>", False))
        at = m.end()
    return [s for s in [*out, (text[at:], True)] if s[0]]


def encode(text: str) -> str:
    """A JSON string literal: plain ASCII as it is, anything else without what HTML or scripts would read."""
    if all(" " <= c < "\x7f" and c not in '"\\' for c in text):
        return f'"{text}"'
    out = json.dumps(text, ensure_ascii=False)
    for c in "<>&  ":
        out = out.replace(c, f"\\u{ord(c):04x}")
    return out


def put_back(body: str, fields: list[tuple[int, int, str]]) -> str:
    """``body`` with literals replaced; every other byte stays, and so does a literal whose text didn't change."""
    out, at = [], 0
    for start, end, text in sorted(fields):
        if json.loads(body[start:end]) != text:
            out += [body[at:start], encode(text)]
            at = end
    return "".join([*out, body[at:]])


def value_texts(text: str) -> list[Node]:
    """All strings of any JSON value, keys too; none of what can't be read."""
    try:
        return list(leaves(parse(text), keys=True))
    except BadBody:
        return []


def restore_value(text: str, restore) -> str:
    """A JSON value with ``restore`` applied to each of its strings; text that isn't one stays as it is."""
    return put_back(text, [(n.start, n.end, restore(n.text)) for n in value_texts(text)])


def flatten(body: Column, strict: bool = True) -> Column:
    """struct(fields, error): what is scanned of each body."""

    @F.pandas_udf(FIELDS)
    def each(bodies: pd.Series) -> pd.DataFrame:
        rows = []
        for b in bodies:
            try:
                found = [{"start": n.start, "end": n.end, "segs": [{"text": t, "scan": s} for t, s in segments(n.text)]} for n in body_texts(b, strict)] if b is not None else []
                rows.append((found, None))
            except BadBody as e:
                rows.append(([], str(e)))
        return pd.DataFrame(rows, columns=["fields", "error"])

    return each(body)


def _assemble(bodies: pd.Series, fields: pd.Series) -> pd.Series:
    return pd.Series([b if f is None else put_back(b, [(x["start"], x["end"], x["text"]) for x in f]) for b, f in zip(bodies, fields, strict=True)])


def assemble(body: Column, fields: Column) -> Column:
    """Bodies with their fields' new texts: array of (start, end, text)."""
    return F.pandas_udf(_assemble, "string")(body, fields)


def rewrite_bodies(df: DataFrame, id_col: str, body_col: str, rewrite, strict: bool) -> tuple[DataFrame, DataFrame]:
    """(rows with rewritten bodies, rejects). ``rewrite``: from a DataFrame (seg_id, text) to one with the new texts and
    one with the ids that failed. Bodies are known by their digest, so each is rewritten once, and a task that runs again
    finds the same ones; null bodies are keyed apart."""
    own = lambda: F.coalesce(F.sha2(F.col(body_col), 256), F.concat(F.lit("null-"), F.xxhash64(id_col).cast("string")))
    keyed = df.withColumn("__id", own())
    found = keyed.where(F.col(body_col).isNotNull()).groupBy("__id").agg(F.first(body_col).alias("__b")).withColumn("__f", flatten(F.col("__b"), strict))
    fields = found.select("__id", F.posexplode("__f.fields").alias("field", "x"))
    segs = fields.select("__id", "field", "x.start", "x.end", F.posexplode("x.segs").alias("seg", "s")).select("__id", "field", "start", "end", "seg", "s.*")
    segs = segs.withColumn("seg_id", F.concat_ws("-", "__id", F.lpad(F.col("field").cast("string"), 9, "0"), F.lpad(F.col("seg").cast("string"), 9, "0")))
    new, failed = rewrite(segs.where("scan").select("seg_id", "text"))
    whole = segs.join(new.withColumnRenamed("text", "new"), "seg_id", "left").withColumn("text", F.coalesce("new", "text"))
    texts = whole.groupBy("__id", "field").agg(F.first("start").alias("start"), F.first("end").alias("end"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "text"))), lambda x: x["text"]), "").alias("text"))
    back = texts.groupBy("__id").agg(F.collect_list(F.struct("start", "end", "text")).alias("__t"))
    lost = segs.join(failed, "seg_id").groupBy("__id").agg(F.first("error").alias("__lost"))
    error = F.coalesce("__f.error", "__lost")
    done = found.join(back, "__id", "left").join(lost, "__id", "left").select("__id", error.alias("__e"), F.when(error.isNotNull(), F.col("__b")).otherwise(assemble(F.col("__b"), F.col("__t"))).alias("__new"))
    joined = keyed.join(done, "__id", "left")
    rows = joined.where(F.col("__e").isNull() | F.lit(not strict)).withColumn(body_col, F.col("__new")).select(*df.columns)
    return rows, joined.where(F.col("__e").isNotNull()).select(id_col, F.col("__e").alias("error"))


def tokenize_bodies(redactor, df: DataFrame, id_col: str, body_col: str) -> tuple[DataFrame, DataFrame]:
    """Fails closed: a body with an error is in the second result only."""

    def rewrite(segs: DataFrame):
        done = redactor.tokenize(segs, "seg_id", "text")
        return done.rows, done.rejects

    return rewrite_bodies(df, id_col, body_col, rewrite, strict=True)


def detokenize_bodies(redactor, df: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """Fails open: a body that can't be read stays as it is."""

    def rewrite(segs: DataFrame):
        none = df.sparkSession.createDataFrame([], "seg_id string, error string")
        return redactor.detokenize(segs, "text"), none

    return rewrite_bodies(df, id_col, body_col, rewrite, strict=False)[0]
