"""Language identification by a byte convolutional network, trained in numpy.

A text is read as UTF-8 bytes in fixed-length windows that overlap by the widest filter less one, so every byte of it
counts. Bytes are embedded, filters of several widths slide over them, each filter keeps its maximum, and a softmax gives
the window's language. A text's score is the mean of its windows' probabilities, weighted by their bytes.

Training takes PER_LANGUAGE different texts of each language at most (those with the smallest hashes) and PER_TEXT windows of each,
spread over the whole text; that bound is a parameter of ``train``. Only text and language are read.

Defined cases: texts that are null or have no letter are ``und`` with score 0, and so is every text if nothing could be
learned. Rows with a null id belong to neither fold: they aren't learned from. Ties go to the language that sorts first.
Repeated rows get equal results. All columns of the input pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, held_for, written

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 24, 8
PER_LANGUAGE, PER_TEXT, SURPLUS = 300, 6, 4
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 3
NONE = "und"
PRED, SCORE = "__cf_lang", "__cf_score"


def cut(text: bytes, length: int = WINDOW, overlap: int = max(WIDTHS) - 1) -> tuple[np.ndarray, np.ndarray]:
    """(windows, bytes of each that no earlier window holds); a short last window is filled with spaces."""
    step = length - overlap
    n = max(1, -(-(len(text) - overlap) // step))
    room = np.full((n - 1) * step + length, 32, np.uint8)
    room[: len(text)] = np.frombuffer(text, np.uint8)
    held = np.full(n, step)
    held[-1] = len(text) - (n - 1) * step
    return np.lib.stride_tricks.sliding_window_view(room, length)[::step], np.maximum(held, 1)


@dataclass
class Network:
    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, languages: list[str], seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        w = {"embed": r.normal(0, 0.3, (256, EMBED)), "out": r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))), "bias": np.zeros(len(languages))}
        for k in WIDTHS:
            w[f"filter{k}"] = r.normal(0, np.sqrt(2 / (k * EMBED)), (k * EMBED, FILTERS))
            w[f"shift{k}"] = np.zeros(FILTERS)
        return cls(languages, {k: v.astype(np.float32) for k, v in w.items()})

    def pooled(self, windows: np.ndarray, where: bool = False) -> tuple[np.ndarray, list]:
        """Maxima of all filters, and for training the places where they stand."""
        x = self.weights["embed"][windows]
        n, length, _ = x.shape
        parts, places = [], []
        for k in WIDTHS:
            grams = np.concatenate([x[:, j : length - k + 1 + j] for j in range(k)], axis=2)
            out = grams @ self.weights[f"filter{k}"]
            if where:
                at = out.argmax(axis=1)
                places.append((at, grams))
                top = np.take_along_axis(out, at[:, None], axis=1)[:, 0]
            else:
                top = out.max(axis=1)
            parts.append(np.maximum(top + self.weights[f"shift{k}"], 0))
        return np.concatenate(parts, axis=1), places

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for s in range(0, len(windows), BATCH):
            z = self.pooled(windows[s : s + BATCH])[0] @ self.weights["out"] + self.weights["bias"]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(out)

    def gradients(self, windows: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        hidden, places = self.pooled(windows, where=True)
        z = hidden @ self.weights["out"] + self.weights["bias"]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        d = e / e.sum(axis=1, keepdims=True)
        d[np.arange(len(d)), truth] -= 1
        d /= len(d)
        grads = {"out": hidden.T @ d, "bias": d.sum(axis=0), "embed": np.zeros_like(self.weights["embed"])}
        back = (d @ self.weights["out"].T) * (hidden > 0)
        rows = np.arange(len(d))[:, None]
        for i, k in enumerate(WIDTHS):
            at, grams = places[i]
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            grads[f"filter{k}"] = np.einsum("bf,bfe->ef", g, grams[rows, at])
            grads[f"shift{k}"] = g.sum(axis=0)
            for j in range(k):  # the byte j places into the winning gram
                part = self.weights[f"filter{k}"][j * EMBED : (j + 1) * EMBED]
                np.add.at(grads["embed"], windows[rows, at + j], g[:, :, None] * part.T[None])
        return grads

    def fit(self, windows: np.ndarray, truth: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adam over shuffled batches."""
        r, step = np.random.default_rng(seed), 0
        mean, square = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        for epoch in range(epochs):
            order = r.permutation(len(windows))
            for s in range(0, len(order), BATCH):
                pick = order[s : s + BATCH]
                step += 1
                rate = RATE * 0.5**epoch
                for k, g in self.gradients(windows[pick], truth[pick]).items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    self.weights[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
        names, scores = [NONE] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        for i in found:
            windows, held = cut(texts[i].encode())
            p = np.zeros(len(self.languages))
            for s in range(0, len(windows), 4 * BATCH):
                p += held[s : s + 4 * BATCH].astype(float) @ self.probabilities(windows[s : s + 4 * BATCH])
            p /= held.sum()
            best = int(p.argmax())
            names[i], scores[i] = self.languages[best], min(1.0, float(p[best]))
        return names, scores


def held_out(id_col: str):
    """The fold of a row: true for those that are never learned from; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, per_text: int = PER_TEXT) -> Network:
    """The network, from at most ``per_language`` different texts a language outside the held-out fold."""
    rows = docs.where(~held_out(id_col)).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    # Copies share a hash and count once. A language's smallest hashes lie below a bound that its number of texts tells (up
    # to SURPLUS times as many as are wanted), so what meets in the task of a language doesn't grow with the corpus.
    hashes = written(rows.select("lang", F.xxhash64("text").alias("h")), "lang-hashes")
    texts = hashes.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    bound = F.when(F.col("n") > SURPLUS * per_language, -(2.0**63) + 2.0**64 * SURPLUS * per_language / F.col("n")).otherwise(F.lit(2.0**63))
    few = hashes.join(F.broadcast(texts.select("lang", bound.alias("bound"))), "lang").where(F.col("h").cast("double") <= F.col("bound")).select("lang", "h").distinct()
    order = Window.partitionBy("lang").orderBy("h")
    picked = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language).select("lang", "h")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, hs, wins = [], [], []
            for lang, h, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "h", "text")), strict=True):
                every, _ = cut(text.encode())
                for k in np.unique(np.linspace(0, len(every) - 1, per_text).astype(int)):
                    langs.append(lang)
                    hs.append(h)
                    wins.append(every[k].tobytes())
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "h": pa.array(hs, pa.int64()), "w": pa.array(wins, pa.binary())})

    # per_language rows a language: the bound of what is broadcast.
    chosen = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(picked), ["lang", "h"], "left_semi").select("lang", "h", "text")
    sample = chosen.mapInArrow(windows, "lang string, h long, w binary").distinct().toPandas().sort_values(["lang", "h", "w"])
    net = Network.new(sorted(sample["lang"].unique().tolist()))
    if len(sample):
        net.fit(np.frombuffer(b"".join(sample["w"]), np.uint8).reshape(-1, WINDOW), np.searchsorted(net.languages, sample["lang"].to_numpy().astype(str)))
    return net


def annotate(docs: DataFrame, net: Network, text_col: str = "text", pred: str = PRED, score: str = SCORE) -> DataFrame:
    """``docs`` with two more columns, ``pred`` and ``score``. Only the text goes to Python; the other columns stay in the JVM."""

    def each(texts: pa.Array) -> pa.Array:
        held_for("lang")
        names, scores = [], []
        for s in range(0, len(texts), 200):
            n, c = net.predict(texts.slice(s, 200).to_pylist())
            names += n
            scores += c
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["pred", "score"])

    # Not to be pushed into a filter and evaluated there once more.
    found = F.arrow_udf(each, "struct<pred:string,score:double>").asNondeterministic()
    name = free_name(docs.columns, "found")
    out = docs.withColumn(name, found(F.col(text_col)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(name)["pred"].alias(pred), F.col(name)["score"].alias(score))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = annotate(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), F.col(PRED).alias("lang_pred"), F.col(SCORE).alias("score"))
