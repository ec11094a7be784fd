"""Language identification by prediction by partial matching over bytes, under frozen statistics.

Fit: of the labelled rows, a sample of about ``docs`` rows, the same number for each language (and ``least`` at least, so that a
language with any row has some), those of the smallest hash of the id. That bound is the fit's only limit: every label is learned,
and texts are read whole, in the fit as in the prediction. For each language a context tree counts the bytes that
follow every context of up to ``order`` bytes. A byte that a context has seen costs its share
c / (n + d) of n occurrences of d different bytes; any other byte costs the escape d / (n + d) and
its share among the bytes not seen there in the next shorter context (method C with exclusion).
The trees are frozen over ``nodes`` contexts, those that occur most, whatever the number of languages, and broadcast: a row of costs for each
(context, byte) that some language has seen, and the escapes of each context. That is about 1 MB a language.

A text's language is the one of the smallest code length, ties to the first in order of name; its
score the posterior of that language under equal priors. A text that is null or holds no letter is
``und`` with score 0. Rows with a null id or label are not learned from; a null id is not held out; rows that repeat an id and a label
are one in the fit. Without any labelled row, as in an empty table, every text is ``und``. Repeated rows get equal answers; only the named columns are
read, and the helper column is ``__text``. Long texts are taken in windows; beside its bytes a text costs no memory.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.batches import few
from quire.llm.common import give_back, table

_ASCII_LETTER = re.compile(b"[A-Za-z]")
START = 10  # contexts before the first byte of a text are line feeds


class Model:
    """The frozen trees. child: (context, byte before it) -> longer context; parent: the next shorter one, -1 for that of the empty one.

    row: context * 256 + byte -> row of bits, -1 where no language has seen the byte there; bits and escape: a column a language.
    """

    def __init__(self, langs: list[str], child: np.ndarray, parent: np.ndarray, row: np.ndarray, bits: np.ndarray, escape: np.ndarray, order: int):
        self.langs, self.child, self.parent, self.row, self.bits, self.escape, self.order = langs, child, parent, row, bits, escape, order

    def lengths(self, data: np.ndarray, offsets: np.ndarray, cells: int = 1 << 21) -> np.ndarray:
        """Bits of each text (rows of data between offsets) in each language, by windows of about so many cells."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        starts, step = offsets[:-1][np.diff(offsets) > 0], max(4096, cells // max(1, len(self.langs)))
        for a in range(int(offsets[0]), int(offsets[-1]), step):
            b, lo = min(a + step, int(offsets[-1])), max(int(offsets[0]), a - self.order)
            own = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, b)]
            cost = self._costs(data[lo:b], own - lo)[a - lo :]
            first, last = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
            bounds = np.maximum(offsets[first:last], a) - a
            full = np.diff(bounds, append=b - a) > 0
            out[first:last][full] += np.add.reduceat(cost, bounds[full], axis=0, dtype=np.float64)
        return out

    def _costs(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each byte in each language."""
        dead, flat = len(self.child) - 1, self.child.ravel()
        before, node, deep = data, np.zeros(len(data), np.int32), np.zeros(len(data), np.int32)
        for _ in range(self.order):
            before = np.concatenate([[np.uint8(START)], before[:-1]])
            before[starts] = START
            node = flat[node * 256 + before]
            deep = np.where(node != dead, node, deep)
        found = self.row[deep * 256 + data]
        cost = self.bits[np.maximum(found, 0)]
        left = np.flatnonzero(found < 0)
        if len(left):
            cost[left] = 0
            node = deep[left]
            while len(left):
                cost[left] += self.escape[node]
                node = self.parent[node]
                found = np.where(node >= 0, self.row[np.maximum(node, 0) * 256 + data[left]], -2)
                seen = found >= 0
                cost[left[seen]] += self.bits[found[seen]]
                cost[left[found == -2]] += np.float32(8)  # a byte that no language has seen at all
                on = found == -1
                left, node = left[on], node[on]
        return cost


def train(samples: dict[str, list[bytes]], order: int = 4, nodes: int = 6000) -> Model:
    langs = sorted(samples)
    seen: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
    for lang in langs:
        joined = b"".join(bytes([START]) * order + x for x in samples[lang])
        data = np.frombuffer(joined, np.uint8).astype(np.uint64)
        per = []
        for k in range(order + 1):
            # the byte just before is the lowest of the context, so that a prefix of it is a shorter context
            ctx = np.zeros(max(0, len(data) - order), np.uint64)
            for i in range(1, k + 1):
                ctx |= data[order - i : len(data) - i] << np.uint64(8 * (i - 1))
            pair, count = np.unique((ctx << np.uint64(8)) | data[order:], return_counts=True)
            per.append((pair >> np.uint64(8), (pair & np.uint64(255)).astype(np.int64), count))
        seen.append(per)
    # contexts by how often they occur, shorter first where equal, so that a context's suffixes are kept with it
    keys: list[tuple[int, int, int]] = []
    for k in range(1, order + 1):
        ctx = np.concatenate([s[k][0] for s in seen]) if seen else np.zeros(0, np.uint64)
        n = np.concatenate([s[k][2] for s in seen]) if seen else np.zeros(0, np.int64)
        u, inv = np.unique(ctx, return_inverse=True)
        total = np.bincount(inv, n, len(u)) if len(u) else np.zeros(0)
        keys += [(-int(t), k, int(c)) for c, t in zip(u, total, strict=True) if t >= 3]
    keys = sorted(keys)[: nodes - 1]
    ids: dict[tuple[int, int], int] = {(0, 0): 0}
    child = np.full((len(keys) + 2, 256), len(keys) + 1, np.int32)  # the last row is that of no context
    parent = [-1]
    for _, k, c in sorted(keys, key=lambda x: x[1]):
        up = ids.get((k - 1, c & ((1 << (8 * (k - 1))) - 1)))
        if up is not None:
            ids[k, c] = len(parent)
            child[up, c >> (8 * (k - 1))] = len(parent)
            parent.append(up)
    where = {k: {c: i for (kk, c), i in ids.items() if kk == k} for k in range(order + 1)}
    counted = []
    for per in seen:
        cells, number = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (ctx, sym, n) in enumerate(per):
            at = np.array([where[k].get(int(c), -1) for c in ctx], np.int64)
            cells.append(at[at >= 0] * 256 + sym[at >= 0])
            number.append(n[at >= 0])
        counted.append((np.concatenate(cells), np.concatenate(number)))
    pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(c for c, _ in counted)]))
    row = np.full(len(parent) * 256, -1, np.int32)
    row[pairs] = np.arange(len(pairs))
    bits, escape = np.zeros((max(1, len(pairs)), len(langs)), np.float32), np.zeros((len(parent), len(langs)), np.float32)
    for li, (cells, number) in enumerate(counted):
        counts = np.zeros(len(parent) * 256)
        counts[cells] = number
        counts = counts.reshape(len(parent), 256)
        share = np.zeros((len(parent), 256))
        for i in range(len(parent)):
            up = share[parent[i]] if i else np.full(256, 1 / 256)
            c = counts[i]
            n, d = c.sum(), np.count_nonzero(c)
            if not d:
                share[i] = up
            elif d == 256:
                share[i] = c / n
            else:
                out = d / (n + d) / up[c == 0].sum()
                share[i] = np.where(c > 0, c / (n + d), out * up)
                escape[i, li] = -np.log2(out)
        bits[: len(pairs), li] = -np.log2(share.ravel()[pairs])
    return Model(langs, child, np.array(parent, np.int32), row, bits, escape, order)


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = 800, least: int = 16, order: int = 4, nodes: int = 6000) -> Model:
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and lang is not null and text is not null")
    found = rows.groupBy("lang").count().collect()  # a row a language
    if not found:
        return train({}, order, nodes)
    each = max(least, docs // len(found))
    # twice as many as are wanted pass a threshold of their hash; those of the smallest hash are taken of them
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    share = df.sparkSession.createDataFrame([(r["lang"], int(min(1.0, (2 * each + 64) / r["count"]) * (1 << 30))) for r in found], "lang string, upto long")
    if len(found) <= 100_000:
        share = F.broadcast(share)  # a row a language, counted just now
    near = rows.withColumn("spot", spot).join(share, "lang").where("spot < upto").groupBy("lang", "spot").agg(F.min("text").alias("text"))
    sample = near.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("spot"))).where(F.col("n") <= each)
    texts: dict[str, list[bytes]] = {r["lang"]: [] for r in found}
    for lang, text in sorted((r["lang"], r["text"]) for r in sample.select("lang", "text").collect()):
        texts[lang].append(text.encode())
    return train({k: v for k, v in texts.items() if v}, order, nodes)


def _predict(model: Model, texts: pa.Array) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not model.langs or not len(texts):
        return langs, scores
    texts = pa.array(texts, pa.large_binary()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_binary())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    bits = model.lengths(data, off)
    best = bits.argmin(axis=1)
    p = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
    for k in range(len(texts)):
        text = data[off[k] : off[k + 1]]
        if _ASCII_LETTER.search(text) or has_letter(bytes(text).decode("utf-8", "ignore")):
            langs[k], scores[k] = model.langs[best[k]], float(min(1.0, p[k]))
    return langs, scores


def predict(df: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) and the two of the prediction, which replace columns of their
    names. The model is of bounded size and broadcast."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in (lang_out, score_out)]
    rows = df.select(*keep, F.col(text_col).cast("string").alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in (part for batch in batches for part in few(batch, 1024, 4 << 20)):
            langs, scores = _predict(shared.value, b.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, lang_out, score_out])
        give_back()

    schema = df.select(*keep).schema.add(lang_out, "string").add(score_out, "double")
    return rows.mapInArrow(run, schema)


def op7_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")
