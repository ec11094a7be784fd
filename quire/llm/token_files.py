"""Token ids in binary files: an adaptive context-mixing range coder over independent blocks.

Documents are dealt by id into ranges (a shard each, in order) and tokenized whole. A file row
holds a segment: some whole documents' ids, cut into blocks of 2048 ids. A block is coded by itself, from fresh
models, and carries the crc32 of its ids, so any block can be read or found damaged alone.

Within a block three orders predict the next id. Order 2 and order 1 each name the id that last followed the
two ids or the id before, with a probability learned for how often in a row that came true. Order 0 is the distribution of the
ids so far: their counts, taken anew at the positions of ``REFRESH``, and, with as many counts as there are distinct
ids, an escape to all ids alike. The three are mixed linearly; an order's weight is the mean probability that it gave to what came, lately.
The mixture is coded in intervals of the range: first the named id (order 2's, else order 1's; its share is what the mixture
gives it, from both orders if they agree) or another, then of another the id in order 0, then where that escapes the id itself.

The range coder keeps 48 bits and moves 16 at a time; carries are settled at the end. Its numbers are doubles that hold whole
numbers below 2**53 exactly, and probabilities change by single IEEE operations, so files read the same everywhere.

Coding runs in numpy over all blocks of a task side by side (one step per position in a block), at most
``LANES`` at a time, in about 25 kB for each.

A null text is the empty one; each document ends with the end id. Null ids come first. Rows that repeat an id stand
next to each other in order of text, each with its own start. Columns beside the two that are named are never read, so their
names can't clash. A text is in memory whole, with 4 bytes for each of its ids; there is no other bound on its
length. Ids of tokens lie below 2**16 (checked on writing). An empty table gives no rows. The files are in
Parquet containers, written by Spark's committer.

Tokenizing: a space that other text follows starts a piece of the pre-tokenizer, so texts are cut there, and the library
encodes each distinct word of a batch once. A piece never goes on from a letter to what is none, so a word is cut again where that first happens
(between ASCII characters), and its two parts are encoded once each: most new words are known ones with a comma, say. Of the parts some are remembered (``KNOWN``, ``BYTES``). Texts where a space stands
between white space or between it and the end, and any with ``<|``, go through the library whole. Only a
byte-level BPE tokenizer with the usual split is taken that way; with any other, all texts go through the library.
"""

from __future__ import annotations

import json
import math
import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import give_back, input_bytes, materialize, shared_dir, shuffle_partitions, table

BLOCK, LANES, SEGMENT = 2048, 4096, 1 << 18
MAGIC = b"QTK2"
U32 = np.uint32
SLOTS2, SLOTS1 = 256, 128
REFRESH = (32, 96, 224, 448, 832, 1344)
#: One position is worth 12 bits for the choice of an order; the coder's range is 2**32 at least before each.
CHOICE, ROOM, WORD = 4096.0, 2.0**32, 65536.0
#: An id by itself is worth 16 bits and takes a range of this at least.
ENOUGH = 2.0**26
#: What keeps a rounded quotient from lying above the true one.
BELOW = 1 - 2.0**-45
SLICE = 128
_P1, _P2 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text that are tokenized together; a longer text is taken alone.
TAKE = 6 << 20


class Lanes:
    """Predictions of n blocks and the state of their range coders, the same for coder and decoder."""

    def __init__(self, n: int):
        lane = np.arange(n)
        self.base2, self.base1, self.base_k = lane * SLOTS2, lane * SLOTS1, lane * 9
        # id, times in a row << 16 (0: nothing yet), check of the context << 19
        self.held2, self.held1 = np.zeros(n * SLOTS2, U32), np.zeros(n * SLOTS1, U32)
        # by times in a row; 0 and 8 (another context's) name nothing
        start = np.minimum(400.0 * np.arange(1, 10), 3600.0)
        start[[0, 8]] = 0
        self.p2, self.p1 = np.tile(start, n), np.tile(start, n)
        self.w2, self.w1, self.w0 = np.full(n, 1024.0), np.full(n, 1024.0), np.full(n, 512.0)
        self.prev, self.prev2 = np.zeros(n, U32), np.zeros(n, U32)
        self.range, self.at, self.step = np.full(n, 2.0**48), lane.copy(), 0
        self._weigh()

    def cut(self, n: int) -> None:
        """Only the first n lanes go on."""
        for k in ("base2", "base1", "base_k", "w2", "w1", "w0", "v2", "v1", "prev", "prev2", "range", "at"):
            setattr(self, k, getattr(self, k)[:n])

    def _weigh(self) -> None:
        w = self.w2 + self.w1 + self.w0
        self.v2, self.v1 = self.w2 / w, self.w1 / w

    def predict(self) -> None:
        """The id that order 2, else order 1, names, and its share of CHOICE in the mixture."""
        h1 = self.prev * U32(2654435769)
        h2 = (h1 + self.prev2 * U32(81007)) * U32(73244475)
        self.s2 = (h2 >> U32(8) & U32(SLOTS2 - 1)) + self.base2
        self.s1 = (h1 >> U32(10) & U32(SLOTS1 - 1)) + self.base1
        # all places exist; "clip" only saves looking for one that doesn't
        e2, e1 = self.held2.take(self.s2, mode="clip"), self.held1.take(self.s1, mode="clip")
        h2 &= U32(0xFFF80000)
        h1 &= U32(0xFFF80000)
        self.h2, self.h1 = h2, h1
        self.k2, self.k1 = k2, k1 = np.minimum((e2 ^ h2) >> U32(16), U32(8)), np.minimum((e1 ^ h1) >> U32(16), U32(8))
        self.c2, self.c1 = e2 & U32(65535), e1 & U32(65535)
        self.at2, self.at1 = k2 + self.base_k, k1 + self.base_k
        self.a2, self.a1 = self.p2.take(self.at2, mode="clip"), self.p1.take(self.at1, mode="clip")
        self.c = np.where(self.a2, self.c2, self.c1)
        f = self.a1 * self.v1
        f *= self.c == self.c1
        f += self.a2 * self.v2
        self.f = np.floor(f, out=f)

    def learn(self, x: np.ndarray) -> None:
        """The ids that came."""
        e2, e1 = x == self.c2, x == self.c1
        e2 &= self.a2 > 0
        e1 &= self.a1 > 0
        self.step += 1
        if self.step % 4 == 1:  # every fourth position teaches the probabilities and the weights
            g2, g1 = e2 * 4000.0 - self.a2, e1 * 4000.0 - self.a1
            self.p2[self.at2] = self.a2 + g2 * 0.125
            self.p1[self.at1] = self.a1 + g1 * 0.125
            # 4000 less what is missing is the probability that an order gave to what came
            self.w2 += (4000.0 - np.abs(g2) - self.w2) * 0.125
            self.w1 += (4000.0 - np.abs(g1) - self.w1) * 0.125
            self.w0 += (4064.0 - 4000.0 * (e2 | e1) - self.w0) * 0.125
            self._weigh()
        one = U32(1)
        self.held2[self.s2] = np.minimum(self.k2 * e2 + one, U32(7)) << U32(16) | self.h2 | x
        self.held1[self.s1] = np.minimum(self.k1 * e1 + one, U32(7)) << U32(16) | self.h1 | x
        self.prev2, self.prev = self.prev, x


def _turned(a: np.ndarray) -> np.ndarray:
    """Columns as rows; some rows at a time, since numpy alone jumps through all of them for each column."""
    out = np.empty(a.shape[::-1], a.dtype)
    for lo in range(0, len(a), 64):
        out[:, lo : lo + 64] = a[lo : lo + 64].T
    return out


def _sorted(sizes: list[int]) -> list[list[int]]:
    """Blocks in descending size, in parts of LANES."""
    order = sorted(range(len(sizes)), key=lambda b: -sizes[b])
    return [order[lo : lo + LANES] for lo in range(0, len(order), LANES)]


def encode_blocks(blocks: list[np.ndarray], vocabulary: int = 1 << 16) -> list[bytes]:
    """Each block's bytes; blocks of at most BLOCK ids."""
    if vocabulary > 1 << 16 or max((int(b.max()) for b in blocks if len(b)), default=0) >= vocabulary:
        raise ValueError("a token id is beyond the vocabulary, or the vocabulary beyond 2**16")
    out: list[bytes] = [b""] * len(blocks)
    for part in _sorted(list(map(len, blocks))):
        for b, data in zip(part, _encode([blocks[b] for b in part], vocabulary), strict=True):
            out[b] = data
    return out


def _dense(ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each lane (a row): ids as numbers from 1 in order of id, where ids are new, and the largest number."""
    n, steps = ids.shape
    number, new = np.zeros(n * steps, np.int16), np.zeros(n * steps, bool)
    place = np.arange(SLICE)[:, None] * steps
    for lo in range(0, n, SLICE):
        s = ids[lo : lo + SLICE].astype(np.int32)
        if size[min(lo + SLICE, n) - 1] < steps:  # an id beyond all fills up shorter blocks
            s[np.arange(steps) >= size[lo : lo + SLICE, None]] = 1 << 16
        s = s << 11 | np.arange(steps, dtype=np.int32)
        s.sort(axis=1)
        at = (s & 2047) + (place[: len(s)] + lo * steps)
        s >>= 11
        first = np.ones(s.shape, bool)
        np.not_equal(s[:, 1:], s[:, :-1], out=first[:, 1:])
        number[at] = np.cumsum(first, axis=1, dtype=np.int32)
        new[at] = first
    return number.reshape(n, steps), new.reshape(n, steps), int(number.max(initial=0))


def _encode(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    n, size = len(blocks), np.array(list(map(len, blocks)))
    steps = int(size[0])
    ids = np.zeros((n, steps), np.uint16)
    for k, b in enumerate(blocks):
        ids[k, : len(b)] = b
    number, new, wide = _dense(ids, size)
    ids, number = _turned(ids), _turned(number)
    m, low = Lanes(n), np.zeros(n)
    words = np.zeros((3 * steps + 8) * n, U32)
    all_low, all_at = low, m.at
    # how many ids so far have a number up to this one; from 0 on
    upto = np.zeros((n, wide + 1), np.int16)
    flat, home = upto.ravel(), np.arange(n, dtype=np.int32) * (wide + 1)
    seen, distinct = 0, np.zeros(n)
    total = escape = np.ones(n)
    part = BELOW / total
    refresh = set(REFRESH)

    def emit(i) -> None:
        """Moves 16 bits of the lanes i, until their ranges have room."""
        while len(i):
            at, held, wide_ = m.at[i], low[i], m.range[i] * WORD
            word = np.floor(held * (1 / ROOM))
            words[at] = word
            m.at[i], low[i], m.range[i] = at + n, (held - word * ROOM) * WORD, wide_
            i = i[wide_ < ROOM]

    for t in range(steps):
        live = len(low)
        if size[live - 1] <= t:
            live = int(np.searchsorted(-size, -t, "left"))
            m.cut(live)
            low, home, total, escape, part, distinct = low[:live], home[:live], total[:live], escape[:live], part[:live], distinct[:live]
        if t in refresh:
            for lo in range(0, live, SLICE):
                fresh = number[seen:t, lo : min(live, lo + SLICE)]
                k = fresh.shape[1]
                counts = np.bincount((fresh + home[:k]).ravel(), minlength=k * (wide + 1)).reshape(k, wide + 1)
                upto[lo : lo + k] += np.cumsum(counts, axis=1, dtype=np.int16)
            distinct = distinct + np.count_nonzero(new[:live, seen:t], axis=1)
            seen, escape, total = t, distinct, distinct + t
            part = BELOW / total
        x = ids[t, :live].astype(U32)
        m.predict()
        miss = x != m.c
        miss |= m.f == 0
        other = miss.astype(float)
        r = np.floor(m.range * (1 / CHOICE))
        skip = m.f * other
        low += r * skip
        # f where the named id came, else CHOICE - f
        r *= np.abs(CHOICE * other - m.f)
        r *= part
        np.floor(r, out=r)
        g = number[t, :live] + home
        below, count = flat.take(g - 1, mode="clip"), flat.take(g, mode="clip")
        count -= below
        unseen = count == 0
        unseen &= miss
        i = np.flatnonzero(unseen)
        below[i], count[i] = seen, escape[i]
        low += r * (below * other)
        # count where another id came, else total
        count = count - total
        count *= other
        count += total
        r *= count
        m.range = r
        if len(i):
            emit(i[m.range[i] < ENOUGH])
            r = np.floor(m.range[i] * (BELOW / vocabulary))
            low[i] += r * x[i]
            m.range[i] = r
        # about half of all lanes move 16 bits: all write them, and those that don't move will write there again
        word = np.floor(low * (1 / ROOM))
        words[m.at] = word
        full = m.range < ROOM
        move = full.astype(float)
        word *= move
        word *= ROOM
        low -= word
        move *= WORD - 1
        move += 1
        low *= move
        m.range *= move
        m.at += full * n
        emit(np.flatnonzero(m.range < ROOM))
        m.learn(x)
    for _ in range(3):
        word = np.floor(all_low * (1 / ROOM))
        words[all_at] = word
        all_low[:] = (all_low - word * ROOM) * WORD
        all_at += n
    ends = all_at // n
    rows = words.reshape(-1, n)[: ends.max()]
    for j in range(len(rows) - 1, 0, -1):
        rows[j - 1] += rows[j] >> U32(16)
    settled = _turned(rows.astype("<u2"))
    return [settled[k, : ends[k]].tobytes() for k in range(n)]


def decode_blocks(data: list[bytes], sizes: list[int], vocabulary: int = 1 << 16) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.zeros(0, U32)] * len(data)
    for part in _sorted(sizes):
        for b, ids in zip(part, _decode([data[b] for b in part], np.array([sizes[b] for b in part]), vocabulary), strict=True):
            out[b] = ids
    return out


def _counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order 0 of lanes (columns) of t ids each: a row of t + 1 spots for each lane, and the numbers of distinct ids.

    A spot holds id << 32 | first spot of that id << 16 | number of its spots; the last is the escape.
    """
    t, n = ids.shape
    table, distinct = np.empty((n, t + 1), np.int64), np.empty(n)
    for lo in range(0, n, SLICE):
        s = _turned(ids[:, lo : lo + SLICE]).astype(np.int32)  # numpy sorts 32 bits several times faster than 16
        s.sort(axis=1)
        first = np.ones(s.shape, bool)
        np.not_equal(s[:, 1:], s[:, :-1], out=first[:, 1:])
        many = np.count_nonzero(first, axis=1)
        at = np.flatnonzero(first)
        run = np.diff(at, append=first.size)
        spot = at - np.repeat(np.arange(len(s)) * t, many)
        spots = table[lo : lo + len(s)]
        spots[:, :t] = np.repeat(s.ravel()[at].astype(np.int64) << 32 | spot << 16 | run, run).reshape(s.shape)
        spots[:, t] = many + (t << 16)
        distinct[lo : lo + len(s)] = many
    return table, distinct


def _decode(data: list[bytes], size: np.ndarray, vocabulary: int) -> list[np.ndarray]:
    n, steps = len(data), int(size[0])
    held = np.zeros((n, max(map(len, data)) // 2 + 4), np.uint16)
    for k, d in enumerate(data):
        held[k, : len(d) // 2] = np.frombuffer(d, "<u2", len(d) // 2)
    m, words, last = Lanes(n), _turned(held), held.size - 1
    code = words[0] * ROOM + words[1] * WORD + words[2]
    words = words.ravel()
    m.at += 3 * n
    ids = np.zeros((steps, n), np.uint16)
    seen, table, home = 0, np.full(n, 1, np.int64), np.arange(n)
    total = np.ones(n)
    part = BELOW / total
    refresh = set(REFRESH)

    def take(i) -> None:
        while len(i):
            at, wide = m.at[i], m.range[i] * WORD
            # a damaged block may ask for more than there is; its sum tells
            code[i] = code[i] * WORD + words[np.minimum(at, last)]
            m.at[i], m.range[i] = at + n, wide
            i = i[wide < ROOM]

    for t in range(steps):
        live = len(code)
        if size[live - 1] <= t:
            live = int(np.searchsorted(-size, -t, "left"))
            m.cut(live)
            code, home, total, part = code[:live], home[:live], total[:live], part[:live]
        if t in refresh:
            table, distinct = _counts(ids[:t, :live])
            seen, total, home = t, distinct + t, np.arange(live) * (t + 1)
            part = BELOW / total
            table = table.ravel()
        m.predict()
        r = np.floor(m.range * (1 / CHOICE))
        f = r * m.f
        miss = code >= f
        other = miss.astype(float)
        code -= f * other
        r *= np.abs(CHOICE * other - m.f)
        r *= part
        np.floor(r, out=r)
        spot = np.floor(code / r)
        np.minimum(spot, float(seen), out=spot)
        spot *= other
        e = table.take(spot.astype(np.int64) + home, mode="clip")
        below, count = (e >> 16 & 65535).astype(float), (e & 65535) - total
        i = np.flatnonzero(miss & (below == seen))
        below *= other
        below *= r
        code -= below
        count *= other
        count += total
        r *= count
        m.range = r
        x = np.where(miss, (e >> 32).astype(U32), m.c)
        if len(i):
            take(i[m.range[i] < ENOUGH])
            r = np.floor(m.range[i] * (BELOW / vocabulary))
            c = code[i]
            v = np.minimum(np.floor(c / r), vocabulary - 1.0)
            x[i], code[i], m.range[i] = v, c - r * v, r
        # all lanes look at what comes, and about half take it
        full = m.range < ROOM
        move = full.astype(float)
        word = words.take(m.at, mode="clip") * move
        move *= WORD - 1
        move += 1
        code *= move
        code += word
        m.range *= move
        m.at += full * n
        take(np.flatnonzero(m.range < ROOM))
        x &= U32(65535)
        ids[t, :live] = x
        m.learn(x)
    out = []
    for lo in range(0, n, SLICE):
        rows = _turned(ids[:, lo : lo + SLICE]).astype(U32)
        out += [row[:m] for row, m in zip(rows, size[lo : lo + SLICE], strict=True)]
    return out


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray], vocabulary: int) -> tuple[bytes, list[np.ndarray]]:
    """The head of a segment without its block table, and the blocks to code."""
    joined = np.concatenate(ids) if ids else np.zeros(0, U32)
    if vocabulary <= 1 << 16:
        joined = joined.astype(np.uint16)
    blocks = [joined[i : i + BLOCK] for i in range(0, len(joined), BLOCK)]
    head = struct.pack("<4sIIQI", MAGIC, len(doc_ids), vocabulary, len(joined), len(blocks))
    head += np.array([d is not None for d in doc_ids], np.uint8).tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    return head + np.array(list(map(len, ids)), "<u4").tobytes(), blocks


def close_segment(head: bytes, blocks: list[np.ndarray], coded: list[bytes]) -> bytes:
    sizes = np.array(list(map(len, coded)), "<u4").tobytes()
    sums = np.array([zlib.crc32(b.astype("<u4")) for b in blocks], "<u4").tobytes()
    head = head + sizes + sums
    return b"".join([struct.pack("<I", zlib.crc32(head)), head, *coded])


class Segment:
    """What a segment's head says; blocks hold (bytes, number of ids, crc32)."""

    def __init__(self, data: bytes):
        magic, docs, self.vocabulary, total, n = struct.unpack_from("<4sIIQI", data, 4)
        at = 4 + struct.calcsize("<4sIIQI")
        end = at + docs * 13 + n * 8
        if magic != MAGIC or zlib.crc32(data[4:end]) != struct.unpack_from("<I", data)[0]:
            raise ValueError("damaged segment head")
        valid = np.frombuffer(data, np.uint8, docs, at)
        self.doc_ids = [int(d) if v else None for v, d in zip(valid, np.frombuffer(data, "<i8", docs, at + docs), strict=True)]
        self.counts = np.frombuffer(data, "<u4", docs, at + 9 * docs).astype(np.int64)
        sizes, sums = np.frombuffer(data, "<u4", 2 * n, at + 13 * docs).astype(np.int64).reshape(2, n)
        starts = end + np.concatenate([[0], np.cumsum(sizes)])
        self.blocks = [(data[starts[i] : starts[i + 1]], min(BLOCK, total - i * BLOCK), int(sums[i])) for i in range(n)]


class Known:
    """Words that are remembered, under numbers from 0 on: a hash table over their bytes, looked up for many words at once."""

    def __init__(self, most: int, most_bytes: int):
        self.most, self.most_bytes = most, most_bytes
        self.slots = np.full(1 << (2 * most - 1).bit_length(), -1, np.int32)
        self.hashes, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.data = np.zeros(8, np.uint8)
        self.seed = np.uint64(int.from_bytes(os.urandom(8), "little"))

    @staticmethod
    def _part(data: np.ndarray, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8 k to 8 k + 7 of each word, as one number; what lies behind a word is 0. Data must end 8 bytes behind the last word."""
        every = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        left = np.minimum(size - 8 * k, 8).astype(np.uint64)
        return every[start + 8 * k] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * left))

    def hash(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = size.astype(np.uint64) * _P1 + self.seed
        on, k = np.flatnonzero(size > 0), 0
        while len(on):
            x = (h[on] ^ self._part(data, start[on], size[on], k)) * _P2
            h[on] = (x ^ (x >> np.uint64(29))) * _P1
            k += 1
            on = on[size[on] > 8 * k]
        return h ^ (h >> np.uint64(32))

    def find(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word, -1 where it is not remembered, and the words' hashes."""
        h, mask = self.hash(data, start, size), np.uint64(len(self.slots) - 1)
        out, on = np.full(len(h), -1, np.int64), np.arange(len(h))
        at = (h & mask).astype(np.int64)
        while len(on):
            got = self.slots[at]
            same = np.flatnonzero(got >= 0)
            same = same[self.hashes[got[same]] == h[on[same]]]
            out[on[same]] = got[same]
            go = (got >= 0) & (out[on] < 0)
            on, at = on[go], (at[go] + 1) & int(mask)
        # a hash may be that of another word: bytes decide
        on = np.flatnonzero(out >= 0)
        wrong, k = self.size[out[on]] != size[on], 0
        out[on[wrong]] = -1
        on = on[~wrong]
        on = on[size[on] > 0]
        while len(on):
            wrong = self._part(self.data, self.start[out[on]], size[on], k) != self._part(data, start[on], size[on], k)
            out[on[wrong]] = -1
            on, k = on[~wrong], k + 1
            on = on[size[on] > 8 * k]
        return out, h

    def add(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> bool:
        """Numbers distinct words that are not remembered, if there is room for all of them."""
        first, total = len(self.hashes), int(size.sum())
        if first + len(h) > self.most or len(self.data) + total > self.most_bytes:
            return False
        ends = np.cumsum(size)
        fresh = data[np.repeat(start - (ends - size), size) + np.arange(total)]
        self.start = np.concatenate([self.start, (len(self.data) - 8 + ends - size).astype(np.int32)])
        self.data = np.concatenate([self.data[:-8], fresh, np.zeros(8, np.uint8)])
        self.hashes, self.size = np.concatenate([self.hashes, h]), np.concatenate([self.size, size.astype(np.int32)])
        at, on, mask = (h & np.uint64(len(self.slots) - 1)).astype(np.int64), np.arange(first, first + len(h), dtype=np.int32), len(self.slots) - 1
        while len(on):
            free = self.slots[at] < 0
            self.slots[at[free]] = on[free]  # of several for one slot, one gets it
            go = self.slots[at] != on
            on, at = on[go], (at[go] + 1) & mask
        return True


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of large strings (8 more behind them), where each begins and its size."""
    off = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return np.concatenate([data, np.zeros(8, np.uint8)]), off[:-1] - off[0], np.diff(off)


def _gather(ids: np.ndarray, starts: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces pick, joined, and where each begins (and the last ends)."""
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(4 * starts), pa.py_buffer(ids)])
    taken = pieces.take(pa.array(pick))
    upto = np.frombuffer(taken.buffers()[1], np.int64, len(pick) + 1) // 4
    return np.frombuffer(taken.buffers()[2] or b"", U32, upto[-1]), upto


class Memory:
    """Strings that were encoded, and their ids; call encodes others: (ids, joined, and how many each has)."""

    def __init__(self, most: int, most_bytes: int, call):
        self.known, self.call, self.ids, self.starts = Known(most, most_bytes), call, np.zeros(0, U32), np.zeros(1, np.int64)

    def look(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, where in them each piece begins (and the last ends), and which piece each of distinct words is."""
        data, start, size = _bytes(words)
        at, h = self.known.find(data, start, size)
        fresh = np.flatnonzero(at < 0)
        ids, n = self.call(words.take(pa.array(fresh)))
        at[fresh] = len(self.starts) - 1 + np.arange(len(fresh))
        starts, ids = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n)]), np.concatenate([self.ids, ids])
        # frequent words come early, so what is full stays as it is
        if self.known.add(data, start[fresh], size[fresh], h[fresh]):
            self.starts, self.ids = starts, ids
        return ids, starts, at


class Tokenizer:
    _WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
    #: Texts where a space may be no start of a piece, or where an added token may be.
    _WHOLE = f"{_WHITE} (?:{_WHITE}|$)|<\\|"
    #: Words behind a space, and what stands behind no space.
    KNOWN, BYTES = (1 << 20, 1 << 17), (3 << 22, 3 << 19)
    #: ASCII letters are 1, the rest of ASCII 2.
    _KIND = np.array([0 if c > 127 else 1 if chr(c).isalpha() else 2 for c in range(256)], np.uint8)

    def __init__(self, path: str):
        # a task has one core; the library's threads would take those of other tasks, and wait for each other
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tokenizers

        self.own = tokenizers.Tokenizer.from_file(path)
        self.vocabulary = self.own.get_vocab_size()
        plan = json.loads(self.own.to_str())
        split = plan.get("pre_tokenizer") or {}
        self.split = plan.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and all(x["content"].startswith("<|") for x in plan.get("added_tokens", []))
        # "Ġ" is how a byte-level vocabulary writes the space
        self.opens = np.array([(self.own.id_to_token(i) or "").startswith("Ġ") for i in range(self.vocabulary)])
        self.words, self.others = (Memory(n, size, call) for n, size, call in zip(self.KNOWN, self.BYTES, (self._words, self._each), strict=True))

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        call = getattr(self.own, "encode_batch_fast", self.own.encode_batch)
        return [np.array(e.ids, U32) for e in call(texts, add_special_tokens=False)]

    def _each(self, texts: pa.Array, lead: str = "") -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, joined, and how many each has."""
        each = self._library([lead + t for t in texts.to_pylist()])
        return np.concatenate([np.zeros(0, U32), *each]), np.array(list(map(len, each)), np.int64)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of words behind a space each, 256 in a line."""
        lines = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(words), 256), len(words)), pa.int32()), words)
        ids = np.concatenate([np.zeros(0, U32), *self._library([" " + x for x in pc.binary_join(lines, pa.scalar(" ", pa.large_string())).to_pylist()])])
        start = np.flatnonzero(self.opens[ids])
        if len(start) != len(words):  # a vocabulary that writes spaces in another way
            return self._each(words, " ")
        return ids, np.diff(np.append(start, len(ids)))

    def _look(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, where in them each piece begins (and the last ends), and which piece each distinct word behind a space is."""
        data, start, size = _bytes(names)
        kind = self._KIND[data]
        # places of ASCII that is no letter behind a letter; of each word the first, or its end
        turn = np.append(np.flatnonzero((kind[1:] == 2) & (kind[:-1] == 1)) + 1, len(data))
        left = np.minimum(turn[np.searchsorted(turn, start, "right")] - start, size)
        ends = np.append(np.stack([start, start + left], axis=1).ravel(), len(data) - 8)
        parts = pa.Array.from_buffers(pa.large_string(), 2 * len(start), [None, pa.py_buffer(ends), pa.py_buffer(data)])
        front = parts.take(pa.array(np.arange(0, 2 * len(start), 2))).dictionary_encode()
        ids, starts, at = self.words.look(front.dictionary)
        at = at[front.indices.to_numpy()]
        both = np.flatnonzero(left < size)
        back = parts.take(pa.array(2 * both + 1)).dictionary_encode()
        ids_b, starts_b, at_b = self.others.look(back.dictionary)
        first = len(starts) - 1
        pick = np.stack([at[both], first + at_b[back.indices.to_numpy()]], axis=1).ravel()
        joined, upto = _gather(np.concatenate([ids, ids_b]), np.append(starts, starts[-1] + starts_b[1:]), pick)
        at[both] = first + np.arange(len(both))
        return np.concatenate([ids, joined]), np.append(starts, starts[-1] + upto[2::2]), at

    def encode(self, texts: list[str] | pa.Array, end: int) -> list[np.ndarray]:
        """Ids of each text with the end id."""
        texts = pa.array(texts, pa.large_string()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_string())
        plain = pc.invert(pc.match_substring_regex(texts, self._WHOLE)) if self.split else pa.array([False] * len(texts), pa.bool_())
        plain = plain.to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, U32)] * len(texts)
        whole = np.flatnonzero(~plain)
        for i, ids in zip(whole, self._library(texts.take(pa.array(whole)).to_pylist()), strict=True):
            out[i] = np.append(ids, U32(end))
        which = np.flatnonzero(plain)
        if not len(which):
            return out
        cut = pc.split_pattern(texts.filter(pa.array(plain)) if len(whole) else texts, " ")
        off = cut.offsets.to_numpy().astype(np.int64)
        off -= off[0]
        every = cut.flatten()
        words = every.dictionary_encode()
        ids, starts, at = self._look(words.dictionary)
        # a text's first word stands behind no space
        heads = every.take(pa.array(off[:-1])).dictionary_encode()
        own = self._library(heads.dictionary.to_pylist())
        pick = at[words.indices.to_numpy()]
        pick[off[:-1]] = len(starts) - 1 + heads.indices.to_numpy()
        starts = np.concatenate([starts, starts[-1] + np.cumsum(list(map(len, own)))])
        ids = np.concatenate([ids, *own])
        flat, upto = _gather(ids, starts, pick)
        upto = upto[off]
        joined = np.empty(len(flat) + len(which), U32)
        for k, (i, a, b) in enumerate(zip(which, upto[:-1].tolist(), upto[1:].tolist(), strict=True)):
            joined[a + k : b + k] = flat[a:b]
            joined[b + k] = end
            out[i] = joined[a + k : b + k + 1]
        return out


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def write_tokens(df: DataFrame, path: str, model: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shards: int | None = None) -> None:
    """Writes (shard, seq, n_docs, n_ids, segment) rows below path. Shards grow with the input: one for 64 MB of it."""
    shards = shards or max(shuffle_partitions(df.sparkSession), math.ceil(input_bytes(df) / (64 << 20)))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(shards, F.asc_nulls_first("id")).sortWithinPartitions(F.asc_nulls_first("id"), "text")

    def run(batches):
        own, shard, seq = tokenizer(model), TaskContext.get().partitionId(), 0
        vocabulary = max(own.vocabulary, end_id + 1)
        docs, ids, held = [], [], 0
        open_: list[tuple[bytes, list[np.ndarray], int, int]] = []

        def flush():
            nonlocal seq
            coded = iter(encode_blocks([b for _, blocks, _, _ in open_ for b in blocks], vocabulary))
            for head, blocks, n_docs, n_ids in open_:
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64()), pa.array([close_segment(head, blocks, [next(coded) for _ in blocks])], pa.binary())], ["shard", "seq", "n_docs", "n_ids", "segment"])
                seq += 1
            open_.clear()

        def close():
            nonlocal docs, ids, held
            if docs:
                open_.append((*pack_segment(docs, ids, vocabulary), len(docs), held))
            docs, ids, held = [], [], 0

        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1)
            upto = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(upto, upto[at] + TAKE, "right")) - 1)
                for name, got in zip(names[at:to], own.encode(texts.slice(at, to - at), end_id), strict=True):
                    docs.append(name)
                    ids.append(got)
                    held += len(got)
                    if held >= SEGMENT:
                        close()
                        if sum(len(x[1]) for x in open_) > LANES - SEGMENT // BLOCK:
                            yield from flush()
                at = to
        close()
        yield from flush()
        give_back()

    rows.mapInArrow(run, "shard int, seq int, n_docs long, n_ids long, segment binary").write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before; ids are little-endian 32-bit, as one binary. A damaged block is an error that names it.

    With ``digest``, ids_crc32 in place of ids: the crc32 of that binary, taken where the ids are decoded, so that they need not travel."""
    files = spark.read.schema("shard int, seq int, n_docs long, n_ids long, segment binary").parquet(path)
    # a row for each segment; the table grows by one row per quarter million ids
    from pyspark.sql import Window as W

    sums = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = sums.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("shard").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(files.select("shard", "seq", inside.alias("inside")).join(before, "shard").select("shard", "seq", (F.col("inside") + F.col("shard_start")).alias("start")))
    rows = files.join(starts, ["shard", "seq"]).select("start", "segment")

    def run(batches):
        held: list[tuple[int, Segment]] = []

        def flush():
            blocks = [b for _, s in held for b in s.blocks]
            vocabulary = max([s.vocabulary for _, s in held], default=1)
            got = decode_blocks([b[0] for b in blocks], [b[1] for b in blocks], vocabulary)
            at = 0
            for start, s in held:
                own = got[at : at + len(s.blocks)]
                for k, (ids, b) in enumerate(zip(own, s.blocks, strict=True)):
                    if zlib.crc32(ids.astype("<u4", copy=False)) != b[2]:
                        raise ValueError(f"damaged block {k} of the segment that starts at id {start}")
                at += len(s.blocks)
                raw = np.concatenate([np.zeros(0, U32), *own]).astype("<u4", copy=False)
                ends = np.concatenate([[0], np.cumsum(s.counts)])
                if digest:
                    whole = memoryview(raw)
                    last = pa.array([zlib.crc32(whole[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())
                elif 4 * ends[-1] < 1 << 31:
                    last = pa.Array.from_buffers(pa.binary(), len(s.counts), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(raw)])
                else:
                    raise ValueError(f"the text at id {start} has too many ids for a row")
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(start + ends[:-1]), pa.array(s.counts), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
            held.clear()

        for b in batches:
            for start, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Segment(data.as_py())
                if held and (held[0][1].vocabulary != s.vocabulary or sum(len(x.blocks) for _, x in held) + len(s.blocks) > LANES):
                    yield from flush()
                held.append((start, s))
        yield from flush()
        give_back()

    return rows.mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path, digest=True)
