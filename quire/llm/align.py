"""Cross-tokenizer alignment: where two tokenizers cut a text alike, and which of their ids lie under the same bytes.

A is a byte-level BPE on a space and the text, B a piece model on the text, which adds that space itself. Both end a token before a
single space between two characters that are no white space, whatever lies around it, so a text is a sequence of units cut at
these spaces, and a unit's tokens don't depend on its place. The alignment is therefore relational over the *distinct units* of the corpus
instead of all their occurrences: tokens by posexplode, ends by a windowed sum of lengths, an equi-join on (unit, end),
the running count of cuts as group id, links by group. Tokenizers that may cut otherwise (``separable``) get whole texts as units.

Documents lie in blocks of bounded bytes, as numbers of the units that their block holds once each: a text is cut and looked up once. A unit goes through the alignment with
its places, the blocks and its number in each (of ``TOGETHER`` blocks at most; a unit of more is aligned again), and a block's documents meet its units in one task, which writes each document's groups and in how many
documents each pair is linked. These counts are summed over the blocks and joined to each block's pairs; a document's last sums are those of its units,
so its links need not be kept. What is shuffled are a block's documents, its distinct units and pairs,
never an occurrence; neither a hot unit, nor a hot pair, nor many copies of a text make a large group.

Texts that are null, empty, or whose tokens don't spell a space and the text again have no tokens: zeros, an empty string, and no part in any
count. Texts are taken whole; a text (and what its groups look like as a string) must fit a task. Repeated rows are documents of their own. A null id is
kept. Links of a highest count are all those that tie. Only the two named columns are read, so other names can't clash. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import forget_shuffles, give_back, materialize, reading, release, setting, table

#: Characters that are white space, in a form that Java and Python read alike.
_SPACE = r"\t\n\x0B\x0C\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
CUT = rf"(?<=[^{_SPACE}]) (?=[^{_SPACE}])"
_CUT = re.compile(CUT)
_OTHERS = [c for c in map(chr, range(0x3001)) if c != " " and re.match(f"[{_SPACE}]", c)]


def _plain(text: str) -> bool:
    """Whether every space of the text stands between two characters that are no white space."""
    if text[0] == " " or text[-1] == " " or "  " in text:
        return False
    return not any(c in text and (c + " " in text or " " + c in text) for c in _OTHERS)


def cut(text: str, whole: bool = False) -> list[str]:
    """The units of a text that is not empty, without the space before each."""
    if whole:
        return [text]
    return text.split(" ") if _plain(text) else _CUT.split(text)


@lru_cache(2)
def _byte_level(path: str):
    """The tokenizer, and each id's bytes."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    names = t.get_vocab()
    spelled = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        spelled[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode()
    return t, spelled


@lru_cache(2)
def _pieces(path: str):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = [bytes([int(m.id_to_piece(i)[3:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())]
    return m, spelled


def separable(byte_path: str, piece_path: str) -> bool:
    """Whether both tokenizers are known to end a token before such a space: A by its own rule for words, B because no piece goes on behind a word."""
    import json

    from sentencepiece import sentencepiece_model_pb2

    with open(byte_path, encoding="utf-8") as f:
        a = json.load(f)
    pre = a.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or a.get("normalizer"):
        return False
    b = sentencepiece_model_pb2.ModelProto()
    with open(piece_path, "rb") as f:
        b.ParseFromString(f.read())
    n = b.normalizer_spec
    plain = n.name == "identity" and not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and not b.trainer_spec.treat_whitespace_as_suffix
    return plain and not any("▁" in p.piece.lstrip("▁") for p in b.pieces)


def _lists(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
    return np.concatenate([[0], np.cumsum(sizes)]), flat


def tokenized(units: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(uid, places, a, a_bytes, a_ends, b, b_bytes, b_ends): ids and numbers of bytes of the tokens of units (uid, unit, places), and
    the bytes where they end, for whom they are looked up by; none for a unit that a tokenizer does not spell right."""

    def run(batches):
        (ta, bytes_a), (tb, bytes_b) = _byte_level(byte_path), _pieces(piece_path)
        spelled = [pa.array(s, pa.binary()) for s in (bytes_a, bytes_b)]
        lengths = [pc.binary_length(s).to_numpy() for s in spelled]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                texts = part.column(1).to_pylist()
                a = [e.ids for e in ta.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
                b = tb.encode(texts, num_threads=1)
                both = [_lists(a), _lists(b)]
                wrong = np.flatnonzero(~_spelled(texts, both, spelled))
                if len(wrong):
                    for i in wrong:
                        a[i], b[i] = [], []
                    both = [_lists(a), _lists(b)]
                cols = [part.column(0), part.column(2)]
                for (off, flat), of_id in zip(both, lengths, strict=True):
                    n = of_id[flat]
                    end = np.cumsum(n, dtype=np.int64)
                    start = np.concatenate([[0], end])[off[:-1]]
                    cols += [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x, k)) for x, k in ((flat, pa.int32()), (n, pa.int32()), (end - np.repeat(start, np.diff(off)), pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["uid", "places", "a", "a_bytes", "a_ends", "b", "b_bytes", "b_ends"])
        give_back()

    return units.select("uid", "unit", "places").mapInArrow(run, "uid long, places array<long>, a array<int>, a_bytes array<int>, a_ends array<long>, b array<int>, b_bytes array<int>, b_ends array<long>")


def _spelled(texts: list[str], tokens: list[tuple[np.ndarray, np.ndarray]], names: list[pa.Array]) -> np.ndarray:
    """Whether the tokens of each text spell a space and it, by both tokenizers."""
    whole, right = pa.array([b" " + t.encode() for t in texts], pa.binary()), np.ones(len(texts), bool)
    for (off, flat), of_id in zip(tokens, names, strict=True):
        _, ends, joined = of_id.take(pa.array(flat)).buffers()
        at = np.frombuffer(ends, np.int32)[off] if len(flat) else np.zeros(len(off), np.int32)
        right &= pc.equal(pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at), joined or pa.py_buffer(b"")]), whole).to_numpy(zero_copy_only=False)
    return right


def groups(tokens: DataFrame) -> DataFrame:
    """(places, shown): each unit's groups in order, as ``a1,a2|b1;a3|b2,b3``; units without tokens are left out.

    All steps are by unit, so the tokens of tokenized() are dealt out once (``CO_PARTITIONED`` lets the joins on (unit, end)
    and (unit, group) use that), and sorted sums keep their order for the join and the sum behind them (``BY_HASH``).
    """
    dealt = tokens.repartition("uid")

    def ends(side: str) -> DataFrame:
        held = ["places"] if side == "a" else []
        rows = dealt.select("uid", *held, F.posexplode(F.arrays_zip(F.col(side).alias("id"), F.col(f"{side}_bytes").alias("n"))).alias("i", "t"))
        # the first token of A alone carries its unit's places along
        held = [F.when(F.col("i") == 0, F.col("places")).alias("places")] if held else []
        rows = rows.select("uid", *held, "i", "t")
        end = F.sum("t.n").over(W.partitionBy("uid").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
        return rows.select("uid", *(["places"] if held else []), end.alias("end"), F.col("t.id").alias("id"))

    def grouped(side: str, other: str) -> DataFrame:
        # a cut is where both end; a token belongs to the group that the cuts before its end have opened
        others = dealt.select("uid", F.explode(f"{other}_ends").alias("end"), F.lit(1).alias("cut"))
        rows = ends(side).join(others, ["uid", "end"], "left")
        before = F.coalesce(F.sum("cut").over(W.partitionBy("uid").orderBy("end").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        held = [F.first("places", ignorenulls=True).alias("places")] if side == "a" else []
        rows = rows.withColumn("gid", before)
        # ends and ids are below 2^31: both in a long, which sorts faster than a struct
        token = F.shiftleft("end", 32).bitwiseOR(F.col("id").cast("long"))
        ids = F.transform(F.sort_array(F.collect_list(token)), lambda t: t.bitwiseAND(0xFFFFFFFF).cast("string"))
        return rows.groupBy("uid", "gid").agg(F.array_join(ids, ",").alias(side), *held)

    both = grouped("a", "b").join(grouped("b", "a"), ["uid", "gid"])
    one = F.struct("gid", F.concat_ws("|", "a", "b").alias("g"))
    each = both.groupBy("uid").agg(F.first("places", ignorenulls=True).alias("places"), F.sort_array(F.collect_list(one)).getField("g").alias("groups"))
    return each.select("places", F.array_join("groups", ";").alias("shown"))


CO_PARTITIONED = "spark.sql.requireAllClusterKeysForCoPartition"
#: Of lists gathered by key: Spark's hashing gives up after 128 keys and then sorts all rows, twice where a sum by sorting does so once.
BY_HASH = "spark.sql.execution.useObjectHashAggregateExec"
#: Blocks that share the alignment of a unit.
TOGETHER = 4096
IPC = pa.ipc.IpcWriteOptions(compression="zstd")


def _written(t: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, t.schema, options=IPC) as w:
        w.write_table(t)
    return out.getvalue().to_pybytes()


def _read(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


class Place(NamedTuple):
    """A unit's block and its number there as one long, in so many bits."""

    block: int
    unit: int

    def of(self, p: str, k: str):
        task, block = F.shiftright(p, 32), F.col(p).bitwiseAND(0xFFFFFFFF)
        return F.shiftleft(F.shiftleft(task, self.block).bitwiseOR(block), self.unit).bitwiseOR(F.col(k).cast("long"))

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = x >> self.unit
        return (block >> self.block << 32) | (block & ((1 << self.block) - 1)), x & ((1 << self.unit) - 1)


def _numbered(texts: pa.Array, whole: bool) -> tuple[pa.ListArray, pa.Array]:
    """The units of texts as numbers (null for texts that are null or empty), and the distinct units."""
    plain, others = [], []
    for i, text in enumerate(texts.to_pylist()):
        if text:
            (plain if not whole and _plain(text) else others).append(i)
    split = pc.split_pattern(texts.take(pa.array(plain, pa.int64())), " ")
    rest = [cut(t, whole) for t in texts.take(pa.array(others, pa.int64())).to_pylist()]
    sizes = np.concatenate([pc.list_value_length(split).to_numpy(), np.fromiter(map(len, rest), np.int64, len(rest))])
    units = pa.concat_arrays([split.flatten(), pa.array(list(chain.from_iterable(rest)), pa.string())]).dictionary_encode()
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), units.indices)
    order = np.full(len(texts), -1)
    order[[*plain, *others]] = np.arange(len(lists))
    return lists.take(pa.array(order, mask=order < 0)), units.dictionary


def _blocked(docs: DataFrame, block_bytes: int, whole: bool) -> DataFrame:
    """(p, docs, n_units, units) of docs (id, text): blocks of rows of a task, one after another, up to about block_bytes; their documents as
    numbers of units, and their distinct units."""

    def run(batches):
        first, n, waiting, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def block():
            t = pa.concat_tables(waiting).combine_chunks()
            texts = t.column("text")
            numbers, units = _numbered(texts.chunk(0) if texts.num_chunks == 1 else texts.combine_chunks(), whole)
            kept = _written(pa.table([t.column("id"), numbers], ["id", "units"]))
            return pa.RecordBatch.from_arrays([pa.array([first + n]), pa.array([kept], pa.binary()), pa.array([len(units)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(units)], pa.int32()), units)], ["p", "docs", "n_units", "units"])

        for b in batches:
            lengths = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(), dtype=np.int64)
            at = 0
            while at < b.num_rows:
                upto = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + block_bytes - size, side="right")))
                waiting.append(pa.Table.from_batches([b.slice(at, upto - at)]))
                size += int(lengths[upto - 1] - (lengths[at - 1] if at else 0))
                at = upto
                if at < b.num_rows or size >= block_bytes:
                    yield block()
                    n, waiting, size = n + 1, [], 0
        if waiting:
            yield block()
        waiting = []
        give_back()

    return docs.mapInArrow(run, "p long, docs binary, n_units int, units array<string>")


def _packed(units: DataFrame, place: Place, most: int = 8 << 20) -> DataFrame:
    """(p, units): rows (place, shown) of a task, those of a block together, as (k, shown)."""

    def run(batches):
        waiting, size = [], 0

        def packed():
            t = pa.concat_tables(waiting)
            t = t.take(pc.sort_indices(t, [("place", "ascending")]))
            p, k = place.parts(t.column("place").to_numpy())
            t = pa.table([pa.array(k, pa.int32()), t.column("shown")], ["k", "shown"])
            starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            for s, e in zip(starts, [*starts[1:], len(p)], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([p[s]]), pa.array([_written(t.slice(s, e - s).combine_chunks())], pa.binary())], ["p", "units"])

        for b in batches:
            waiting.append(pa.Table.from_batches([b]))
            size += b.nbytes
            if size > most:
                yield from packed()
                waiting, size = [], 0
        if size:
            yield from packed()
        waiting = []
        give_back()

    return units.mapInArrow(run, "p long, units binary")


class Units:
    """The units (k, shown) of a block: what their groups look like, their sums, and their links as numbers of ``codes``, the block's distinct pairs."""

    def __init__(self, t: pa.Table):
        self.k = t.column("k").to_numpy()
        shown = t.column("shown").cast(pa.binary())
        self.shown = pc.binary_join_element_wise(shown, b"", b";").combine_chunks()
        text = bytes(memoryview(self.shown.buffers()[2] or b"")[: int(pc.sum(pc.binary_length(self.shown)).as_py() or 1) - 1])
        ids = np.fromstring(text.translate(bytes.maketrans(b",|;", b"   ")), np.int64, sep=" ") if text else np.zeros(0, np.int64)
        mark = np.frombuffer(text, np.uint8)
        mark = mark[(mark < 48) | (mark > 57)]
        # the marks before a number say which group it is in, and whether it stands before or behind the bar
        group = np.concatenate([[0], np.cumsum(mark == 59)])[: len(ids)]
        behind = np.concatenate([[0], np.cumsum(mark == 124)])[: len(ids)] > group
        a, b = ids[~behind], ids[behind]
        n = int(group[-1]) + 1 if len(ids) else 0
        n_a, n_b = np.bincount(group[~behind], minlength=n), np.bincount(group[behind], minlength=n)
        per = pc.count_substring(shown, ";").to_numpy().astype(np.int64) + 1
        of_unit = lambda x: _sums(x, np.concatenate([[0], np.cumsum(per)]))
        self.sums = np.array([of_unit(n_a), of_unit(n_b), per, of_unit(n_a * n_b)])
        times = n_b[group[~behind]]
        first_b = np.cumsum(n_b) - n_b
        partner = np.repeat(first_b[group[~behind]] - np.cumsum(times) + times, times) + np.arange(times.sum())
        pairs = pa.array((np.repeat(a, times) << 32) | b[partner]).dictionary_encode()
        self.codes, self.link = pairs.dictionary, pairs.indices.to_numpy()
        self.end = np.cumsum(self.sums[3])

    def links(self, units: np.ndarray) -> np.ndarray:
        """The links of units, one unit's after another's."""
        k = self.sums[3][units]
        return self.link[np.repeat(self.end[units] - np.cumsum(k), k) + np.arange(k.sum())]


SUMS = ["n_a", "n_b", "n_groups", "n_links"]
#: Units of documents that are read together.
SLICE = 1 << 16


def _lists_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's list starts and ends, null as an empty one, and what the lists hold."""
    lists = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]), lists.flatten().to_numpy()


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The sums of the stretches of x between the places off."""
    return np.diff(np.concatenate([[0], np.cumsum(x)])[off])


def _assembled(blocks: DataFrame, units: DataFrame) -> DataFrame:
    """A row a block: p; its documents (id, the sums, groups_sha256, distinct units, and how often each of them occurs); its units' links (numbers within the block)
    and where each unit's end; the pairs behind the numbers (codes), and in how many of its documents each one is (held)."""

    def run(key, docs: pa.Table, units: pa.Table) -> pa.Table:
        # a worker lives on from the stage before, with its tokenizers
        _byte_level.cache_clear()
        _pieces.cache_clear()
        known = Units(pa.concat_tables([_read(x) for x in units.column("units").to_pylist()]) if units.num_rows else pa.table({"k": pa.array([], pa.int32()), "shown": pa.array([], pa.string())}))
        n_units = docs.column("n_units")[0].as_py()
        docs = _read(docs.column("docs")[0].as_py())
        off, numbers = _lists_of(docs.column("units"))
        row = np.full(n_units, -1, np.int32)
        row[known.k] = np.arange(len(known.k), dtype=np.int32)
        of = row[numbers]
        n = docs.num_rows
        right = _sums((of < 0).astype(np.int64), off) == 0
        sums, digests = np.array([_sums(x[of] if len(x) else of, off) * right for x in known.sums]), [""] * n
        held = np.zeros(len(known.codes), np.int64)
        distinct, times = [of[:0]] * n, [np.zeros(0, np.int64)] * n
        at = 0
        while at < n:
            upto = max(at + 1, int(np.searchsorted(off, off[at] + SLICE, side="right")) - 1)
            base, here = off[at], of[off[at] : off[upto]]
            groups = known.shown.take(pa.array(here, mask=here < 0))
            ends, spelled = (np.frombuffer(groups.buffers()[1], np.int32), memoryview(groups.buffers()[2] or b"")) if len(here) else (here, b"")
            for i in range(at, upto):
                s, e = off[i] - base, off[i + 1] - base
                if s == e or not right[i]:
                    continue
                digests[i] = hashlib.sha256(spelled[ends[s] : ends[e] - 1]).hexdigest()
                mine, often = np.unique(here[s:e], return_counts=True)
                distinct[i], times[i] = mine, often
                # once for each distinct link: a repeated index is written once
                held[known.links(mine)] += 1
            at = upto
        bounds = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in distinct])]), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x), pa.int32())) for x in (distinct, times)]
        docs = pa.table([docs.column("id"), *map(pa.array, sums), pa.array(digests, pa.string()), *lists], ["id", *SUMS, "groups_sha256", "units", "times"])
        links = pa.table([pa.ListArray.from_arrays(pa.array(np.concatenate([[0], known.end]), pa.int32()), pa.array(known.link, pa.int32()))], ["links"])
        once = [pa.array([x], pa.binary()) for x in (_written(docs), _written(links))] + [pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), x) for x in (known.codes, pa.array(held))]
        del known, docs, links, lists, distinct, times
        give_back()
        return pa.table([pa.array([key[0].as_py()], pa.int64()), *once], ["p", "docs", "links", "codes", "held"])

    return blocks.select("p", "docs", "n_units").groupBy("p").cogroup(units.groupBy("p")).applyInArrow(run, "p long, docs binary, links binary, codes array<long>, held array<long>")


def _counted(found: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """The documents of found with n_best and count_sum, from the counts (of, link, n, best) of each block's pairs: a document's are the sums of its units'."""

    def run(key, block: pa.Table, pairs: pa.Table) -> pa.Table:
        docs = _read(block.column("docs")[0].as_py())
        end, linked = _lists_of(_read(block.column("links")[0].as_py()).column("links"))
        link = pairs.column("link").to_numpy()
        n, best = np.zeros((2, int(linked.max()) + 1 if len(linked) else 0), np.int64)
        n[link], best[link] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
        off, units = _lists_of(docs.column("units"))
        often = _lists_of(docs.column("times"))[1].astype(np.int64)
        out = np.zeros((2, docs.num_rows), np.int64)
        for row, value in enumerate((best, n)):
            out[row] = _sums(_sums(value[linked], end)[units] * often, off)
        columns = [docs.column("id"), *(docs.column(c) for c in SUMS), *map(pa.array, out), docs.column("groups_sha256")]
        give_back()
        return pa.table(columns, ["id", *SUMS, "n_best", "count_sum", "groups_sha256"])

    schema = f"id {kind}, {', '.join(f'{c} long' for c in [*SUMS, 'n_best', 'count_sum'])}, groups_sha256 string"
    return found.select("p", "docs", "links").groupBy("p").cogroup(pairs.groupBy("of")).applyInArrow(run, schema)


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 6 << 20) -> tuple[DataFrame, DataFrame]:
    """Two tables: of each document (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and of each
    linked pair of ids (a, b, n, best): in how many documents it is linked, and whether that is the highest of its a."""
    spark = docs.sparkSession
    whole = not separable(byte_path, piece_path)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    blocks = materialize(_blocked(rows, block_bytes, whole), compression="zstd")
    # a unit is aligned once for so many blocks, which bounds the list of its places
    tasks, last, n, most = blocks.agg(F.max(F.shiftright("p", 32)), F.max(F.col("p").bitwiseAND(0xFFFFFFFF)), F.count("*"), F.max("n_units")).first()
    width = max(1, TOGETHER * ((tasks or 0) + 1) // max(1, n))
    place = Place((last or 0).bit_length(), (most or 0).bit_length())
    if (tasks or 0).bit_length() + place.block + place.unit > 63:
        raise ValueError("the numbers of tasks, blocks and units don't fit a long together")
    held = blocks.select("p", F.posexplode("units").alias("k", "unit"))
    with setting(spark, BY_HASH, "false"):
        names = held.groupBy("unit", F.floor(F.shiftright("p", 32) / width).alias("part")).agg(F.collect_list(place.of("p", "k")).alias("places"))
        tokens = materialize(tokenized(names.select(F.monotonically_increasing_id().alias("uid"), "unit", "places"), byte_path, piece_path), compression="zstd")
    del names, held
    forget_shuffles(spark)
    with setting(spark, CO_PARTITIONED, "false"), setting(spark, BY_HASH, "false"):
        shown = materialize(groups(tokens), compression="zstd")
    release(tokens)
    del tokens
    forget_shuffles(spark)

    found = materialize(_assembled(blocks, _packed(shown.select(F.explode("places").alias("place"), "shown"), place)), compression="zstd")
    release(blocks, shown)
    del blocks, shown
    forget_shuffles(spark)

    n = found.select(F.explode(F.arrays_zip("codes", "held")).alias("x")).groupBy("x.codes").agg(F.sum("x.held").alias("n")).where("n > 0")
    a, b = F.shiftrightunsigned("codes", 32).cast("int"), F.col("codes").bitwiseAND(0xFFFFFFFF).cast("int")
    # an id of A has as many pairs as B has ids at most
    counts = n.select("codes", a.alias("a"), b.alias("b"), "n")
    counts = materialize(counts.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy("a"))))
    pairs = found.select(F.col("p").alias("of"), F.posexplode("codes").alias("link", "codes")).join(counts, "codes").select("of", "link", "n", "best")
    return reading(_counted(found, pairs, kind).withColumnRenamed("id", id_col), found, counts), counts.drop("codes")


def op13_align(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
