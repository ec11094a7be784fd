"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k.

A segmentation of a text weighs the product of its pieces' weights: exp(alpha * score) for a
unigram model; a BPE model has ranks in place of scores, and a piece of rank r weighs (r + 3) ** -alpha. A
character without a piece is spelled in byte pieces at a low weight. No piece holds a space mark behind
another character, so the lattice of a text is a chain of the lattices of its words (with the
marks before each), and the weights are normalised word by word.

``sample`` draws k distinct segmentations without replacement, exactly as from perturbing every
segmentation's log probability with Gumbel noise and keeping the k largest. It is a best-first
(A*) search over the tree of prefixes: a node's bound is the largest perturbed value below it, which
can be drawn from the node's total probability alone, truncated at its parent's. A node expands
along its best path at once; its other children at each word stay together as one node, whose total
is prefix * (1 - p), and are told apart only when the search pops it. The next bound kappa left in the
queue gives each result's inclusion score 1 - exp(-exp(log_prob - kappa)), given as its logarithm; it is 1 where there is nothing left.
All random numbers are hashes of the row's key, the seed and the place they are used at: results
don't depend on batches or partitions.

The lattices of all distinct words of some documents are built and sampled together in numpy, in
steps of a character or piece; that takes about 200 bytes for each character of those words, some
of which are kept. Whole
texts are encoded. A null text is the empty one, which has one segmentation, without pieces. Texts
with fewer than k segmentations give all of them: what is left of a word once some segmentations are taken is 1 less their shares, and where that
is lost in rounding and a text would get fewer than k for it, it is summed over the lattice without them. Rows with equal keys
and texts give equal results, and ties of perturbed values do not occur but by equal hashes. An empty table gives an empty one. Only the
two named columns are read, so other names can't clash.
The model's path must exist on the executors; it is a parameter.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from functools import lru_cache
from math import exp, expm1, log

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from quire.functions.batches import few
from quire.llm.common import give_back, table

MARK = "▁"
_K = np.uint64(0x9E3779B97F4A7C15)
CHARS = 1 << 18  # of the texts that are worked on together
STORE = 400_000  # words whose lattices are kept, some 400 bytes each
TRIES = 16  # draws of a word before what is taken is left out of its lattice
ONE = 1 << 32  # shares of a boundary's pieces are kept to 32 bits, for what is drawn first; what is left is summed in doubles
RARE = 127  # the kind of characters that are in few pieces


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hash(seed: np.ndarray, *places) -> np.ndarray:
    x = seed
    for p in places:
        x = _mix(x * _K + (np.uint64(p) if np.isscalar(p) else p.astype(np.uint64)))
    return x


def _uniform(seed: np.ndarray, *places) -> np.ndarray:
    """In (0, 1), by hash."""
    x = _hash(seed, *places)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


class _Numbers(dict):
    """Numbers keys in order of first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Lattice:
    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        self.store, self.number, self.keep = None, _Numbers(), STORE
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names, scores = [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(MARK in names[i].strip(MARK) or names[i].rstrip(MARK) != names[i] and names[i].strip(MARK) for i in plain):
            raise ValueError("a piece crosses words")
        ranked = all(scores[i] == int(scores[i]) for i in plain)
        self.weight = np.array([-alpha * log(min(-s, n) + 3) if ranked else alpha * s for s in scores])
        self.lowest = float(self.weight[plain].min()) - 10
        self.weight = np.concatenate([self.weight, [self.lowest, -np.inf]])  # by id; at -2 a character without a piece, at -1 nothing
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_ids = np.array(self.bytes, np.int32)
        self.raw = [b"" if sp.is_control(i) else bytes([self.bytes.index(i)]) if sp.is_byte(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.raw_size = np.array(list(map(len, self.raw)))
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.raw_all = np.frombuffer(b"".join(self.raw), np.uint8)
        self.longest = max(len(names[i]) for i in plain)
        self.plain, self.table = {names[i].replace(MARK, " "): i for i in plain}, None

    def _trie(self, pieces: dict[str, int]) -> None:
        """States are beginnings of pieces. Steps over the most frequent characters are in a table, the others in sorted keys."""
        states, steps = {"": 0}, []
        for text in pieces:
            for k in range(1, len(text) + 1):
                if text[:k] not in states:
                    states[text[:k]] = len(states)
                    steps.append((states[text[: k - 1]], ord(text[k - 1]), states[text[:k]]))
        self.piece = np.full(len(states), -1, np.int32)
        for text, i in pieces.items():
            self.piece[states[text]] = i
        often = [c for c, _ in Counter(c for _, c, _ in steps).most_common(RARE)]
        self.kind = np.full(0x110000, RARE, np.uint8)
        self.kind[often] = np.arange(len(often))
        self.table = np.full(len(states) * (RARE + 1), -1, np.int32)
        rare = []
        for at, c, to in steps:
            if self.kind[c] < RARE:
                self.table[at * (RARE + 1) + int(self.kind[c])] = to
            else:
                rare.append((at << 21 | c, to))
        rare.sort()
        self.rare_key, self.rare_to = np.array([k for k, _ in rare] + [1 << 62], np.int64), np.array([t for _, t in rare] + [-1], np.int32)

    def _step(self, state: np.ndarray, c: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The states after a character; -1 where no piece goes on like that."""
        to = self.table[state * np.int32(RARE + 1) + kind]
        odd = np.flatnonzero(kind == RARE)
        if len(odd):
            key = state[odd].astype(np.int64) << 21 | c[odd]
            at = np.searchsorted(self.rare_key, key)
            to[odd] = np.where(self.rare_key[at] == key, self.rare_to[at], -1)
        return to

    def words(self, texts: list[list[str]]) -> tuple["Words", list[np.ndarray]]:
        """The lattices of the words of each list, and their numbers. Lattices are kept for later calls while they are few."""
        if self.store is None:
            self.store = Words(self)
        if len(self.number) > self.keep:
            self.number = _Numbers()
            self.store.clear()
        number, known = self.number, len(self.number)
        out = [np.fromiter(map(number.__getitem__, t), np.int32, len(t)) for t in texts]
        self.store.add(self._build(list(number)[known:] if known else list(number)))
        return self.store, out

    def build(self, words: list[str]) -> "Words":
        out = Words(self)
        out.add(self._build(words))
        return out

    def _build(self, words: list[str]) -> tuple[np.ndarray, ...]:
        if self.table is None:
            self._trie(self.plain)
        cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array(list(map(len, words)), np.int64)
        unit = np.repeat(np.arange(len(words)), size)
        start = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(words) else size
        end, wide = (start + size)[unit], self.longest
        # boundaries: one more than characters for each word; ids[b, most - l] is the piece of length l that ends at b
        first = start + np.arange(len(words))
        kind, found = self.kind[cp], []
        at, state = np.arange(len(cp)), np.zeros(len(cp), np.int32)
        for k in range(1, wide + 1):
            here = at + (k - 1)
            state = self._step(state, cp[here], kind[here])
            if k == 1:
                odd = np.flatnonzero((state < 0) | (self.piece[state] < 0))
                found.append((1, odd + unit[odd] + 1, -2 - cp[odd].astype(np.int64)))
            on = np.flatnonzero(state >= 0)
            at, state = at[on], state[on]
            got = self.piece[state]
            piece = np.flatnonzero(got >= 0)
            found.append((k, at[piece] + unit[at[piece]] + k, got[piece]))
            on = np.flatnonzero(at + k < end[at])
            at, state = at[on], state[on]
        most = max([k for k, b, _ in found if len(b)], default=1)
        ids = np.full((len(cp) + len(words), most), -1, np.int32)
        for k, b, got in found:
            if len(b):
                ids[b, most - k] = got
        cum = np.zeros((len(ids), most), np.uint32)
        logz = np.full(len(ids) + most, -np.inf)  # of boundary b at b + most
        logz[first + most] = 0
        order = np.argsort(-size, kind="stable")
        sizes, back = size[order], np.arange(most, 0, -1)
        for s in range(1, int(size.max(initial=0)) + 1):
            b = first[order[: np.searchsorted(-sizes, -s, "right")]] + s
            w = self.weight[np.maximum(ids[b], -2)]
            w += logz[(b + most)[:, None] - back]
            top = w.max(1)
            w -= top[:, None]
            np.exp(w, out=w)
            np.cumsum(w, 1, out=w)
            logz[b + most] = top + np.log(w[:, -1])
            w *= ONE / w[:, -1:]
            cum[b] = np.minimum(w, ONE - 1, out=w)
        last = first + size
        row, col = np.nonzero(ids != -1)  # by boundary, the longest piece first
        share = cum[row, col]
        share[np.flatnonzero(np.diff(row, append=len(ids)))] = ONE - 1  # a draw stops at a boundary's last piece
        begin = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ids)))])
        return begin, ids[row, col], share, (most - col).astype(np.int8), first, last, logz[last + most]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of the ids between each two of ``ends``; the space that encoding puts before a text goes."""
        size = self.raw_size[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        raw = self.raw_all[np.repeat(self.raw_start[ids] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
        cut = upto[ends]
        return [raw[a + (raw[a : a + 1] == b" " and a < b) : b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:], strict=False)]


class Words:
    """The lattices of some words, and samples of their segmentations."""

    def __init__(self, lattice: Lattice):
        self.lattice = lattice
        # pieces that end at boundary b: begin[b] to begin[b + 1] of id, cum (shares up to each) and length
        self.begin, self.id, self.cum, self.length = np.zeros(1, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32), np.zeros(0, np.int8)
        self.first, self.last, self.logz = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)
        self.clear()

    def clear(self) -> None:
        self.words = self.boundaries = self.pieces = 0

    def _put(self, name: str, at: int, new: np.ndarray) -> None:
        held = getattr(self, name)
        if at + len(new) > len(held):
            held, old = np.zeros(max(at + len(new), len(held) + len(held) // 4), held.dtype), held
            held[:at] = old[:at]
            setattr(self, name, held)
        held[at : at + len(new)] = new

    def add(self, built: tuple[np.ndarray, ...]) -> None:
        begin, ids, cum, length, first, last, logz = built
        self._put("begin", self.boundaries, begin + self.pieces)
        for name, new in (("id", ids), ("cum", cum), ("length", length)):
            self._put(name, self.pieces, new)
        for name, new in (("first", first + self.boundaries), ("last", last + self.boundaries), ("logz", logz)):
            self._put(name, self.words, new)
        self.words, self.boundaries, self.pieces = self.words + len(first), self.boundaries + len(begin) - 1, self.pieces + len(ids)

    def draw(self, word: np.ndarray, seed: np.ndarray, round_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pieces of each draw one after another, their counts, log probabilities) for a seed for each draw."""
        first = self.first[word]
        logp, count, steps = -self.logz[word], np.zeros(len(word), np.int64), []
        live = np.flatnonzero(self.last[word] > first)
        at, start = self.last[word[live]], first[live]
        while len(live):
            u = np.minimum(_hash(seed[live], round_ << 32 | len(steps)) >> np.uint64(32), np.uint64(ONE - 2)).astype(np.uint32)
            k = self.begin[at]
            more = np.flatnonzero(self.cum[k] <= u)
            while len(more):
                k[more] += 1
                more = more[self.cum[k[more]] <= u[more]]
            got = self.id[k]
            logp[live] += self.lattice.weight[np.maximum(got, -2)]
            steps.append((live, got))
            count[live] += 1
            at = at - self.length[k]
            on = np.flatnonzero(at > start)
            live, at, start = live[on], at[on], start[on]
        begin = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(begin[-1], np.int64)
        for i, (rows, got) in enumerate(steps):
            out[begin[rows] + count[rows] - 1 - i] = got
        return out, count, logp

    def all(self, word: int) -> list[tuple[float, tuple[int, ...]]]:
        """(log probability, pieces) of every segmentation of a short word."""
        out, stack = [], [(int(self.last[word]), -float(self.logz[word]), ())]
        while stack:
            at, p, path = stack.pop()
            if at == self.first[word]:
                out.append((p, path))
            else:
                stack += [(at - int(self.length[k]), p + float(self.lattice.weight[max(int(self.id[k]), -2)]), (int(self.id[k]), *path)) for k in range(self.begin[at], self.begin[at + 1])]
        return out

    def rest(self, word: int, taken: set[tuple[int, ...]]) -> tuple[float, "Rest"]:
        """The log share of the word's segmentations that are not taken, and what draws from them."""
        rest = Rest(self, word, taken)
        return rest.left(()) - rest.beta[0], rest


class Rest:
    """A word's lattice without some segmentations: sums and draws over what is left, in logarithms."""

    def __init__(self, words: Words, word: int, taken: set[tuple[int, ...]]):
        first, last = int(words.first[word]), int(words.last[word])
        self.size = last - first
        self.edges: list[list[tuple[int, int, float]]] = [[] for _ in range(self.size + 1)]  # by start: end, piece, weight
        for at in range(first + 1, last + 1):
            for k in range(words.begin[at], words.begin[at + 1]):
                i, n = int(words.id[k]), int(words.length[k])
                self.edges[at - n - first].append((at - first, i, float(words.lattice.weight[max(i, -2)])))
        self.beta = [-np.inf] * self.size + [0.0]
        for b in range(self.size - 1, -1, -1):
            self.beta[b] = float(np.logaddexp.reduce([w + self.beta[e] for e, _, w in self.edges[b]])) if self.edges[b] else -np.inf
        # beginnings of what is taken, and where they end
        self.place, self.memo = {(): 0}, {}
        for path in taken:
            for n, i in enumerate(path):
                at = self.place[path[:n]]
                self.place[path[: n + 1]] = next(e for e, j, _ in self.edges[at] if j == i)
        for path in taken:
            self.memo[path] = -np.inf
        for path in sorted(self.place, key=len, reverse=True):
            if path not in self.memo:
                self.memo[path] = float(np.logaddexp.reduce([v for _, _, v in self._options(path)])) if self.place[path] < self.size else 0.0

    def left(self, path: tuple[int, ...]) -> float:
        return self.memo[path]

    def _options(self, path: tuple[int, ...]) -> list[tuple[int, int, float]]:
        return [(e, i, w + (self.memo[(*path, i)] if (*path, i) in self.place else self.beta[e])) for e, i, w in self.edges[self.place[path]]]

    def draw(self, seed: np.ndarray) -> tuple[np.ndarray, float]:
        """(pieces, log probability) of one that is not taken."""
        path, at, logp, free = (), 0, -self.beta[0], False
        while at < self.size:
            options = [(e, i, w + self.beta[e]) for e, i, w in self.edges[at]] if free else self._options(path)
            value = np.array([v for _, _, v in options])
            upto = np.cumsum(np.exp(value - value.max()))
            k = int(np.searchsorted(upto, _uniform(seed, 1 << 42 | len(path))[0] * upto[-1], "right"))
            k = min(k, int(np.flatnonzero(value > -np.inf)[-1]))
            weight, (at, i, _) = self.edges[at][k][2], options[k]
            logp += weight
            path = (*path, i)
            free = free or path not in self.place
        return np.array(path, np.int64), logp


_UNITS = re.compile(" *[^ \n]+| +|\n")


class _Tree:
    """The search of one text: its paths so far and the queue of groups of other children."""

    def __init__(self, seed: int, words: np.ndarray, k: int):
        self.k = k
        self.seed, self.words, self.paths, self.queue, self.seen = seed, words, [], [], {}
        root = np.array([seed], np.uint64)
        self.bound = -log(-log(_uniform(root, 1 << 40)[0]))  # of the path that is drawn next
        self.base, self.level = None, 0  # that path follows path ``base`` up to a word, and differs there

    def add(self, pieces: np.ndarray, count: np.ndarray, logp: np.ndarray, depth: np.ndarray) -> None:
        """Takes the path's words from ``level`` on, and the depth of their other children, whose bound is minus that, truncated at this path's."""
        n, at = len(self.paths), self.level
        if self.base is not None:
            old = self.paths[self.base]
            cut = int(old[1][:at].sum())
            pieces, count, logp = np.concatenate([old[0][:cut], pieces]), np.concatenate([old[1][:at], count]), np.concatenate([old[2][:at], logp])
        self.paths.append((pieces, count, logp, self.bound))
        # as many as can still be popped, and one for kappa, in a sorted list whose head is in the queue
        most = self.k - n
        best = np.argpartition(depth, most)[:most] if len(depth) > most else np.arange(len(depth))
        best = best[np.argsort(depth[best], kind="stable")]
        best = best[depth[best] < np.inf]
        self._push(n, best + at, -np.logaddexp(-self.bound, depth[best]), 0)

    def part(self, share: float) -> float:
        """What is left at the word where the path to come parts from its base, once it takes this share."""
        self.seen[self.branch].append((len(self.paths), share))
        return max(0.0, 1 - sum(x for _, x in self.seen[self.branch]))

    def _push(self, path: int, levels: np.ndarray, values: np.ndarray, i: int) -> None:
        if i < len(levels):
            heapq.heappush(self.queue, (-float(values[i]), path, i, int(levels[i]), levels, values))

    def pop(self) -> bool:
        """Chooses the next path to draw; False if there is none."""
        if not self.queue:
            return False
        value, path, i, level, levels, values = heapq.heappop(self.queue)
        self._push(path, levels, values, i + 1)
        # the group of path's siblings at a word is that of the path it parted from there
        self.branch = self.owner(path, level)
        self.seen.setdefault(self.branch, [(path, float(np.exp(self.paths[path][2][level])))])
        self.base, self.level, self.bound = path, level, -value
        return True

    def owner(self, path: int, level: int) -> tuple[int, int]:
        for key, parted in self.seen.items():
            if key[1] == level and any(n == path for n, _ in parted):
                return key
        return path, level

    def at(self, path: int, level: int) -> tuple[int, ...]:
        """The pieces of a path at a word."""
        pieces, count = self.paths[path][:2]
        a = int(count[:level].sum())
        return tuple(pieces[a : a + int(count[level])].tolist())

    def taken(self) -> set[tuple[int, ...]]:
        return {self.at(n, self.level) for n, _ in self.seen[self.branch] if n < len(self.paths)}

    def kappa(self) -> float:
        return -self.queue[0][0] if self.queue else -np.inf


def sample_texts(lattice: Lattice, texts: list[str | None], keys: list[str], k: int, seed: int) -> list[list[dict]]:
    """For each text up to k dicts of ids, log_prob and log_inclusion, in order of perturbed log probability."""
    units = [_UNITS.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]  # a space is a mark here
    words, numbers = lattice.words(units)
    trees = [_Tree(xxhash.xxh64_intdigest(key, seed), w, k) for key, w in zip(keys, numbers, strict=True)]
    active = trees
    for n in range(k):
        if not active:
            break
        ask = [np.arange(t.level, len(t.words)) for t in active]
        size = np.array(list(map(len, ask)))
        where = np.concatenate(ask)
        word = np.concatenate([t.words[t.level :] for t in active])
        seeds = np.repeat(np.array([t.seed for t in active], np.uint64), size)
        seeds = _mix(_mix(seeds * _K + np.uint64(n)) * _K + where.astype(np.uint64))
        pieces, count, logp = words.draw(word, seeds, 0)
        begin, starts = np.concatenate([[0], np.cumsum(count)]), np.cumsum(size) - size
        other = _others(words, active, word, seeds, starts, pieces, begin) if n else {}
        for i, (_, share) in other.items():
            logp[starts[i]] = share
        rest = np.maximum(0, -np.expm1(np.minimum(logp, 0)))
        whole, base = np.cumsum(logp), np.zeros(len(active))
        for i, t in enumerate(active if n else ()):
            base[i] = t.paths[t.base][2][: t.level].sum()
            rest[starts[i]] = t.part(float(np.exp(logp[starts[i]])))
        before = whole - logp + np.repeat(base - np.concatenate([[0], whole])[starts], size)
        noise = np.log(-np.log(_uniform(seeds, 1 << 41)))
        with np.errstate(divide="ignore"):
            depth = noise - before - np.log(np.where(rest > 1e-12, rest, 0))  # the bounds' negatives before they are truncated
        for i, (t, at, m) in enumerate(zip(active, starts, size, strict=True)):
            own, c = pieces[begin[at] : begin[at + m]], count[at : at + m]
            if i in other:
                own, c = np.concatenate([other[i][0], own[c[0] :]]), c.copy()
                c[0] = len(other[i][0])
            if n + 1 < k and np.count_nonzero(depth[at : at + m] < np.inf) < k - n:
                _exact_depths(words, t, own, c, word[at : at + m], depth[at : at + m], noise[at : at + m] - before[at : at + m])
            t.add(own, c, logp[at : at + m], depth[at : at + m])
        active = [t for t in active if n + 1 < k and t.pop()]
    out = []
    for t in trees:
        kappa = t.kappa()
        out.append([{"ids": _spelled(lattice, x[0]), "log_prob": float(x[2].sum()), "log_inclusion": _inclusion(float(x[2].sum()) - kappa)} for x in t.paths])
    return out


def _exact_depths(words: Words, t: _Tree, pieces: np.ndarray, count: np.ndarray, word: np.ndarray, depth: np.ndarray, without: np.ndarray) -> None:
    """Fills in the depths that rounding lost: of words whose other segmentations have next to no share, but are some."""
    ends = np.cumsum(count)
    for j in np.flatnonzero(depth == np.inf):
        own = tuple(pieces[ends[j] - count[j] : ends[j]].tolist())
        taken = {own} | (t.taken() if j == 0 and t.base is not None else set())
        share = words.rest(int(word[j]), taken)[0]
        if share > -np.inf:
            depth[j] = without[j] - share


def _inclusion(above: float) -> float:
    """log(1 - exp(-exp(above)))."""
    return above if above < -30 else log(-expm1(-exp(min(above, 700.0))))


def _others(words: Words, trees: list[_Tree], word: np.ndarray, seeds: np.ndarray, starts: np.ndarray, pieces: np.ndarray, begin: np.ndarray) -> dict[int, tuple[np.ndarray, float]]:
    """For the trees whose first word came out as a segmentation that is taken there: another one, drawn anew some times, then from what is left."""
    taken = [t.taken() for t in trees]
    left = [i for i, a in enumerate(starts) if tuple(pieces[begin[a] : begin[a + 1]].tolist()) in taken[i]]
    out = {}
    for tries in range(1, TRIES):
        if not left:
            return out
        at = starts[left]
        got, count, logp = words.draw(word[at], seeds[at], tries)
        ends = np.cumsum(count)
        for i, a, b, p in zip(left, ends - count, ends, logp, strict=True):
            if tuple(got[a:b].tolist()) not in taken[i]:
                out[i] = got[a:b], p
        left = [i for i in left if i not in out]
    for i in left:
        a = starts[i]
        out[i] = words.rest(int(word[a]), taken[i])[1].draw(seeds[a : a + 1])
    return out


def _spelled(lattice: Lattice, pieces: np.ndarray) -> np.ndarray:
    """With characters that have no piece in byte pieces."""
    odd = np.flatnonzero(pieces < 0)
    if not len(odd):
        return pieces.astype(np.int32)
    code = -2 - pieces[odd]
    if code.max() < 128:
        out = pieces.astype(np.int32)
        out[odd] = lattice.byte_ids[code]
        return out
    spelled = [[lattice.bytes[b] for b in chr(-2 - int(c)).encode("utf-8", "surrogatepass")] for c in pieces[odd]]
    size = np.ones(len(pieces), np.int64)
    size[odd] = list(map(len, spelled))
    out = np.repeat(pieces, size)
    begin = np.concatenate([[0], np.cumsum(size)])
    for i, ids in zip(odd, spelled, strict=True):
        out[begin[i] : begin[i + 1]] = ids
    return out.astype(np.int32)


@lru_cache(maxsize=4)
def lattice(path: str, alpha: float) -> Lattice:
    return Lattice(path, alpha)


_SAMPLES = "array<struct<ids:array<int>,log_prob:double,log_inclusion:double>>"


def _parts(texts: list[str | None], chars: int = CHARS):
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end] or "") <= chars):
            total += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def sample(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", k: int = 2, alpha: float = 1.0, seed: int = 4, out: str = "samples", check: bool = False, keep_words: int = STORE, chars: int = CHARS) -> DataFrame:
    """(id, text, samples): up to k distinct segmentations of each text, with log_prob and log_inclusion.

    keep_words and chars trade a worker's memory for time. With ``check``, decodes in place of text: whether every segmentation, decoded, is the text.
    """
    kind = df.schema[id_col].dataType.simpleString()
    item = pa.struct([("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("log_inclusion", pa.float64())])

    def run(batches):
        own = lattice(model, alpha)
        own.keep = keep_words
        for b in (part for batch in batches for part in few(batch, 1024, 4 * chars)):
            texts, keys = b.column(1).to_pylist(), b.column(2).to_pylist()
            for at, end in _parts(texts, chars):
                rows = sample_texts(own, texts[at:end], keys[at:end], k, seed)
                flat = [s for r in rows for s in r]
                joined, ends = np.concatenate([s["ids"] for s in flat]), np.cumsum([0, *(len(s["ids"]) for s in flat)])
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(joined))
                middle = b.column(1).slice(at, end - at)
                if check:
                    back = iter(own.decode_all(joined, ends))
                    middle = pa.array([all([next(back) == (t or "") for _ in r]) for t, r in zip(texts[at:end], rows, strict=True)], pa.bool_())
                items = pa.StructArray.from_arrays([ids, pa.array([s["log_prob"] for s in flat]), pa.array([s["log_inclusion"] for s in flat])], fields=list(item))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), items)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), middle, lists], ["id", "middle", "samples"])
        # a worker may have other work next
        del own
        lattice.cache_clear()
        give_back()

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    named = rows.mapInArrow(run, f"id {kind}, middle {'boolean' if check else 'string'}, samples {_SAMPLES}")
    return named.withColumnsRenamed({"id": id_col, "middle": "decodes" if check else text_col, "samples": out})


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the library's own segmentation."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        own = lattice(model, 1.0).sp
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.encode([t or "" for t in b.column(1).to_pylist()], num_threads=1), pa.list_(pa.int32()))], ["id", "ids"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, model: str, ids_col: str, out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of df (all, if None) and the texts of each list of ids in the array ids_col; bytes that are not UTF-8 become U+FFFD."""
    names = df.columns if keep is None else keep
    df = df.select(*names, F.col(ids_col).alias("__ids"))

    def run(batches):
        own = lattice(model, 1.0)
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                b = whole.slice(lo, 64)
                lists = b.column(len(names))
                inner = lists.flatten()
                ids = inner.flatten()
                size = np.array([0 if n is None else n for n in pa.compute.list_value_length(inner).to_pylist()], np.int64)
                texts = own.decode_all(ids.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(size)]))
                count = pa.compute.list_value_length(lists).to_pylist()
                ends = np.cumsum([0, *(n or 0 for n in count)])
                out_texts = [None if n is None else texts[a : a + n] for n, a in zip(count, ends, strict=False)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(out_texts, pa.list_(pa.string()))], [*names, out])

    return df.mapInArrow(run, StructType(df.schema.fields[: len(names)]).add(out, ArrayType(StringType())))


def sampled_rows(df: DataFrame, model: str, k: int = 2) -> DataFrame:
    """The query's columns for documents: what was sampled, and whether it decodes to the text."""
    digest = lambda f: F.transform("samples", f)
    return sample(df, model, k=k, check=True).select(
        "doc_id", F.size("samples").alias("n_samples"), digest(lambda s: F.size(s["ids"])).alias("n_pieces"), digest(lambda s: F.xxhash64(s["ids"])).alias("ids_hash"),
        digest(lambda s: s["log_prob"]).alias("log_prob"), digest(lambda s: s["log_inclusion"]).alias("log_inclusion"), "decodes",
    )


def op4_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sampled_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
