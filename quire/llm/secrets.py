"""Secret scan: patterns, and guess-cost dynamic programming on values in a credential context.

Every text is read whole. Base kinds (assign, access, hex) are the leftmost non-overlapping
matches of their pattern; matches that fail their length are dropped without another try. The
method adds ``guess``: the value after a credential word that the cheapest segmentation into
words, dates, repeats, keyboard walks and brute-force spans still makes costly to guess
(log10 of guesses at least ``min_log10``). A value ends at white space or a quote, a quoted one at its closing quote; a bearer token needs no separator. Addresses and places in the
net are no values. Masking takes the rest of a value along that a base pattern's letters leave over. Behind the word "is" it is
prose unless it holds a digit, a capital inside or a mark that words don't have.

Words cost their rank: first some credential words, then the whole words of a tokenizer's vocabulary (``words``, the path
of a BPE file whose words end in ``</w>``; its merges come in order of frequency). Brute force
tries likely letters first: a small letter costs what its place behind the letter before it says, by the pairs of letters
of that vocabulary, and its share of the value's alphabet at most. A value of 5 to 16 letters that these
pairs make likely counts as an unlisted word. Without ``words`` there are only the credential words and even letters.

Null and empty texts have no spans; repeated rows give the same spans each, and spans that start together come in the order
of KINDS; only the named columns are read, so names can't clash; an empty table gives an empty one. The segmentation of
a value of n characters takes at most 100 n steps, for any length.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.batches import few
from quire.llm.common import give_back, span_digests, table

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "guess"]
SCHEMA = "array<struct<kind:string,start:int,end:int,log10_guesses:double,value:string>>"

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: A credential word (English, French, German, Spanish), a separator or "is", and the value: up to white space or a quote, or within quotes up to
#: the closing one. The longer words may end any name (DB_PASSWORD, PGPASSWORD, clientSecret); the shorter ones stand alone, behind _ or as
#: a part in camel case (not in compass).
_CONTEXT = re.compile(
    r"""(?:(?ai:password|passwd|passphrase|secret|credentials?|token|api[_-]?key|access[_-]?key)|(?i:passwort|kennwort|mot\x20de\x20passe|contrase[ñn]a|clave)|(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))(?ai:pass|pwd|pin|bearer|auth|login))"""
    r"""["']?(?:[\x20\t]*+[:=]{1,2}>?[\x20\t]*+|(?P<prose>[\x20\t]++(?ai:is)[\x20\t]++))(?:"(?P<double>[^"\n]{6,128})"|'(?P<single>[^'\n]{6,128})'|["']?(?P<value>[^\s"'\x00-\x1f]{6,}))"""
)
#: A bearer token, with or without the name of its header.
_BEARER = re.compile(r"""(?<![A-Za-z0-9])(?ai:bearer)[\x20\t]++["']?(?P<value>[A-Za-z0-9._~+/=-]{16,})""")
#: What stands behind a credential word and is none: places in the net without a password in them, and addresses.
_NO_SECRET = re.compile(r"(?ai)[a-z][a-z0-9+.-]*://[^@\s]*|(?:mailto:)?[^@\s:/]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+")
#: What goes on behind the end of a match, as part of the same value.
_TAIL = re.compile(r"""[^\s"'<>]*""")
#: What a word of prose does not hold.
_UNLIKE_PROSE = re.compile(r"[0-9]|(?<!^)[A-Z]|[!@#$%^&*=+~|\\<>{}\[\]]")
_WORD_HINT = re.compile(r"(?i:pass|pwd|pin|secret|credential|token|bearer|key|auth|login|kennwort|contrase|clave)")

# Ranked words of credentials: the guesses of a word are its rank.
WORDS = (
    "password 123456 qwerty letmein admin welcome monkey dragon master login secret token test example changeme default root user "
    "guest hello love summer winter spring autumn sunshine princess football baseball shadow superman batman trustno iloveyou "
    "starwars freedom whatever computer internet server database service account access system network public private key api "
    "your my the value string none null true false todo placeholder dummy sample demo prod dev stage local company house home "
    "pass word blue red green black white money king queen star happy lucky magic power"
).split()
LONGEST = 24


class Dictionary:
    """Words by rank, and the costs of letters behind letters."""

    def __init__(self, words: list[str]):
        self.rank: dict[str, int] = {}
        for w in words:
            if len(w) <= LONGEST:
                self.rank.setdefault(w, len(self.rank) + 1)
        #: A place of its own for each two letters, and 0 for the start of a word.
        self.pair: dict[str, float] = {}
        count: dict[str, int] = {}
        for w in words[len(WORDS) :]:
            for x, y in zip("^" + w, w, strict=False):
                count[x + y] = count.get(x + y, 0) + 1
        for x in "^abcdefghijklmnopqrstuvwxyz" if count else "":
            total = sum(count.get(x + y, 0) + 1 for y in "abcdefghijklmnopqrstuvwxyz")
            for y in "abcdefghijklmnopqrstuvwxyz":
                self.pair[x + y] = math.log10(total / (count.get(x + y, 0) + 1))


@lru_cache(maxsize=4)
def dictionary(path: str | None) -> Dictionary:
    if path is None:
        return Dictionary(WORDS)
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    whole = (w.removesuffix("</w>") for w in sorted(vocabulary, key=vocabulary.get) if w.endswith("</w>"))
    return Dictionary(WORDS + [w for w in whole if len(w) > 1 and w.isascii() and w.isalpha()])


ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
NEXT = {(r[i], r[j]) for r in ROWS for i in range(len(r)) for j in (i - 1, i + 1) if 0 <= j < len(r)}
LEET = str.maketrans("430157@$!", "aeoistasi")
_DATE = re.compile(r"(?:19|20)[0-9]{2}(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12][0-9]|3[01]))?)?")
REACH = 32
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")


def _alphabet(value: str) -> int:
    n = 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 10 * any(c.isdigit() for c in value)
    return max(10, n + 33 * any(not c.isalnum() for c in value))


def pieces(value: str, known: Dictionary) -> Iterator[tuple[int, int, float, str]]:
    """(start, end, log10 of guesses, kind) of every piece that a segmentation may use, by start."""
    n, lower = len(value), value.lower()
    plain, one = lower.translate(LEET), math.log10(_alphabet(value))
    if len(lower) != n:  # a letter whose small form is longer
        lower = plain = value
    if known.pair and 5 <= n <= 16 and lower.isascii() and lower.isalpha() and value[1:].islower():
        if sum(known.pair[x + y] for x, y in zip("^" + lower, lower, strict=False)) <= LIKELY * n:
            yield 0, n, UNLISTED, "word"  # as one of a million words that no list here has
    for i in range(n):
        pair = known.pair.get((lower[i - 1] if i and lower[i - 1] in _LETTERS else "^") + value[i])
        yield i, i + 1, one if pair is None else min(one, pair), "brute"
        for j in range(i + 2, min(n, i + LONGEST) + 1):
            for form, extra in ((lower, 0.0), (plain, 0.6)):
                if rank := known.rank.get(form[i:j]):
                    yield i, j, math.log10(rank + 1) + extra + (0.3 if value[i:j] != lower[i:j] else 0.0), "word"
        if m := _DATE.match(value, i):
            yield i, m.end(), math.log10(150 * (365 if m.end() - i > 4 else 1)), "date"
        for unit in range(1, 5):
            j = i + unit
            while j < min(n, i + REACH * unit) and value[j] == value[j - unit]:
                j += 1
            times = (j - i) // unit
            if times >= (3 if unit == 1 else 2):
                yield i, i + times * unit, one * unit + math.log10(times), "repeat"
        j = i + 1
        while j < min(n, i + REACH) and (lower[j - 1], lower[j]) in NEXT:
            j += 1
        if j - i >= 3:
            yield i, j, math.log10(47 * (j - i)) + 0.3 * (j - i) / 3, "walk"


#: log10 of the rank of an unlisted word, and the mean cost of letters up to which a value looks like one.
UNLISTED, LIKELY = 6.0, 1.3
#: The choice of a further kind of piece.
FURTHER = 0.3


def guess_cost(value: str, known: Dictionary | None = None) -> tuple[float, list[tuple[str, str]]]:
    """log10 of the guesses of the cheapest segmentation, and its (kind, part) pieces; letters by brute force side by side are one part."""
    n = len(value)
    best, how = [0.0] + [math.inf] * n, [(0, "")] * (n + 1)
    # best: with whatever piece last; open: with a brute-force piece last, which goes on without a further choice
    open_, back = [math.inf] * (n + 1), [(0, "")] * (n + 1)
    for i, j, cost, kind in pieces(value, known or dictionary(None)):
        c = best[i] + cost + (FURTHER if i else 0.0)
        if kind == "brute":
            on = open_[i] + cost
            open_[j], back[j] = (on, (i, "on")) if on < c else (c, (i, "new"))
            if open_[j] < best[j]:
                best[j], how[j] = open_[j], (i, "brute")
        elif c < best[j]:
            best[j], how[j] = c, (i, kind)
    parts, j = [], n
    while j:
        i, kind = how[j]
        if kind == "brute":
            start, (i, state) = j - 1, back[j]
            while state == "on":
                start = i - 1
                i, state = back[i]
            i = start
        parts.append((kind, value[i:j]))
        j = i
    return best[n], parts[::-1]


def _proposed(text: str, min_log10: float, known: Dictionary) -> Iterator[tuple[str, int, int, float | None]]:
    # every pattern of assignment or context holds one of these words
    if _WORD_HINT.search(text):
        for m in _ASSIGN.finditer(text):
            if len(m[1]) >= 8:
                yield "assign", *m.span(), guess_cost(m[1], known)[0]
        for m in _CONTEXT.finditer(text):
            group = m.lastgroup if m.lastgroup != "prose" else "value"
            value = m[group] if group != "value" else m[group].rstrip(",;.)")
            # words between blanks are prose, quoted or not
            if len(value) < 6 or _NO_SECRET.fullmatch(value) or ((m["prose"] or " " in value) and not _UNLIKE_PROSE.search(value)):
                continue
            if (cost := guess_cost(value, known)[0]) >= min_log10:
                yield "guess", m.start(group), m.start(group) + len(value), cost
        for m in _BEARER.finditer(text):
            if (cost := guess_cost(m["value"], known)[0]) >= min_log10:
                yield "guess", *m.span("value"), cost
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                yield "access", *m.span(), None
    for m in _HEX.finditer(text):
        yield "hex", *m.span(), None


def find_secrets(text: str | None, min_log10: float = 10.0, words: str | None = None) -> list[dict]:
    text = text or ""
    # a value may be found by its header and by its word
    once = dict.fromkeys(_proposed(text, min_log10, dictionary(words)))
    out = [{"kind": k, "start": s, "end": e, "log10_guesses": c, "value": text[s:e]} for k, s, e, c in once]
    return sorted(out, key=lambda x: (x["start"], KINDS.index(x["kind"])))


def parted(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that few texts are in memory in two forms at once."""
    for b in batches:
        yield from few(b, rows, 2 << 20)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_log10: float = 10.0, words: str | None = None) -> DataFrame:
    """(id, spans) of each row: spans with kind, start, end (code points), log10_guesses and value."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("log10_guesses", pa.float64()), ("value", pa.string())]))
        for b in parted(batches):
            spans = [find_secrets(t, min_log10, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["id", "spans"])
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, spans {SCHEMA}").withColumnRenamed("id", id_col)


def mask_column(df: DataFrame, text_col: str = "text", min_log10: float = 10.0, mask: str = "<secret>", words: str | None = None) -> DataFrame:
    """df, its rows and columns, with every secret in the text replaced; texts without one are left alone."""
    names = df.columns
    at = names.index(text_col)

    def run(batches):
        for b in parted(batches):
            texts = b.column(at).to_pylist()
            for i, t in enumerate(texts):
                out, done = [], 0
                for s in find_secrets(t, min_log10, words):
                    if s["start"] >= done:
                        out += [t[done : s["start"]], mask]
                    # a value goes to its end, also where the pattern's letters do not
                    whole = s["kind"] in ("assign", "guess")
                    done = max(done, _TAIL.match(t, s["end"]).end() if whole else s["end"])
                if out:
                    texts[i] = "".join([*out, t[done:]])
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(at).type) if k == at else b.column(k) for k in range(len(names))], names)
        dictionary.cache_clear()
        give_back()

    return df.mapInArrow(run, df.schema)


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = scan(table(spark, sf_dir, "documents"), words=public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", *(c.alias(k) for k, c in span_digests(BASE).items()))
