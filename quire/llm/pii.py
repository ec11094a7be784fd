"""Personal data: regular expressions propose, checksums confirm, context words adjust the score.

Every text is read whole. Base kinds (email, ip, card, phone) are the leftmost non-overlapping
matches of their pattern; a match that fails its check is dropped and not tried again, one that
passes always stays. The extra kinds stay if their check holds and their score reaches ``threshold``: iban by mod-97, ssn by its ranges,
nir (French, with key mod 97), dni (Spanish, letter mod 23) and steuer (German, digit by ISO 7064 mod 11, 10).

A score starts at the kind's prior; words of the kind near the match (whole words, within ``WINDOW`` characters on either side) raise it,
words of other numbers lower it, both once at most.

Null and empty texts have no spans; rows that repeat give the same spans each; spans that start together come in the order of KINDS; columns beside
the two that are named are never read, so their names can't clash; an empty table gives an empty
one. Work and memory are linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import span_digests, table

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "ssn", "nir", "dni", "steuer"]
SCHEMA = "array<struct<kind:string,start:int,end:int,score:double,value:string>>"

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a run of digits can match only if the run's first digit does, so it is not tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")

_NIR = re.compile(r"(?<![0-9A-Za-z])[1-478] ?[0-9]{2} ?[0-9]{2} ?(?:[0-9]{2}|2[AB]) ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![0-9A-Za-z])")
_DNI = re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{8}|[XYZ]-?[0-9]{7})-?[A-Z](?![0-9A-Za-z])")
_STEUER = re.compile(r"(?<![0-9A-Za-z])[1-9][0-9](?: ?[0-9]{3}){3}(?![0-9A-Za-z])")

# Score of a confirmed match without context, and the words near it that raise and lower it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "nir": 0.7, "dni": 0.5, "steuer": 0.4}
RAISING = {
    "email": "mail email e contact write courriel correo",
    "ip": "ip ipv4 address host server adresse direccion",
    "card": "card visa mastercard amex credit debit payment carte kreditkarte tarjeta",
    "phone": "phone tel telephone telefon telefono call mobile cell fax whatsapp",
    "iban": "iban account bank konto compte cuenta transfer",
    "ssn": "ssn social security",
    "nir": "nir insee securite sécurité sociale",
    "dni": "dni nie nif documento identidad",
    "steuer": "steuer steuerid idnr identifikationsnummer tax tin",
}
_OTHER = "order invoice serial part item isbn issn sku tracking ticket sample example"
LOWERING = {"ip": f"version release firmware section chapter {_OTHER}", "email": "example sample"} | {k: _OTHER for k in ("card", "phone", "iban", "ssn", "nir", "dni", "steuer")}
_SETS = {k: (frozenset(RAISING[k].split()), frozenset(LOWERING[k].split())) for k in PRIOR}
ADJUST, WINDOW = 0.3, 48
_TOKEN = re.compile(r"[^\W_]+")


def score(kind: str, text: str, start: int, end: int) -> float:
    """Of a confirmed match, between 0 and 1."""
    lo, hi = max(0, start - WINDOW), min(len(text), end + WINDOW)
    # words that the window cuts are not whole
    while lo and lo < start and text[lo - 1].isalnum():
        lo += 1
    while hi < len(text) and hi > end and text[hi].isalnum():
        hi -= 1
    near = set(_TOKEN.findall(text[lo:start].lower())) | set(_TOKEN.findall(text[end:hi].lower()))
    up, down = _SETS[kind]
    return min(1.0, max(0.0, PRIOR[kind] + ADJUST * (not near.isdisjoint(up)) - ADJUST * (not near.isdisjoint(down))))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def key97(nir: str) -> bool:
    number = nir[:13].replace("2A", "19").replace("2B", "18") if nir[5:7] in ("2A", "2B") else nir[:13]
    return number.isdigit() and 97 - int(number) % 97 == int(nir[13:])


def letter23(dni: str) -> bool:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(dni[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == dni[-1]


def mod11_10(digits: str) -> bool:
    product = 10
    for d in digits[:-1]:
        product = ((int(d) + product) % 10 or 10) * 2 % 11
    return (11 - product) % 10 == int(digits[-1])


_NUMBERS = [("nir", _NIR, " ", key97), ("dni", _DNI, "-", letter23), ("steuer", _STEUER, " ", mod11_10)]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern's leftmost matches: a match starts where the run of local characters before an @ does."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL_END.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, start)
        at = text.find("@", max(at + 1, done))


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        yield from (("email", s, e) for s, e in _emails(text))
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        value = m[0]
        while len(short := value.replace(" ", "")) >= 15:
            if len(short) <= 34 and mod97(short):
                yield "iban", m.start(), m.start() + len(value)
                break
            if " " not in value[4:]:
                break
            value = value[: value.rindex(" ")]
    if "-" in text:
        for m in _SSN.finditer(text):
            if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
                yield "ssn", *m.span()
    for kind, pattern, between, check in _NUMBERS:
        for m in pattern.finditer(text):
            if check(m[0].replace(between, "")):
                yield kind, *m.span()


def find_spans(text: str | None, threshold: float = 0.6) -> list[dict]:
    text = text or ""
    out = []
    for kind, s, e in _proposed(text):
        value = score(kind, text, s, e)
        if kind in BASE or value >= threshold:
            out.append({"kind": kind, "start": s, "end": e, "score": value, "value": text[s:e]})
    return sorted(out, key=lambda x: (x["start"], KINDS.index(x["kind"])))


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """(id, spans) of each row: spans with kind, start, end (code points), score and value."""

    def run(batches):
        for b in batches:
            spans = [find_spans(t, threshold) for t in b.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["id", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, spans {SCHEMA}").withColumnRenamed("id", id_col)


def redact(text: str | None, spans: list[dict]) -> str:
    """The text with each span replaced by its kind; overlapping spans merge under the first's name."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [(text or "")[at : s["start"]], f"<{s['kind']}>"]
        at = max(at, s["end"])
    return "".join([*out, (text or "")[at:]])


def op3_pii(spark, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 1)), ",").alias("scores")
    return found.select("doc_id", *(c.alias(k) for k, c in span_digests(BASE).items()), scores)
