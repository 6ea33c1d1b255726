"""Personal data in texts: exact base spans, and more spans by weak supervision.

Base spans follow fixed patterns and always stay. Further candidates come from
looser patterns; labellers of three sorts (patterns, word lists, context) vote
on every candidate, expectation-maximisation over the counts of vote
combinations of all candidates estimates how far each is to be trusted, and the
posterior labels train a linear classifier of spans that takes the decision.

Positions are code points. A null text is empty. Matching is linear in the
text, also for a huge run of digits or letters.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.store import slices
from tallyloom.llm.weak import Reliability, estimate, sigmoid, train_linear
from tallyloom.session import settle

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE_KINDS = 4
#: Candidates that train the classifier: those with the smallest hashes.
TRAIN_SPANS = 20_000
#: Hashed features of the span classifier.
FEATURES = 1 << 12
#: Code points before and after a span that count as its context.
CONTEXT = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ANY = re.compile(r"[0-9@]|\b(?:at|AT)\b")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Looser patterns for candidates beyond the base.
_SPELT = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+ ?(?:\(at\)|\[at\]|(?<= )at(?= )|(?<= )AT(?= )) ?"
    r"[A-Za-z0-9-]{1,63}+ ?(?:\(dot\)|\[dot\]|(?<= )dot(?= )|(?<= )DOT(?= )) ?[A-Za-z]{2,10}\b"
)
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9.-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

_CUES = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|courriel|correo|kontakt)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|login|adresse|client)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|payment|carte|karte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|telefon|t[eé]l[eé]fono|ring)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social|security)\b", re.I),
}
_AGAINST = re.compile(r"\b(?:version|release|section|chapter|figure|isbn|order|item|page|build|id|no)\.?\s*[:#]?\s*$", re.I)
# Fixed values, the gazetteers: endings and names of mail domains, lengths of account numbers by country,
# issuers of cards by leading digits and number of digits, calling codes, numbers that are printed as examples.
_ENDINGS = frozenset(
    "com org net edu gov mil int info biz name io co me tv ai app dev de fr es uk eu us it nl ch at be pt ie lu dk se fi"
    " no pl cz sk hu ro bg gr hr si ee lv lt is ru ua tr ca mx br ar cl au nz jp cn kr in za".split()
)
_PROVIDERS = frozenset(
    "gmail googlemail yahoo hotmail outlook live msn icloud aol gmx web mail protonmail proton posteo orange wanadoo free"
    " laposte sfr freenet arcor libero tiscali virgilio telefonica terra yandex zoho fastmail".split()
)
_IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MT": 31,
    "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
# First and last leading digits, and the numbers of digits.
_ISSUERS = [
    ("4", "4", (16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)),
    ("6011", "6011", (16, 19)), ("644", "659", (16, 19)), ("3528", "3589", (16, 17, 18, 19)), ("300", "305", (14,)),
    ("36", "36", (14,)), ("38", "39", (14,)), ("62", "62", (16, 17, 18, 19)), ("50", "50", (16,)), ("56", "58", (16, 17, 18, 19)),
]
_CALLING_CODES = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90"
    " 91 92 93 94 95 98 21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 85 88 96 97 99"
).split()
_EXAMPLES = frozenset(["078-05-1120", "219-09-9999", "123-45-6789", "111-11-1111"])


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from each @ sign."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(done, at + 1))
    return found


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base, by start and then kind as listed."""
    found: list[tuple[int, int, int]] = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part) <= 3 and int(part or 0) <= 255 for part in (p.lstrip("0") for p in m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(a, KINDS[kind], b) for a, kind, b in sorted(found)]


def candidates(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Further spans worth a vote that no base span overlaps."""
    found = [(m.start(), "card", m.end()) for m in _CARD.finditer(text) if 14 <= sum(c.isdigit() for c in m[0]) <= 19]
    for kind, pattern in (("phone", _LOCAL_PHONE), ("iban", _IBAN), ("ssn", _SSN), ("email", _SPELT)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    out, taken = [], sorted((a, b) for a, _, b in base)
    at = done = 0
    for a, kind, b in sorted(found):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if a >= done and not (at < len(taken) and taken[at][0] < b):
            out.append((a, kind, b))
            done = b
    return out


def _iban_ok(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _listed(kind: str, span: str, digits: str) -> int:
    """What the gazetteers say of a span: -1 no, 0 nothing, 1 yes."""
    if kind == "email":
        parts = re.split(r"[^a-z0-9-]+", re.split(r"@|\(at\)|\[at\]|\bat\b", span.lower())[-1])
        return 1 if parts[-1] in _ENDINGS or _PROVIDERS.intersection(parts) else -1
    if kind == "iban":
        return 1 if _IBAN_LENGTHS.get(span[:2]) == len(span.replace(" ", "")) else -1
    if kind == "card":
        known = any(len(digits) in sizes and low <= digits[: len(low)] <= high for low, high, sizes in _ISSUERS)
        return 1 if known else -1
    if kind == "ip":
        first = span.split(".")[0].lstrip("0")
        return -1 if first in ("", "127") or (len(first) == 3 and first >= "224") else 1
    if kind == "phone" and span[0] == "+":
        return 1 if digits.startswith(tuple(_CALLING_CODES)) else -1
    return -1 if kind == "ssn" and span in _EXAMPLES else 0


LABELLERS = ["format", "checksum", "list", "context", "against", "shape"]


def votes_on(text: str, start: int, kind: str, end: int) -> list[int]:
    """One vote per labeller: -1 no, 0 nothing to say, 1 yes."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits = [c for c in span if c in "0123456789"]
    strict = {"email": "@" in span, "ip": True, "card": len(digits) in (15, 16), "phone": span[0] == "+", "iban": True, "ssn": True}
    out = [1 if strict[kind] else 0]
    if kind == "card":
        out.append(1 if luhn("".join(digits)) else -1)
    elif kind == "iban":
        out.append(1 if _iban_ok(span) else -1)
    elif kind == "ssn":
        out.append(-1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1)
    else:
        out.append(0)
    out.append(_listed(kind, span, "".join(digits)))
    out.append(1 if _CUES[kind].search(before) or _CUES[kind].search(after[:12]) else 0)
    out.append(-1 if _AGAINST.search(before) else 0)
    out.append(-1 if digits and len(set(digits)) <= 2 and len(digits) > 4 else 0)
    return out


def features_of(text: str, start: int, kind: str, end: int, votes: list[int]) -> list[int]:
    """Hashed features of a span: kind, shape, neighbours and votes."""
    span = text[start:end]
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", span))[:24]
    before = text[max(0, start - CONTEXT) : start].split()
    names = [f"{kind}", f"{kind} shape {shape}", f"{kind} length {min(end - start, 40)}", f"after {text[end : end + 1]}"]
    names += [f"{kind} word {word.lower()}" for word in before[-2:]]
    names += [f"{kind} vote {name} {vote}" for name, vote in zip(LABELLERS, votes)]
    return sorted({zlib.crc32(name.encode()) % FEATURES for name in names})


def digest(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


_FOUND = "array<struct<start: long, kind: int, stop: long, base: boolean, votes: array<int>, features: array<int>>>"


def scan(docs: DataFrame) -> DataFrame:
    """All spans and candidates of every text of ``docs`` (doc_id, text), with votes and features."""
    schema = f"doc_id long, found {_FOUND}"
    kind = pa.list_(
        pa.struct(
            [("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("base", pa.bool_())]
            + [("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                rows = []
                for text in part.column("text").to_pylist():
                    row: list[dict] = []
                    if text and _ANY.search(text):
                        base = base_spans(text)
                        more = [(*span, True) for span in base] + [(*span, False) for span in candidates(text, base)]
                        for start, name, end, fixed in more:
                            votes = votes_on(text, start, name, end)
                            features = features_of(text, start, name, end, votes)
                            spot = {"start": start, "kind": KINDS.index(name), "stop": end}
                            row.append({**spot, "base": fixed, "votes": votes, "features": features})
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def learn(scanned: DataFrame, train_spans: int = TRAIN_SPANS) -> tuple[Reliability, np.ndarray]:
    """Reliabilities from all candidates, and the classifier's weights from a bounded sample of them."""
    spans = scanned.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
    counted = spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes").collect()
    kinds = np.array([row["kind"] for row in counted], dtype=np.int64)
    votes = np.array([row["votes"] for row in counted], dtype=np.int64).reshape(len(counted), len(LABELLERS))
    model = estimate(kinds, votes, np.array([row["n"] for row in counted], dtype=float), len(KINDS))
    order = [F.xxhash64("doc_id", "start", "kind"), "doc_id", "start", "kind"]
    chosen = spans.orderBy(*order).limit(train_spans).select("kind", "votes", "features").collect()
    own = np.array([row["votes"] for row in chosen], dtype=np.int64).reshape(len(chosen), len(LABELLERS))
    target = model.posterior(np.array([row["kind"] for row in chosen], dtype=np.int64), own) if chosen else np.zeros(0)
    indices = [np.array(row["features"], dtype=np.int64) for row in chosen]
    return model, train_linear(indices, [np.ones(len(i)) for i in indices], target, FEATURES)


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_private(docs: DataFrame, train_spans: int = TRAIN_SPANS, least: float = 0.5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): numbers of base spans, their digest, and all spans.

    A null or empty text has no spans, so zeros, the digest of the empty string
    and an empty list. Null and repeated doc_ids and repeated rows are rows of
    their own, each with its own result; an empty table gives none. Spans that
    begin at one place come in the order of the kinds.
    """
    scanned = settle(scan(docs))
    _, weights = learn(scanned, train_spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = []
            for found in batch.column("found").to_pylist():
                base = [(f["start"], f["kind"], f["stop"]) for f in found if f["base"]]
                more = [
                    (f["start"], f["kind"], f["stop"])
                    for f in found
                    if not f["base"] and sigmoid(weights[f["features"]].sum() + weights[-1]) >= least
                ]
                named = [(a, KINDS[kind], b) for a, kind, b in sorted(base)]
                counts = [sum(kind == k for _, kind, _ in base) for k in range(BASE_KINDS)]
                everything = [(a, KINDS[kind], b) for a, kind, b in sorted(base + more)]
                rows.append([*counts, hashlib.sha256(digest(named).encode()).hexdigest(), digest(everything)])
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
            arrays = [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return scanned.mapInArrow(run, _OUT)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each (start, end, kind) replaced by <KIND>; overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, train_spans: int = TRAIN_SPANS, least: float = 0.5) -> DataFrame:
    """``docs`` (doc_id, text and any others) with the spans of ``find_private`` masked; n_chars follows the text.

    Null texts stay null, texts without spans as they are. Every row stays, repeated
    ones too, with all its columns whatever their names; an empty table stays empty.
    """
    _, weights = learn(settle(scan(docs)), train_spans)

    def clean(text: str) -> str:
        base = base_spans(text)
        spans = [(start, end, kind) for start, kind, end in base]
        for start, kind, end in candidates(text, base):
            features = features_of(text, start, kind, end, votes_on(text, start, kind, end))
            if sigmoid(weights[features].sum() + weights[-1]) >= least:
                spans.append((start, end, kind))
        return mask(text, spans) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                texts = [clean(t) if t and _ANY.search(t) else t for t in part.column("text").to_pylist()]
                at = part.schema.get_field_index("text")
                part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                yield part

    masked = docs.mapInArrow(run, docs.schema)
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text")).cast(kind)).select(*docs.columns)
