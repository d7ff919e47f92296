"""Personal data: patterns propose spans, checksums confirm them, context words move their scores.

Defined results: a null text counts as empty; repeated rows give repeated results; an empty table gives none; other
columns are ignored.  Every step is linear in the text, so very long texts need no cut.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignspark.llm.common import in_slices, rows_of, table

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
WORD = re.compile(r"[^\W\d_]+")

# Length of each country's IBAN, as registered.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

#: Whole words that, near a span, raise its score.
CONTEXT = {
    "card": frozenset("card cards visa mastercard credit debit carte karte kreditkarte tarjeta".split()),
    "phone": frozenset("phone phones telephone call tel mobile telefon handy fax".split()),
    "iban": frozenset("iban bank account accounts konto compte cuenta transfer".split()),
    "email": frozenset("mail email e contact write".split()),
    "ip": frozenset("ip host server address".split()),
}
#: Whole words that, near a span, lower it: what follows is made up.
AGAINST = frozenset("example sample dummy fake invalid placeholder".split())
#: A pattern's score, what a passed checksum adds by its strength, what a context word within WINDOW characters adds or takes; an added span needs LEAST.
PATTERN, CHECKED, NEAR, WINDOW, LEAST = 0.4, {"ip": 0.4, "card": 0.3, "iban": 0.4}, 0.2, 40, 0.75


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 check of an IBAN without spaces."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses; walks from each @ to both sides, so long words cost no retries."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return found


def chains(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Maximal chains of digit runs with one blank or hyphen between: first and last run, start and end."""
    out, i = [], 0
    while i < len(runs):
        j = i
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
        out.append((i, j, runs[i][0], runs[j][1]))
        i = j + 1
    return out


def ips(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    found, i = [], 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(four, four[1:], strict=False)):
            parts = [text[a:b].lstrip("0") for a, b in four]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append((four[0][0], four[3][1]))
            i += 4
        else:
            i += 1
    return found


def ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers of their country's length, single blanks between groups allowed, that pass mod 97; one try a start."""
    found, at = [], 0
    while m := IBAN.search(text, at):
        at = m.start() + 1  # a failed match may hide one that begins within it
        left, end = IBAN_LENGTH.get(text[m.start() : m.start() + 2], 0) - 4, m.end()
        while left > 0 and end < len(text):
            end += text[end] == " "
            c = text[end : end + 1]
            if not ("0" <= c <= "9" or "A" <= c <= "Z"):
                break
            end, left = end + 1, left - 1
        if left == 0 and not (text[end : end + 1].isascii() and text[end : end + 1].isalnum()) and mod97(text[m.start() : end].replace(" ", "")):
            found.append((m.start(), end))
            at = end
    return found


def score(text: str, kind: str, start: int, end: int) -> float:
    """The span's score: its pattern, its checksum, and the whole words within WINDOW characters."""
    near = {*WORD.findall(text[max(0, start - WINDOW) : start].lower()), *WORD.findall(text[end : end + WINDOW].lower())}
    return round(PATTERN + CHECKED.get(kind, 0.0) + NEAR * (not near.isdisjoint(CONTEXT[kind])) - NEAR * (not near.isdisjoint(AGAINST)), 3)


def spans_of(text: str) -> list[Span]:
    """All spans by start, then kind: the base ones, and IBANs and cards of 12 or 13 digits whose checksum and context reach LEAST."""
    found: list[Span] = []

    def add(kind: str, start: int, end: int, base: bool) -> None:
        own = score(text, kind, start, end)
        if base or own >= LEAST:
            found.append(Span(kind, start, end, own, base))

    if "@" in text:
        for a, b in emails(text):
            add("email", a, b, True)
    runs = [m.span() for m in DIGITS.finditer(text)]
    if runs:
        for a, b in ips(text, runs):
            add("ip", a, b, True)
        for i, j, a, b in chains(text, runs):
            n = sum(y - x for x, y in runs[i : j + 1])
            if 12 <= n <= 19 and luhn("".join(text[x:y] for x, y in runs[i : j + 1])):
                add("card", a, b, n >= 14)
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    add("phone", *m.span(), True)
        for a, b in ibans(text):
            add("iban", a, b, False)
    found.sort(key=lambda s: (s.start, KINDS.index(s.kind)))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """text with every span (overlapping ones together) replaced by its kind in brackets."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"


def find_pii(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", redact: bool = False) -> DataFrame:
    """id, spans (kind, start, end, score, base) for every row; with redact also redacted_text (null stays null).

    Kept in the executors: one narrow pass, no shuffle.
    """
    kind = documents.schema[id_column].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))

    def run(batches):
        for part in in_slices(batches, "text"):
            texts = part.column("text").to_pylist()
            found = [spans_of(t) if t else [] for t in texts]
            columns = [part.column("id"), pa.array([[s._asdict() for s in f] for f in found], span)]
            if redact:
                columns.append(pa.array([redacted(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "spans", "redacted_text"][: len(columns)])

    out = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    out = rows_of(out, run, f"id {kind}, spans {SPANS}" + ", redacted_text string" * redact)
    return out.withColumnRenamed("id", id_column)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays, its spans replaced by their kinds."""

    def run(batches):
        for part in in_slices(batches, "text"):
            texts = [redacted(t, f) if t and (f := spans_of(t)) else t for t in part.column("text").to_pylist()]
            new = pa.array(texts, pa.string())
            columns = {n: part.column(n) for n in part.schema.names} | {"text": new, "n_chars": pc.cast(pc.utf8_length(new), part.schema.field("n_chars").type)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows_of(docs, run, docs.schema)


QUERIES = {"op2_pii": op2_pii}
SQL: dict[str, str] = {}
