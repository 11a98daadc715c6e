"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of the added kinds: schemes ("https://", "mailto:") and identifier cues ("iban",
"account", "passport"). From an anchor, small deterministic parsers expand to the borders of the datum and validate it.
Base kinds do not go through the automaton: emails expand from at-signs that a search finds; ip, card and phone are plain
regular expressions over the whole text, whose matches are then validated.

Base kinds, leftmost and without overlap inside a kind: email (around an at-sign), ip (four numbers up to 255), card (12 to
19 digits that pass Luhn), phone (a plus sign and 9 to 15 digits). Added by the method: ``link``, a link that carries a
login or a mail address; ``account``, an IBAN that passes its check or the digits after an account, social security or
passport cue. Added spans have kinds of their own, so the base spans and their counts stay as they are.

Every parser reads a datum's characters a bounded number of times, so a long run of digits or letters costs linear time.

Defined cases: null and empty texts have no spans; offsets are code points, the end is exclusive; repeated rows give
equal rows; invalid UTF-8 is replaced; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from varicube.llm.common import slim_batches, utf8

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "link", "account")

# Cues and what follows them.
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")
IBAN_CUES = ("iban",)
NUMBER_CUES = (
    "account number", "account no", "account #", "acct", "bank account", "routing number", "kontonummer", "numéro de compte",
    "número de cuenta", "passport number", "passport no", "social security number", "ssn", "tax id",
)

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_number_after = re.compile(r"[\s:#.=]{0,4}(?:is\s|no\.?\s|number\s)?[\s:#]{0,2}([0-9](?:[ -]?[0-9]){5,19})(?![0-9A-Za-z])", re.IGNORECASE)
_iban_after = re.compile(r"[\s:#=]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_authority = re.compile(r"[^\s/?#\"'<>]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    total += sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def iban_passes(text: str) -> bool:
    value = 0
    for c in text[4:] + text[:4]:
        value = (value * 10 + int(c)) % 97 if c.isdigit() else (value * 100 + ord(c) - 55) % 97
    return value == 1


def emails(text: str) -> list[tuple[int, int]]:
    spans, floor = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _local:
            start -= 1
        if start < at and (match := _domain.match(text, at + 1)):
            spans.append((start, match.end()))
            floor = match.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    return spans


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    spans = []
    for m in _card.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append(m.span())
    return spans


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _phone.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, anchors in (("scheme", SCHEMES), ("iban", IBAN_CUES), ("number", NUMBER_CUES)):
        for anchor in anchors:
            found.add_word(anchor, (kind, len(anchor)))
    found.make_automaton()
    return found


def _lower(text: str) -> str:
    """Lower case with one character for each, so that offsets stay."""
    lowered = text.lower()
    return lowered if len(lowered) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def anchored(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """Spans that schemes and cues lead to; inside a kind none overlap, the leftmost stays."""
    links, accounts = [], []
    for last, (kind, length) in anchors.iter(_lower(text)):
        after = last + 1
        if kind == "scheme":
            match = _authority.match(text, after)
            if match and "@" in match[0].strip("@"):
                links.append((last + 1 - length, match.end(), "link"))
            continue
        begins = last + 1 - length
        if begins and text[begins - 1].isalnum():
            continue
        match = (_iban_after if kind == "iban" else _number_after).match(text, after)
        if match and (kind == "number" or _iban_end(match[1])):
            end = match.end(1) if kind == "number" else match.start(1) + _iban_end(match[1])
            accounts.append((match.start(1), end, "account"))
    spans = []
    for group in (links, accounts):
        floor = 0
        for start, end, kind in sorted(set(group), key=lambda s: (s[0], -s[1])):
            if start >= floor:
                spans.append((start, end, kind))
                floor = end
    return spans


def _iban_end(text: str) -> int:
    """Length of the longest leading part that passes the IBAN check, 0 if none does."""
    ends = [i + 1 for i, c in enumerate(text) if c != " "]
    for n in range(min(34, len(ends)), 14, -1):
        if iban_passes(text[: ends[n - 1]].replace(" ", "")):
            return ends[n - 1]
    return 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    return {"email": emails(text), "ip": ips(text), "card": cards(text), "phone": phones(text)}


def joined(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in order)


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    counts = [f"n_{kind}" for kind in BASE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in slim_batches(batches):
            rows = []
            for data in utf8(batch.column("text")):
                text = data.decode("utf-8", "replace")
                base = base_spans(text)
                spans = [(a, b, kind) for kind in BASE for a, b in base[kind]]
                digest = hashlib.sha256(joined(spans).encode()).hexdigest()
                rows.append((*(len(base[kind]) for kind in BASE), digest, joined(spans + anchored(text, anchors))))
            columns = list(zip(*rows))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", *counts, "base_sha256", "spans"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
