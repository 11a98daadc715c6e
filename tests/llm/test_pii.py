import hashlib
import random
import re

import pytest

from varicube.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return [int(c) for c in text if c.isdigit()]


def luhn(ds):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(ds))) % 10 == 0


def plain(text):
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15],
    }


@pytest.mark.parametrize("alphabet", ["ab@.-", "12.3 -", "+1 ()-.23", "a1@.+ -2:é", "0123456789 -"])
def test_base_spans_by_plain_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == plain(text), text


def test_query_rows(documents, edge, empty):
    for frame in (documents, edge):
        got = sorted(map(tuple, pii.find(frame).collect()), key=str)
        want = []
        for r in frame.select("doc_id", "text").collect():
            base = plain(r["text"] or "")
            spans = sorted(((a, b, k) for k in pii.BASE for a, b in base[k]), key=lambda s: (s[0], pii.KINDS.index(s[2])))
            text = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
            want.append((r["doc_id"], *(len(base[k]) for k in pii.BASE), hashlib.sha256(text.encode()).hexdigest()))
        assert sorted((g[:6] for g in got), key=str) == sorted(want, key=str)
    assert pii.find(empty).count() == 0


def test_anchors():
    anchors = pii.automaton()
    found = lambda t: [(t[a:b], k) for a, b, k in pii.anchored(t, anchors)]
    assert found("İ see https://bob:secret@host.example/x and http://plain.example/") == [("https://bob:secret@host.example", "link")]
    assert found("write mailto:ann@mail.example.") == [("mailto:ann@mail.example.", "link")]
    assert found("IBAN: DE89 3704 0044 0532 0130 00 please") == [("DE89 3704 0044 0532 0130 00", "account")]
    assert found("IBAN: DE88 3704 0044 0532 0130 00") == []
    assert found("Account number: 1234 5678 90, passport no. 123456789; SSN 123-45-6789") == [
        ("1234 5678 90", "account"), ("123456789", "account"), ("123-45-6789", "account")
    ]
    assert found("the lessn 123456789") == []


def test_long_runs_are_linear():
    for run in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + " " * 200_000, "a@" * 100_000, "iban " * 40_000):
        pii.base_spans(run)
        pii.anchored(run, pii.automaton())


def test_very_long_zeros():
    zeros = "0" * 5000
    assert pii.base_spans(f"{zeros}.{zeros}1.2.3 x")["ip"] == [(0, 10_006)]
    assert pii.base_spans(f"{zeros}.1.2.{zeros}256")["ip"] == []
