"""Base spans against the plain patterns; votes and added spans."""

import re

import pytest
from llm import personal_data
from tests.llm.conftest import edge_texts, frame

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "a@b.c_d@e.f mail: x.y+z@mail-1.example.com.", "@x.y a@b a@@b.c ._%@q.r.s-", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112; 4111 1111 1111 1111 5", "call +49 (30) 123-456 78. +1 2 +1 (234) 555-0100x",
    "ß 😀 é +1 (555) 010-2000 😀 a@b.co 10.0.0.1", "5500005555555559" * 3, "0" * 15 + " 0-0-0-0-0-0-0-0-0-0-0-0",
    "a.b@c.d" * 50, "12-34 56-78-90 12-34", "+12345678901234567890", "x@y.z\n+1234567890\n1.1.1.1",
]


def luhn(digits):
    total = 0
    for at, c in enumerate(reversed(digits)):
        v = int(c) * (1 + at % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = (
                kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15
            )
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_base_spans(spark):
    rows = [*edge_texts(), *((100 + k, t) for k, t in enumerate(TEXTS)), (100, TEXTS[0])]
    got = [(r.doc_id, [(s.start, s.rank, s.end, s.kind) for s in r.spans if s.base])
           for r in personal_data.personal_data(frame(spark, rows).repartition(3)).collect()]
    assert sorted(got, key=repr) == sorted(((i, brute(t)) for i, t in rows), key=repr)


def test_loose_spans_are_added(spark):
    rows = [(k, f"Please contact me by mail: jane.{k}@mail.example.com or tel. +1 (234) 555-01{k:02d}") for k in range(40)]
    rows += [(100, "write to e-mail jane.doe (at) example (dot) com"), (101, "call tel. (030) 123-4567 now"), (102, "version 030-1234567")]
    found = {r.doc_id: [(s.kind, s.base) for s in r.spans] for r in personal_data.personal_data(frame(spark, rows)).collect()}
    assert found[100] == [("email", False)] and found[101] == [("phone", False)] and found[102] == []
    assert found[0] == [("email", True), ("phone", True)]


def test_reliabilities_tell_labelers_apart():
    counts = [("email", (1, 1, 1, 1), 80), ("email", (0, -1, -1, -1), 60), ("email", (1, 1, -1, 1), 10), ("email", (0, -1, 1, -1), 10)]
    share, chance, posterior = personal_data.reliabilities(counts)
    assert 0.4 < share["email"] < 0.7
    assert posterior["email", (1, 1, -1, 1)] > 0.9 > 0.1 > posterior["email", (0, -1, 1, -1)]
    assert chance[1][1] > chance[2][1] > 0.5 > chance[1][0]


def test_masked(spark):
    rows = [(1, "ß a@b.co, 10.0.0.1!"), (2, "none"), (3, None), (4, "+1 (555) 010-2000"), (5, "5500005555555559 1")]
    left = {r.doc_id: r for r in personal_data.masked(frame(spark, rows)).collect()}
    assert left[1].text == "ß [EMAIL], [IP]!" and left[1].n_chars == len(left[1].text)
    assert left[2].text == "none" and left[3].text is None and left[4].text == "[PHONE]"
    assert personal_data.masked(frame(spark, rows)).columns == frame(spark, rows).columns


@pytest.mark.parametrize("rows", [[], [(1, "nothing")]])
def test_nothing_to_find(spark, rows):
    assert [list(r.spans) for r in personal_data.personal_data(frame(spark, rows)).collect()] == [[]] * len(rows)
    assert personal_data.masked(frame(spark, rows)).count() == len(rows)


def test_masked_nested_and_crossing_spans(spark):
    texts = [
        "to john.10.0.0.1.doe@corp.com now", "+4915112345679@mail.de", "4111111111111111@host.example.com!", "ß 4111 1111 1111 1111@x.de 😀",
        "a 10.0.0.1.5.6@b.co, 4111-1111-1111-1111.z@c.de", *TEXTS,
    ]
    docs = frame(spark, list(enumerate(texts)))
    found = {r.doc_id: r.spans for r in personal_data.personal_data(docs).collect()}
    assert any(a.end > b.end for s in found.values() for a, b in zip(s[:-1], s[1:], strict=True))
    assert any(b.start < a.end < b.end for s in found.values() for a, b in zip(s[:-1], s[1:], strict=True))
    for r in personal_data.masked(docs).collect():
        hidden = {at for s in found[r.doc_id] for at in range(s.start, s.end)}
        want = ""
        for at, sign in enumerate(texts[r.doc_id]):
            want += "".join(f"[{s.kind.upper()}]" for s in found[r.doc_id] if s.start == at)
            want += "" if at in hidden else sign
        assert r.text == want and r.n_chars == len(want)
