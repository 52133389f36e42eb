import hashlib
import random
import re

from sparvane.llm import pii

SCHEMA = "doc_id long, text string, base string, more string, spans string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute_force(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def texts():
    rng = random.Random(8)
    pieces = ["a@b.c", "x.y@z-1.co.uk", "@", "a@b", "é", "😀", " ", "\n", "1.2.3.4", "300.1.1.1", "001.02.003.4", ".", "4111 1111 1111 1111", "4111-1111-1111-1112", "-", "+1 (499) 555-6503", "+44 20 7946 0958", "+", "1", "23", "(", "_d@e.f", "%", "5.6.7.8.9.10.11.12", "+49)3", "card ", "0000000000000000"]
    out = ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(700)]
    long_ = ["1" * 60_000, "1 2 " * 30_000, "a" * 60_000, "a@" * 20_000, "1." * 30_000, "a@b" + ".c" * 30_000, "+1" + " " * 30_000, "x" * 50_000 + " me@here.org " + "😀" * 1000 + " 1.1.1.1"]
    return [None, "", *out, *long_]


def test_base_spans_equal_brute_force(spark):
    rows = [(i, t, "b", "m", None) for i, t in enumerate(texts())] + [(None, "a@b.c", "", "", ""), (3, "a@b.c", "", "", "")]
    got = pii.find(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    wanted = sorted((str(i), hashlib.sha256(brute_force(t).encode()).hexdigest(), *(brute_force(t).count(k + ":") for k in PATTERNS)) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == wanted
    by_id = {r.doc_id: r for r in got if r.doc_id not in (None, 3)}
    for i, t, *_ in rows[:-2]:
        if i != 3:
            assert set(filter(None, brute_force(t).split(","))) <= set(by_id[i].spans.split(","))


def test_labelers_add_told_spans_and_redaction_removes_them(spark):
    told = [(i, f"please call my phone 0{300 + i} 555 {1000 + i} or mail joe{i} (at) site{i} (dot) org now", "", "", "") for i in range(60)]
    plain = [(100 + i, f"order 0{300 + i} 555 {1000 + i} of version 300.1.{i}.2 and nothing else", "", "", "") for i in range(60)]
    mixed = [(200, "write to a@b.org or +1 (499) 555-6503 from 8.8.8.8; 4111 1111 1111 1111", "k", None, "s"), (201, None, "", "", "")]
    frame = spark.createDataFrame(told + plain + mixed, SCHEMA)
    got = {r.doc_id: r for r in pii.find(frame).collect()}
    assert all(got[i].spans.startswith("phone:21:") and "email:" in got[i].spans for i in range(60))
    assert not any("ip:" in got[100 + i].spans or "card:" in got[100 + i].spans for i in range(60))
    clean = pii.redact(frame)
    assert clean.columns == frame.columns and clean.count() == frame.count()
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[200] == "write to <email> or <phone> from <ip>; <card>" and text[201] is None
    assert text[5] == "please call my phone <phone> or mail <email> now" and ".1.5.2" in text[105]


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert pii.find(frame).count() == 0 and pii.redact(frame).count() == 0


def test_expectation_finds_the_reliable_labeler():
    rng, cells = random.Random(1), {}
    for _ in range(4000):
        truth = rng.random() < 0.3
        votes = tuple(rng.choice((-1, 1)) if rng.random() < noise else (1 if truth else -1) for noise in (0.1, 0.2, 0.9))
        cells[votes] = cells.get(votes, 0) + 1
    belief = pii._expectation([("card", v, False, n) for v, n in cells.items()])
    assert belief["card", (1, 1, -1), False] > 0.9 and belief["card", (-1, -1, 1), False] < 0.1
