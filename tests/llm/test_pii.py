import random
import re

from shelfwise.llm import op4_pii as op4


def brute(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and op4.luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return op4.ordered(out)


def test_base_spans_against_plain_patterns():
    rng = random.Random(2)
    parts = ["a", "B.", "@", "-", "1", "23", ".", "456", " ", "+", "(", ")", "@x.y", "é", "00", "4111 1111 1111 1111", "+1 (017) 555-7713", "10.0.0.255"]
    for _ in range(20_000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert op4.base_spans(s) == brute(s), s


def test_long_runs_are_not_quadratic():
    for s in ("1" * 300_000, "a" * 300_000, "a" * 100_000 + "@", "+1" + "." * 200_000, "1." * 100_000, "1 " * 100_000):
        op4.candidates(s)


def test_the_classifier_decides_loose_spans(spark):
    sure = [f"email: user{i}@mail.example.com and phone +1 (017) 555-7{i:03d}" for i in range(200)]
    odd = ["tel: (017) 555-7713-22 call", "serial 1234567890123 of 2019-2020", "contact: jane (at) example (dot) com"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(sure + odd)], "doc_id long, text string")
    model = op4.fit(df)
    rows = {r["doc_id"]: r["pii"] for r in op4.find(df, model).collect()}
    assert all("email" in rows[i]["base"] and "phone" in rows[i]["spans"] for i in range(200))
    assert all(set(filter(None, r["base"].split(","))) <= set(r["spans"].split(",")) for r in rows.values())
    assert "[EMAIL]" in rows[0]["masked"] and "@" not in rows[0]["masked"]
    assert rows[201]["masked"] == odd[1]


def test_edge_rows(edge, nothing):
    model = op4.fit(edge)
    for r in op4.find(edge, model).collect():
        base = op4.listed(brute(r["text"] or ""))
        assert r["pii"]["base"] == base
        assert (r["pii"]["masked"] is None) == (r["text"] is None)
    assert op4.find(nothing, op4.fit(nothing)).collect() == []


def test_documents(small):
    for r in op4.find(small, op4.fit(small)).collect():
        assert r["pii"]["base"] == op4.listed(brute(r["text"]))
        assert brute(r["pii"]["masked"]) == []


def test_masks_do_not_overlap():
    assert op4.mask("0123456789", [(1, 4, "ip"), (3, 6, "card"), (8, 9, "phone")]) == "0[IP]67[PHONE]9"
