import hashlib
import random
import re

import numpy as np

from qhapaq.llm import personal, registry


def brute(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans():
    rng = random.Random(2)
    for letters in ("0123456789  ..--@@++()aZ_é%\n", "019.@a-", "4 0-"):
        for _ in range(6000):
            t = "".join(rng.choice(letters) for _ in range(rng.randrange(70)))
            assert personal.base_spans(t) == brute(t), t


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = registry.op8_personal_data(spark, d).collect()
    assert len(got) == len(rows)
    for r in got:
        base = brute(rows[r["doc_id"]])
        names = [f"{personal.BASE[k]}:{a}:{b}" for k, a, b in base]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for k, *_ in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest() and set(names) <= set(r["spans"].split(","))


def _counted(truth, kind, rates, rng):
    out = {}
    for t in truth:
        votes = "".join("+" if (t if rng.random() < a else not t) else "-" for a in rates)
        out[kind, votes] = out.get((kind, votes), 0) + 1
    return out


def test_em_finds_the_reliable_labelers_of_each_kind():
    rng = np.random.default_rng(0)
    patterns = _counted(rng.random(6000) < 0.6, "phone", (0.95, 0.9, 0.85, 0.5, 0.8, 0.6), rng)
    patterns |= _counted(rng.random(6000) < 0.5, "social", (0.6, 0.9, 0.85, 0.95, 0.8, 0.5), rng)
    prior, tables, soft = personal.reliabilities(patterns)
    right, other = tables["phone"][:, 1, 2], tables["social"][:, 1, 2]
    assert abs(prior["phone"] - 0.6) < 0.03 and abs(right[0] - 0.95) < 0.03 and abs(right[3] - 0.5) < 0.06
    assert abs(other[0] - 0.6) < 0.05 and abs(other[3] - 0.95) < 0.03
    assert soft["phone", "++++++"] > 0.99 and soft["phone", "------"] < 0.01


def test_proposed_spans_and_checks(spark):
    texts = ["write to jane.doe [at] mail.example [dot] com or call (275) 555-5927", "ssn 123-45-6789", "iban DE89 3704 0044 0532 0130 00", "my name is Maria Lopez", "version 1.2.3 section 12-34", "ssn 000-12-3456",
             "MAIL JOHN.DOE [AT] EXAMPLE.COM"]
    found = [[(personal.KINDS[k], t[a:b]) for k, a, b in personal.proposed_spans(t, personal.base_spans(t))] for t in texts]
    assert found[0] == [("at_email", "jane.doe [at] mail.example [dot] com"), ("local_phone", "(275) 555-5927")]
    assert found[1] == [("social", "123-45-6789")] and found[2] == [("account", "DE89 3704 0044 0532 0130 00")] and found[3] == [("person", "Maria Lopez")] and found[4] == []
    assert found[6] == [("at_email", "JOHN.DOE [AT] EXAMPLE.COM")]
    rows = spark.createDataFrame(list(enumerate(texts * 20)), "doc_id long, text string")
    got = {r["row"]["doc_id"]: {s["kind"] for s in r["found"]} for r in personal.find(rows).collect()}
    assert "account" in got[2] and "social" in got[1] and "social" not in got[5]


def _planted(rng, n):
    """(text, personal spans that no fixed pattern finds) with look-alikes that are none."""
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: rng.choice(["jane.doe", "k.lopez", "info", "hr_team", "m.rossi"]) + d(2)
    host = lambda: rng.choice(["example", "mail", "firma", "posta"]) + d(1)
    phone = lambda: f"({rng.randint(200, 989)}) {rng.randint(200, 999)}-{d(4)}"
    social = lambda: f"{rng.randint(100, 600)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
    out = []
    for _ in range(n):
        good, text = rng.choice([
            lambda: ((s := f"{name()} [at] {host()} [dot] com"), f"for more write to {s} please"), lambda: ((s := phone()), f"call us by phone {s} today"),
            lambda: ((s := social()), f"his ssn {s} is on file"), lambda: ((s := "DE89 3704 0044 0532 0130 00"), f"pay to iban {s} now"),
            lambda: (None, f"order {rng.randint(100, 999)}-{d(3)}-{d(4)}x of the serial {rng.randint(100, 999)} {d(3)} {d(4)}/9"), lambda: (None, f"see section {social()}/4 of the release"),
            lambda: (None, f"invoice no DE12 {d(4)} {d(4)} {d(4)} {d(4)} 11 was sent"), lambda: (None, f"version {rng.randint(100, 999)}.{d(3)}.{d(4)}-beta")])()
        out.append((text, good))
    return out


def test_added_spans_are_right(spark):
    cases = _planted(random.Random(9), 1200)
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    added, right, wanted = 0, 0, sum(s is not None for _, s in cases)
    for r in personal.find(rows).collect():
        text, s = cases[r["row"]["doc_id"]]
        spans = [text[x["start"]: x["end"]] for x in r["found"] if x["kind"] not in personal.BASE]
        added, right = added + len(spans), right + (s in spans)
    assert right / wanted > 0.95 and right / added > 0.95


def test_odd_rows(odd, none):
    got = personal.find(odd)
    assert got.select("row.*").columns == odd.columns and got.count() == odd.count()
    assert personal.digest(personal.find(odd, keep=["doc_id"])).filter("doc_id = 9").first()["n_email"] == 1
    assert personal.find(none).count() == 0
