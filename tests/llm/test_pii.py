import hashlib
import random
import re
import time

from tallyglass.llm import pii, queries
from tallyglass.llm.store import table


def brute(text):
    """The base spans by the patterns themselves."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def base(text):
    return ",".join(f"{k}:{s}:{e}" for s, e, k in pii.spans_of(text) if k in pii.BASE)


def more(text):
    return [(k, text[s:e]) for s, e, k in pii.spans_of(text) if k not in pii.BASE]


def test_base_matches_the_patterns_on_random_texts():
    rng = random.Random(5)
    parts = ["a", "Zq", "@", "@", ".", ".", "-", "+", "+1", " ", "  ", "(", ")", "1.2.3.4", "255.0.0.256", "4465758382889437", "4465 7583-8288 9437", "é", "\u0660", "%", "_", "x@y.z", "0", "12", "\n", "555-1055", "1.", "\U0001f600", "İ", "K"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert base(text) == brute(text), text
    digits = "0123456789"
    for _ in range(5_000):
        text = "".join(rng.choice([*digits, *digits, " ", "-", ".", "+", "("]) for _ in range(rng.randrange(60)))
        assert base(text) == brute(text), text


def test_addresses():
    assert more("see https://User:pw@example.com:80/a?b=c#d. (http://10.0.0.1/x) end") == [("address", "https://User:pw@example.com:80/a?b=c#d"), ("address", "http://10.0.0.1/x")]
    assert more("no://-bad x http://999.1.1.1/ ://a.com http://host:99999999/ http://under_/ a://b") == []
    assert more("ftp://[2001:db8::1]/x and http://localhost:8080") == [("address", "ftp://[2001:db8::1]/x"), ("address", "http://localhost:8080")]


def test_accounts():
    assert more('token = "f33e61083d" and password=e3b3ed3cc8548923d6.') == [("account", "f33e61083d"), ("account", "e3b3ed3cc8548923d6")]
    assert more("Account number: 12345678, ACCT#998877 mytoken=123456 token economy 123456 password: hidden") == [("account", "12345678"), ("account", "998877")]
    assert more("IBAN DE89 3704 0044 0532 0130 00 and IBAN DE88 3704 0044 0532 0130 00") == [("account", "DE89 3704 0044 0532 0130 00")]


def test_time_grows_with_the_length_only():
    for piece in ("1", "1.", "a@", "@", "+1 ", "+1-", "a://", "http://a.b/", "token=", "a.", "1 ", "://", "iban ", "a" * 9 + "://" + "b@"):
        start = time.perf_counter()
        pii.spans_of(piece * (1_000_000 // len(piece)))
        assert time.perf_counter() - start < 10, piece


def test_rows_and_digests(spark, edge_docs, clash, no_docs, make_docs):
    docs = make_docs([(1, "\U0001f600 a@b.co or +1 (743) 555-3824", "en", "s"), (1, "\U0001f600 a@b.co or +1 (743) 555-3824", "en", "s"), (None, "1.2.3.4 token=abc1234567", "en", "s"), (2, None)])
    got = sorted((tuple(r) for r in pii.summarised(pii.personal_data(docs)).collect()), key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    spans = "email:2:8,phone:12:29"
    want = [(1, 1, 0, 0, 1, sha(spans), spans)] * 2 + [(2, 0, 0, 0, 0, sha(""), ""), (None, 0, 1, 0, 0, sha("ip:0:7"), "ip:0:7,account:14:24")]
    assert got == sorted(want, key=str)
    assert sorted(map(str, pii.summarised(pii.personal_data(clash)).collect())) == sorted(map(str, pii.summarised(pii.personal_data(edge_docs)).collect()))
    assert pii.personal_data(edge_docs).count() == edge_docs.count() and pii.personal_data(no_docs).count() == 0


def test_masked(make_docs):
    docs = make_docs([(1, "é a@b.co, http://u@h.com/x end"), (2, None), (3, "clean"), (4, "")])
    assert {r["doc_id"]: r["text"] for r in pii.masked(pii.personal_data(docs)).collect()} == {1: "é <email>, <address> end", 2: None, 3: "clean", 4: ""}


def test_the_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, d, "documents").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op13_pii"](spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [len(re.findall(rf"{k}:", want)) for k in pii.BASE]
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
