from __future__ import annotations

import hashlib
import re
import time

from pyspark.sql import functions as F

from wayfind.llm.personal_data import KINDS, find_personal_data, luhn, redact, running_sums, train

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind: str, match: str) -> bool:
    digits = [int(c) for c in match if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text: str) -> tuple:
    spans = sorted((m.start(), i, m.end(), k) for i, k in enumerate(KINDS) for m in re.finditer(PATTERNS[k], text) if passes(k, m.group()))
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    return (*(sum(x[3] == k for x in spans) for k in KINDS), hashlib.sha256(joined.encode()).hexdigest()), joined


def check(rows, texts) -> None:
    want = sorted((str(d), *brute(t)[0]) for d, t in texts)
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want
    by_text = {d: brute(t)[1] for d, t in texts if d is not None}
    for r in rows:
        if r.doc_id in by_text and [d for d, _ in texts].count(r.doc_id) == 1:
            assert set(filter(None, by_text[r.doc_id].split(","))) <= set(filter(None, r.spans.split(",")))


def test_documents_of_the_test_table(documents, texts):
    check(find_personal_data(documents).collect(), texts)


def test_hard_texts(spark):
    texts = [
        "a@b.c@d.e x@y", "a@b.c%d@e.f", "a@b.c.d.e-f..g@h.i", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (017) 555-7713+49 89 12345678",
        "+1+2+345678901234567890", "😀 é a@b.co 😀 1.2.3.4", "9" * 5000, "1." * 5000, "a" * 20000 + "@" + "b." * 5000 + "c", "a@b." * 3000, "+1 " * 3000, "1.1.1.1 " * 500, "@", "a@", "+12345678-9 ", "0" * 12 + " " + "0" * 19,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(find_personal_data(docs).collect(), list(enumerate(texts)))


def test_spelled_addresses_are_added(spark):
    rows = [(i, f"write mail to user{i}@mail{i % 7}.example.com or call +1 (555) 555-{1000 + i} today") for i in range(300)]
    rows += [(1000 + i, f"write mail to user{i} (at) mail{i} (dot) example (dot) com please") for i in range(20)]
    found = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_added == 1 and r.n_email == 0 for r in found if r.doc_id >= 1000)
    assert all(r.n_added == 0 for r in found if r.doc_id < 1000)


def test_running_sums_are_linear_blocks(spark):
    row = spark.range(1).select(running_sums(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda x: x.cast("long"))).alias("s")).first()
    assert row.s == [i * (i + 1) // 2 for i in range(1, 1001)]
    assert spark.range(1).select(running_sums(F.array().cast("array<long>")).alias("s")).first().s == []
    assert spark.createDataFrame([("4111111111111111",), ("4111111111111112",)], "n string").select(luhn(F.col("n")).alias("x")).collect() == [(True,), (False,)]


def test_redaction(spark):
    text = "mail a.b@c.de, ip 1.2.3.4 and +1 (017) 555-7713 end 😀"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "nothing here")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in redact(docs).collect()}
    assert out == {1: "mail [EMAIL], ip [IP] and [PHONE] end 😀", 2: None, 3: "", 4: "nothing here"}


def test_redaction_of_very_many_spans_is_linear(spark):
    pieces = [f"é{i} a{i}@b.org 10.0.0.{i % 250}" for i in range(50_000)]
    docs = spark.createDataFrame([(1, "\n".join(pieces))], "doc_id long, text string")
    began = time.time()
    assert redact(docs).first().text == "\n".join(f"é{i} [EMAIL] [IP]" for i in range(50_000))
    assert time.time() - began < 120


def test_overlapping_spans_become_one(spark):
    docs = spark.createDataFrame([(1, "x +4111111111111111 y"), (2, "a@1.2.3.4 b"), (3, "1.2.3.4@c.de")], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in find_personal_data(docs).collect()}
    for r in redact(docs).collect():
        text, spans, out, at = {1: "x +4111111111111111 y", 2: "a@1.2.3.4 b", 3: "1.2.3.4@c.de"}[r.doc_id], [], "", 0
        for kind, start, end in (s.split(":") for s in found[r.doc_id].split(",")):
            if spans and spans[-1][2] > int(start):
                spans[-1][2] = max(spans[-1][2], int(end))
            else:
                spans.append([kind, int(start), int(end)])
        for kind, start, end in spans:
            out, at = out + text[at:start] + f"[{kind.upper()}]", end
        assert r.text == out + text[at:]


def test_odd_rows(odd, odd_rows, empty):
    check(find_personal_data(odd).collect(), [(r[0], r[1] or "") for r in odd_rows])
    assert redact(odd).columns == odd.columns and redact(odd).count() == len(odd_rows)
    assert train(empty) == [] and find_personal_data(empty).count() == 0 and redact(empty).count() == 0
