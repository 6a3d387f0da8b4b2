import hashlib
import re
import time

from pyspark.sql import functions as F

from millrace.llm import pii, queries
from millrace.session import table

#: The base patterns as they are defined, without the care for long runs.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    found = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m.group().split("."))
            elif kind == "card":
                turned = [int(c) for c in digits[::-1]]
                total = sum(turned[::2]) + sum(sum(divmod(2 * d, 10)) for d in turned[1::2])
                ok = 14 <= len(digits) <= 19 and total % 10 == 0
            else:
                ok = kind == "email" or 10 <= len(digits) <= 15
            if ok:
                found.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(found)]


HARD = [
    None, "", "a@b@c.de x", "a@b", "..a@b.c.d.", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.4", "1.2.3 4.5.6.7", "x@y.z@w.v", "4111 1111-1111 1111",
    "4111111111111112", "+1 (555) 010-9999.", "++49 30 1234567", "+1-", "😀 a@b.c 😀 10.0.0.1", "5500005555555559 4 +4111111111111111", "12 3 4 5-6", "+49 30 123-",
    "IBAN DE89 3704 0044 0532 0130 00 ok", "GB82WEST12345698765432", "DE00 3704 0044 0532 0130 00", "a@b.c,d@e.f", "a@b..c", "1..2.3.4.5", "99999.1.1.1 1.1.1.1",
]


def test_base_spans_are_those_of_the_plain_patterns(spark, sf):
    texts = HARD + [r.text for r in table(spark, sf, "documents").collect()]
    for t in texts:
        assert [f"{pii.KINDS[n]}:{a}:{b}" for a, n, b, _ in pii.spans(t) if pii.KINDS[n] in pii.BASE] == plain(t), t


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = queries.op8_personal_data(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in want) for k in PLAIN)
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_checksums_and_context():
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")
    kinds = lambda t: [pii.KINDS[n] for _, n, _, _ in pii.spans(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00 ok") == ["iban"]
    assert "iban" not in kinds("IBAN DE00 3704 0044 0532 0130 00")
    assert pii.score("ip", "server address 1.2.3.4", 15, 22) > pii.score("ip", "version 1.2.3.4", 8, 15)


def test_redaction(odd_docs, make_docs):
    out = {r.doc_id: r for r in pii.redacted(make_docs([(1, "mail a@b.de now", "s"), (2, None, "s"), (3, "clean", None)])).collect()}
    assert (out[1].text, out[1].n_chars, out[2].text, out[3].text) == ("mail [EMAIL] now", 16, None, "clean")
    assert pii.redact("x 5500005555555559 y +4111111111111111") == "x [CARD] y +[CARD]"
    assert pii.redacted(odd_docs).count() == odd_docs.count()
    assert pii.redacted(odd_docs.limit(0)).count() == 0
    assert odd_docs.select(F.size(pii.personal_data(F.col("text"))).alias("n")).agg(F.sum("n")).first()[0] == 0


def test_long_runs_take_linear_time():
    began = time.time()
    for t in ("a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "1 " * 1_000_000, "+" * 2_000_000, "a@" * 500_000, "A" * 1_000_000, "+1 " * 500_000, "AB12" * 300_000):
        pii.spans(t)
    assert time.time() - began < 60


def test_ibans_before_other_capitals_and_digits():
    def ibans(t):
        return [t[a:b] for a, n, b, _ in pii.spans(t) if pii.KINDS[n] == "iban"]

    spaced, solid, other = "DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    for t in (f"{spaced} BIC COBADEFFXXX", f"{spaced} I paid", f"to {spaced} 2024", f"AB12 {spaced} X"):
        assert ibans(t) == [spaced], t
    assert ibans(f"{solid} 2024") == ibans(f"AA00 1234 {solid} I") == [solid]
    assert ibans(f"{spaced} {other} A1") == [spaced, other]
    assert ibans("DE88 3704 0044 0532 0130 00 BIC COBADEFFXXX") == []
    assert pii.redact(f"{solid} I paid") == "[IBAN] I paid"


def test_many_starts_of_ibans_take_linear_time():
    began = time.time()
    pii.spans("AB12 " * 100_000)
    assert time.time() - began < 30


def test_context_words_are_whole_words():
    iban = "DE89 3704 0044 0532 0130 00"
    for text in (f"send it to my partner: {iban}", f"the apartment, {iban}", f"serialised {iban}"):
        assert pii.redact(text) == text.replace(iban, "[IBAN]")
    assert pii.redact(f"serial {iban}") == f"serial {iban}"
    assert pii.score("ip", "a zip 1.2.3.4", 6, 13) == 0.5 and pii.score("ip", "an IP 1.2.3.4", 6, 13) == 0.7
    assert pii.score("phone", "hotel +49 30 1234567", 6, 20) == 0.6 and pii.score("phone", "tel. +49 30 1234567", 5, 19) == 0.8


def test_clashing_columns(odd_docs):
    for name in ("spans", "kind", "_WORD"):
        out = pii.redacted(odd_docs.withColumn(name, F.lit(1)))
        assert out.columns == [*odd_docs.columns, name] and out.count() == odd_docs.count()
