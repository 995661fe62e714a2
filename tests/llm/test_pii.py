import hashlib
import re
import time

from ledgerlens.llm.pii import CONFIRM, find_pii, luhn, mod97, op10_pii, redact, spans_of

from .helpers import documents, write_table

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "write to a.b+c@mail.example.com, or x@y and a@b.c_d@e.f.g",
    "hosts 10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0004 99999.1.1.1",
    "é card 4111 1111 1111 1111 or 4111-1111-1111-1112, 12345678901234567890123",
    "call +1 (555) 010-9999 or +12 or +44 20 7946 0958 0000 0000 00",
    "bank iban DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432 DE89370400440532013001",
    "4012888888881881 5500-0000-0000-0004",
    "a@" * 50 + "b.c",
    "1" * 3000,
    "_a@b.c_d@e.f x@@y.z @a.b a.@-.-.x é@x.y %+@1.2@3.4",
    "",
    None,
]


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if CONFIRM[kind](m.group())]
    return out


def test_base_spans_match_plain_patterns():
    for text in TEXTS:
        assert [s[:3] for s in spans_of(text or "") if s[0] != "iban"] == plain(text)


def test_validators():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("GB82 WEST 1234 5698 7654 32") and not mod97("GB82 WEST 1234 5698 7654 33")


def test_context_adjusts_scores_and_iban_is_found():
    kinds = [s[0] for s in spans_of(TEXTS[4])]
    assert kinds.count("iban") == 2
    with_word, without = spans_of("my card 4111111111111111"), spans_of("xx 4111111111111111")
    assert with_word[0][3] > without[0][3]


def test_query(spark, tmp_path):
    docs = documents(spark, TEXTS).selectExpr("*", "1 as spans", "2 as n_ip")
    write_table(spark, tmp_path, "documents", docs)
    rows = {r.doc_id: r for r in op10_pii(spark, str(tmp_path)).collect()}
    for i, text in enumerate(TEXTS):
        base = plain(text)
        assert [rows[i][f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in base) for k in PLAIN]
        digest = hashlib.sha256(",".join("%s:%d:%d" % s for s in base).encode()).hexdigest()
        assert rows[i].base_sha256 == digest
    assert find_pii(docs.limit(0)).count() == 0


def test_long_runs_take_time_in_proportion():
    began = time.time()
    for text in ("a@" + "b" * 1_000_000, "a" * 1_000_000, "a@" * 400_000, "1" * 1_000_000, "1.1." * 250_000, "DE89 " * 200_000):
        spans_of(text)
    assert time.time() - began < 20
    assert [s[:3] for s in spans_of("x" * 1_000_000 + "@y.z")] == [("email", 0, 1_000_004)]


def test_iban_ends_with_its_country_length():
    for text in ("ES91 2100 0418 4502 0005 1332 EUR", "bank PL61109010140000071219812874 PLN", "NO93 8601 1117 947 is it"):
        assert [s[0] for s in spans_of(text) if s[0] == "iban"] == ["iban"], text
    assert not [s for s in spans_of("ES91 2100 0418 4502 0005 1333 EUR XX91 2100 0418 4502 0005 1332") if s[0] == "iban"]


def test_redaction():
    assert redact("to a@b.co now") == "to [email] now"
    assert redact(None) is None
