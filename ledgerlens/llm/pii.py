"""Personal data: patterns propose spans, validators confirm, context scores.

Regular expressions propose e-mail addresses, IPv4 addresses, card numbers,
phone numbers and IBANs.  Octet ranges, the Luhn sum, digit counts and the
mod-97 remainder confirm them.  Every confirmed span starts from its kind's
score, which words near it raise or lower; spans under ``REPORT_FROM`` are not
reported, except that the four base kinds always are.

Offsets are code points, ends exclusive.  Defined cases: null or empty text has
no spans; repeated rows give repeated results; an empty table gives an empty
result; matches that fail their check are dropped and not tried again from a
later character.  Columns other than ``doc_id`` and ``text`` are not read.  A text of
any length is searched whole, in time in proportion to it.  An IBAN has its
country's length and ends there, whatever word follows; other countries have none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import spread, table

BASE_KINDS, KINDS = ("email", "ip", "card", "phone"), ("email", "ip", "card", "phone", "iban")
REPORT_FROM, NEAR = 0.5, 40
#: A digit run is entered at its start only (a match cannot start inside one),
#: which keeps long runs linear; the matches are those of the plain patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}"),
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Characters of an IBAN by country, of the public registry.
IBAN_SIZES = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18,
    DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23,
    IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19,
    MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SC=31, SE=24, SI=19, SK=24,
    SM=27, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)
IBAN_RESTS = {n: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in {*IBAN_SIZES.values()}}
START = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.6}
RAISE = {
    "email": r"mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|login",
    "card": r"card|visa|credit|debit|karte|carte|tarjeta",
    "phone": r"phone|call|tel\b|mobile|fax|telefon|tél",
    "iban": r"iban|bank|account|konto|compte|cuenta",
}
LOWER = r"example|sample|dummy|version|order no|isbn"
RAISE = {k: re.compile(v, re.IGNORECASE) for k, v in RAISE.items()}
LOWER = re.compile(LOWER, re.IGNORECASE)


def digits_of(span: str) -> str:
    return re.sub("[^0-9]", "", span)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(span: str) -> bool:
    plain = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def octets(span: str) -> bool:
    parts = [p.lstrip("0") for p in span.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


CONFIRM = {
    "email": lambda s: True,
    "ip": octets,
    "card": lambda s: 13 <= len(d := digits_of(s)) <= 19 and luhn(d),
    "phone": lambda s: 9 <= len(digits_of(s)) <= 15,
    "iban": mod97,
}


def proposals(kind: str, text: str):
    """``(start, end)`` of the kind's leftmost non-overlapping matches."""
    if kind == "email":
        # from each @ outwards: characters before it are looked at once, however long their run
        done, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            domain = DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                done = domain.end()
                yield start, done
            at = text.find("@", at + 1)
    elif kind == "iban":
        done = 0
        for m in PATTERNS[kind].finditer(text):
            rest = IBAN_RESTS[size].match(text, m.end()) if m.start() >= done and (size := IBAN_SIZES.get(m.group()[:2])) else None
            if rest:
                done = rest.end()
                yield m.start(), done
    elif kind != "phone" or "+" in text:
        for m in PATTERNS[kind].finditer(text):
            yield m.span()


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` by kind as listed, then start."""
    out = []
    for kind in KINDS:
        for start, end in proposals(kind, text):
            if not CONFIRM[kind](text[start:end]):
                continue
            near = text[max(0, start - NEAR) : start] + "\n" + text[end : end + NEAR]
            score = START[kind] + 0.2 * bool(RAISE[kind].search(near)) - 0.2 * bool(LOWER.search(near))
            if kind in BASE_KINDS or score >= REPORT_FROM:
                out.append((kind, start, end, round(min(1.0, max(0.0, score)), 2)))
    return out


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``, a row for each row of ``docs``."""
    names = ("kind", "start", "end", "score")
    item = pa.struct(list(zip(names, (pa.string(), pa.int32(), pa.int32(), pa.float64()))))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[dict(zip(names, s)) for s in spans_of(t.as_py() or "")] for t in batch], pa.list_(item))

    return spread(docs.select("doc_id", "text")).select("doc_id", F.arrow_udf(run, SPANS).asNondeterministic()("text").alias("spans"))


def redact(text: str | None) -> str | None:
    """The text with each reported span replaced by its kind in brackets."""
    if not text:
        return text
    out, at = [], 0
    for kind, start, end, _ in sorted(spans_of(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join(out) + text[at:]


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
        count("iban"),
    )


QUERIES = {"op10_pii": op10_pii}
