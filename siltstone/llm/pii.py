"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (email, ip, card, phone) are always reported. The method adds iban (mod-97 must hold) and
ssn (no checksum exists, so it needs a context word). Every span carries a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
REPORT_FROM, NEAR = 0.5, 48
#: Score without context, and words nearby that raise or lower it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
RAISE = {
    "email": ("mail", "contact"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social", "security"),
}
LOWER = {"ip": ("version", "release"), "card": ("order", "isbn", "serial"), "phone": ("score",), "ssn": ("part", "model")}

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards, so that long runs without one cost nothing. The domain may hold no
    match where its first label is followed by no dot."""
    upto, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > upto and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            upto = m.end()
            at = text.find("@", upto)
        else:
            # no later match can begin before this @: it isn't in the local part's class
            upto = at + 1
            at = text.find("@", upto)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        span = m.group()
        while len(plain := span.replace(" ", "")) >= 15:
            if len(plain) <= 34 and mod97(plain):
                yield m.start(), m.start() + len(span)
                break
            span = span.rpartition(" ")[0]


def score(kind: str, text: str, start: int, end: int) -> float:
    near = re.findall(r"[a-z]+", (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower())
    return round(PRIOR[kind] + 0.3 * any(w.startswith(x) for x in RAISE[kind] for w in near) - 0.3 * any(w.startswith(x) for x in LOWER.get(kind, ()) for w in near), 3)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """Spans (kind, start, end, score) of one text, by start, then in the order of KINDS."""
    text, found = text or "", []
    if "@" in text:
        found += [("email", *x) for x in emails(text)]
    for m in IP.finditer(text):
        if all(len(x) < 4 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m.group().split("."))):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub(r"[\x20-]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.append(("phone", *m.span()))
    found += [("iban", *x) for x in ibans(text)]
    found += [("ssn", *m.span()) for m in SSN.finditer(text)]
    scored = [(k, s, e, score(k, text, s, e)) for k, s, e in found]
    return sorted((x for x in scored if x[0] in BASE or x[3] >= REPORT_FROM), key=lambda x: (x[1], KINDS.index(x[0])))


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one,
    named after the first."""
    if not text or not (spans := find(text)):
        return text
    out, upto, i = [], 0, 0
    while i < len(spans):
        kind, start, end, _ = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[upto:start], f"<{kind.upper()}>"]
        upto = end
    return "".join(out) + text[upto:]


SPANS = "array<struct<kind: string, start: int, end: int, score: double>>"
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id and spans, an array of (kind, start, end, score) in code points.

    No shuffle. A null or empty text has no spans; repeated rows and ids are searched each by
    themselves; an empty table gives no rows; other columns are not read. A text of any length is
    searched whole, in time that grows with its length."""

    def run(batches):
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e, "score": v} for k, s, e, v in find(x.as_py())] for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, ARROW_SPANS)], names=["id", "spans"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, spans {SPANS}").select(F.col("id").alias(id_col), "spans")


def redact(docs: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """docs with every span in its text replaced; all rows and columns stay, under any name, and the column of
    lengths, where there is one, is that of the new text. A null or empty text stays as it is, with its length; repeated rows are
    rewritten each by themselves; an empty table gives no rows; a text of any length is searched whole."""
    at = docs.columns.index(text_col)
    length = docs.columns.index(n_chars_col) if n_chars_col in docs.columns else None

    def run(batches):
        for b in batches:
            texts = [redacted(x.as_py()) for x in b.column(at)]
            columns = list(b.columns)
            columns[at] = pa.array(texts, b.schema.field(at).type)
            if length is not None:
                columns[length] = pa.array([n.as_py() if t is None else len(t) for t, n in zip(texts, b.column(length), strict=True)], b.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    from siltstone.llm.common import table

    found = find_pii(table(spark, sf_dir, "documents"))
    named = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(F.array_join(F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","), 256).alias("base_sha256"),
        F.array_join(named, ",").alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
