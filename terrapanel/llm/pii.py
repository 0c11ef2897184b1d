"""Personal data by anchor expansion: one Aho-Corasick pass finds anchors, local parsers expand and validate them.

Anchors are at-signs, "://" schemes, a plus before a digit, digits joined by a
dot, a blank, a hyphen or nothing, and cue words of secrets. From each anchor a
deterministic parser walks left and right to the boundaries of an e-mail
address, an IP address, a payment card, a phone number, a URL or a secret.

Base kinds (email, ip, card, phone) are leftmost and non-overlapping by kind;
failing matches are dropped and not retried. The method adds url (scheme,
"://" and what follows up to white space) and secret (a cue word, then = or :,
then a value in quotes or a run of 16 or more word characters).

Defined cases: null and empty texts have no spans; offsets are code points, end
exclusive; long texts are read once, from anchor to anchor; repeated rows are
each judged; a null doc_id stays null; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidy, worker_cache

KINDS = ("email", "ip", "card", "phone", "url", "secret")
BASE_KINDS = KINDS[:4]
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key")
_DIGITS = "0123456789"
_ALNUM = frozenset(_DIGITS + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_DIGIT = frozenset(_DIGITS)
_PHONE = _DIGIT | frozenset(" ().-")
_SECRET = _ALNUM | frozenset("_-+/=")
_SCHEME = _ALNUM | frozenset("+.-")


def automaton():
    """The anchors' automaton: each pattern's value is its class and length."""
    cache = worker_cache()
    if "pii" not in cache:
        import ahocorasick

        auto = ahocorasick.Automaton()
        auto.add_word("@", ("email", 1))
        auto.add_word("://", ("url", 3))
        for a in _DIGITS:
            auto.add_word("+" + a, ("phone", 2))
            for b in _DIGITS:
                auto.add_word(f"{a}.{b}", ("ip", 3))
                for sep in ("", " ", "-"):
                    auto.add_word(a + sep + b, ("card", 2 + len(sep)))
        for cue in CUES:
            for form in {cue, cue.upper(), cue.capitalize()}:
                auto.add_word(form, ("secret", len(form)))
        auto.make_automaton()
        cache["pii"] = auto
    return cache["pii"]


def _run(text: str, i: int, chars: frozenset) -> int:
    """End of the run of chars that begins at i."""
    n = len(text)
    while i < n and text[i] in chars:
        i += 1
    return i


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    end = _run(text, at + 1, _LABEL)
    if end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == ".":
        more = _run(text, end + 1, _LABEL)
        if more == end + 1:
            break
        end, dots = more, dots + 1
    return (start, end) if dots else None


def _chain(text: str, inside: int) -> list[tuple[int, int]]:
    """The digit runs joined by single dots around a digit."""
    a = inside
    while a > 0 and (text[a - 1] in _DIGIT or text[a - 1] == "." and a > 1 and text[a - 2] in _DIGIT):
        a -= 1
    runs = []
    while True:
        b = _run(text, a, _DIGIT)
        runs.append((a, b))
        if b + 1 < len(text) and text[b] == "." and text[b + 1] in _DIGIT:
            a = b + 1
        else:
            return runs


def _byte_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _card_chain(text: str, inside: int) -> tuple[int, int]:
    """The longest chain of digits around a digit, joined by at most one blank or hyphen each."""
    a = inside
    while a > 0:
        if text[a - 1] in _DIGIT:
            a -= 1
        elif text[a - 1] in " -" and a > 1 and text[a - 2] in _DIGIT:
            a -= 2
        else:
            break
    b, n = inside + 1, len(text)
    while b < n:
        if text[b] in _DIGIT:
            b += 1
        elif text[b] in " -" and b + 1 < n and text[b + 1] in _DIGIT:
            b += 2
        else:
            break
    return a, b


def _phone(text: str, plus: int) -> tuple[int, int] | None:
    first = plus + 2
    end = _run(text, first, _PHONE)
    while end > first and text[end - 1] not in _DIGIT:
        end -= 1
    return (plus, end) if end - first >= 2 else None


def _url(text: str, at: int) -> tuple[int, int] | None:
    start = at
    while start > 0 and text[start - 1] in _SCHEME:
        start -= 1
    while start < at and not (text[start].isascii() and text[start].isalpha()):
        start += 1
    if start == at:  # before anything is read to the right, so that a run of anchors takes one pass
        return None
    end, n = at + 3, len(text)
    while end < n and not text[end].isspace() and text[end] not in "<>\"'":
        end += 1
    return (start, end) if end > at + 3 else None


def _secret(text: str, end: int) -> tuple[int, int] | None:
    i, n = end, len(text)
    while i < n and text[i] == " ":
        i += 1
    if i >= n or text[i] not in "=:":
        return None
    i += 1
    while i < n and text[i] in " \"'":
        i += 1
    stop = _run(text, i, _SECRET)
    return (i, stop) if stop - i >= 16 else None


def find_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each list in order and without overlaps."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    email_end = ip_end = card_end = phone_end = url_end = secret_end = 0
    for last, (kind, size) in automaton().iter(text):
        at = last + 1 - size
        if kind == "card":
            if at < card_end:
                continue
            a, card_end = _card_chain(text, at)
            digits = "".join(c for c in text[a:card_end] if c in _DIGIT)
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out["card"].append((a, card_end))
        elif kind == "email":
            if at >= email_end and (span := _email(text, at, email_end)):
                out["email"].append(span)
                email_end = span[1]
        elif kind == "ip":
            if at < ip_end:
                continue
            runs = _chain(text, at)
            ip_end = runs[-1][1]
            for k in range(0, len(runs) - 3, 4):
                if all(_byte_part(text[a:b]) for a, b in runs[k : k + 4]):
                    out["ip"].append((runs[k][0], runs[k + 3][1]))
        elif kind == "phone":
            if at >= phone_end and (span := _phone(text, at)):
                phone_end = span[1]
                if 8 <= sum(c in _DIGIT for c in text[span[0] : span[1]]) <= 15:
                    out["phone"].append(span)
        elif kind == "url":
            if at >= url_end and (span := _url(text, at)):
                out["url"].append(span)
                url_end = span[1]
        elif last + 1 > secret_end and (span := _secret(text, last + 1)):
            out["secret"].append(span)
            secret_end = span[1]
    return out


def _joined(spans: dict, kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


_FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def with_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) judged: doc_id, counts of the base kinds, base_sha256 and all spans."""

    @tidy
    def judge(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                s = find_spans(text.as_py())
                rows.append((*(len(s[k]) for k in BASE_KINDS), hashlib.sha256(_joined(s, BASE_KINDS).encode()).hexdigest(), _joined(s, KINDS)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, f"doc_id long, {_FOUND}")


def redact_text(text: str | None) -> str | None:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the one that begins first (then the longer) counts."""
    if not text:
        return text
    spans = sorted(((a, -b, k) for k, s in find_spans(text).items() for a, b in s))
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
            done = -b
    return "".join(out) + text[done:] if out else text


def redacted(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(col):
        return col.map(redact_text, na_action="ignore")

    return run(text)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
