"""Personal data, also in disguise, with spans in the source text.

Base spans come from plain scans of the source. For disguised ones a chain of transducers rewrites the
text - look-alike characters to ASCII, zero-width ones to nothing, spelled digits to digits, `at` and
`dot` disguises to marks - and keeps for each character it emits the source span it stands for. The
same kinds are then sought in the normalised text, and what is found is mapped back. A found span is
added if it holds a rewritten character and is not equal to or inside a base span of its kind; it may
hold or cross one, since a base scan often finds a piece of a disguised identifier. Base spans stay.

A bare word `at` counts only if a dot of the domain is disguised too or the name before it has a dot,
underscore or digit in it, so that prose such as "look at example.com" stays alone.

Defined results: a null text counts as empty and has no spans. Repeated rows are scanned once each. An
empty table gives no rows. Every scan is linear in the text's length. Offsets are code points, the end
is exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkin.llm.common import table

KINDS = ("email", "ip", "card", "phone")
SPAN_SCHEMA = "doc_id long, spans array<struct<kind: string, start: int, end: int, base: boolean>>"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Look-alikes that compatibility normalisation does not map to ASCII.
LOOKALIKES = {
    **dict(zip("\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0456\u0458\u0455\u0501\u051b\u051d\u04bb", "aeopcyxijsdqwh", strict=True)),  # small Cyrillic
    **dict(zip("\u0410\u0412\u0415\u041a\u041c\u041d\u041e\u0420\u0421\u0422\u0423\u0425\u0406\u0408\u0405", "ABEKMHOPCTYXIJS", strict=True)),  # capital Cyrillic
    **dict(zip("\u03bf\u03b1\u03bd\u03c1\u03b9", "oavpi", strict=True)),  # small Greek
    **dict(zip("\u0391\u0392\u0395\u0396\u0397\u0399\u039a\u039c\u039d\u039f\u03a1\u03a4\u03a5\u03a7", "ABEZHIKMNOPTYX", strict=True)),  # capital Greek
    **dict(zip("\u0131\u2010\u2011\u2012\u2013\u2212\u3002", "i-----.", strict=True)),
    **dict(zip("\u0251\u0261\uff61", "ag.", strict=True)),
}
#: Zero-width characters and the soft hyphen.
GONE = frozenset("\u200b\u200c\u200d\u2060\ufeff\u00ad")
#: Marks for a bare `at` and a disguised dot.
AT, DOT = "\ue000", "\ue001"
#: Digits as words in English, French, Spanish and German; words for the at sign and the dot.
DIGITS = {
    w: str(i)
    for words in (
        "zero one two three four five six seven eight nine",
        "z\u00e9ro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
        "null eins zwei drei vier f\u00fcnf sechs sieben acht neun",
        "oh",
    )
    for i, w in enumerate(words.split())
}
WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
AT_WORDS, DOT_WORDS = "at|arroba|arobase", "dot|punto|point|punkt"
GAP = r"[\s_-]{1,3}"

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: First letters of what is rewritten at the start of a word.
FIRST = "".join(sorted({w[0] for w in DIGITS} | {"p"}))
#: What every match of REWRITE begins with, so that most places are left after one look.
AHEAD = rf"(?=(?<![a-z])[{FIRST}]|[\s_-]{{1,3}}[\[({{<@adp]|[\[({{<&%])"
REWRITE = re.compile(
    rf"{AHEAD}(?:(?P<at>\s{{0,3}}[\[({{<]\s{{0,3}}(?:{AT_WORDS}|@)\s{{0,3}}[\])}}>]\s{{0,3}}|&#64;|&commat;|%40|(?<=[a-z0-9])\s{{1,3}}@\s{{1,3}}(?=[a-z0-9]))"
    rf"|(?P<dot>\s{{0,3}}[\[({{<]\s{{0,3}}(?:{DOT_WORDS}|\.)\s{{0,3}}[\])}}>]\s{{0,3}}|&#46;|&period;|(?<=[a-z0-9]){GAP}(?:{DOT_WORDS}){GAP}(?=[a-z0-9]))"
    rf"|(?P<bare>(?<=[a-z0-9]){GAP}(?:{AT_WORDS}){GAP}(?=[a-z0-9]))|(?P<plus>(?<![a-z0-9])plus\s{{1,3}}(?=[0-9]|{WORD}))"
    rf"|(?<![a-z])(?P<digit>{WORD})(?![a-z])(?:\s?,\s?(?=[0-9]|(?:{WORD})(?![a-z])))?)",
    re.IGNORECASE,
)
EMAIL_N = re.compile(rf"(?<![A-Za-z0-9._%+{DOT}-])[A-Za-z0-9_%+-]++(?:[.{DOT}][A-Za-z0-9_%+-]++)*+[@{AT}][A-Za-z0-9-]++(?:[.{DOT}][A-Za-z0-9-]++)++")
IP_N = re.compile(rf"(?<![0-9])[0-9]++(?:[.{DOT}][0-9]++){{3}}")
PHONE_N = re.compile(rf"\+[0-9][ ().0-9{DOT}-]+[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: from each @ back over the name and on over the domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def is_ip(found: str) -> bool:
    return all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in re.split(rf"[.{DOT}]", found))


def is_card(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_phone(found: str) -> bool:
    return 9 <= sum(c in "0123456789" for c in found) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    out += (("ip", *m.span()) for m in IP.finditer(text) if is_ip(m[0]))
    out += (("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() > 12 and is_card(m[0]))
    if "+" in text:
        out += (("phone", *m.span()) for m in PHONE.finditer(text) if is_phone(m[0]))
    return out


class _Ascii(dict):
    """Code point to its ASCII look-alike, to nothing, or to itself."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        plain = "" if c in GONE else LOOKALIKES.get(c) or unicodedata.normalize("NFKC", c)
        if c.isdigit() and len(plain) == 1:
            plain = str(unicodedata.digit(c))
        self[point] = plain = plain if not plain or len(plain) == 1 and (plain < "\x80") else c
        return plain


ASCII = _Ascii()


GONE_RUN = re.compile(f"[{''.join(sorted(GONE))}]")


class Normalised:
    """A text after the transducers, and the source span of each of its characters.

    Kept are only the places where something was dropped or rewritten, so a long plain text costs nothing more.
    """

    def __init__(self, text: str) -> None:
        chars = text if text.isascii() else text.translate(ASCII)
        # the character of `chars` before which the k-th dropped one stood
        self.dropped = [] if len(chars) == len(text) else [m.start() - k for k, m in enumerate(GONE_RUN.finditer(text))]
        out, done, size = [], 0, 0
        self.at, self.spans = [], []  # of what was rewritten: the place in the result, and the span in `chars`
        for m in REWRITE.finditer(chars):
            out.append(chars[done : m.start()])
            size += m.start() - done
            done = m.end()
            kind = m.lastgroup
            out.append({"at": "@", "dot": DOT, "bare": AT, "plus": "+"}.get(kind) or DIGITS[m["digit"].lower().replace("i\u0307", "i")])
            self.at.append(size)
            self.spans.append(m.span())
            size += 1
        out.append(chars[done:])
        self.text = "".join(out)

    def _span(self, i: int) -> tuple[int, int]:
        """Span in `chars` of the result's character i."""
        k = bisect_right(self.at, i) - 1
        if k >= 0 and self.at[k] == i:
            return self.spans[k]
        start = i if k < 0 else self.spans[k][1] + i - self.at[k] - 1
        return start, start + 1

    def source(self, a: int, b: int) -> tuple[int, int]:
        """Source span of the result's characters a to b."""
        first, last = self._span(a)[0], self._span(b - 1)[1] - 1
        return first + bisect_right(self.dropped, first), last + bisect_right(self.dropped, last) + 1


def _bare_at(found: str) -> bool:
    """Whether an address with a bare `at` is more than prose."""
    name, _, domain = found.partition(AT)
    return not domain or DOT in domain or any(c in "._0123456789" + DOT for c in name)


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    own = Normalised(text)
    plain = own.text
    if plain == text:
        return []
    found = [("email", m) for m in EMAIL_N.finditer(plain) if _bare_at(m[0])]
    found += (("ip", m) for m in IP_N.finditer(plain) if is_ip(m[0]))
    found += (("card", m) for m in CARD.finditer(plain) if m.end() - m.start() > 12 and is_card(m[0]))
    found += (("phone", m) for m in PHONE_N.finditer(plain) if is_phone(m[0]))
    out: list[tuple[str, int, int]] = []
    held = {k: [(x, y) for kind, x, y in base if kind == k] for k in KINDS}
    for kind, m in found:
        s, e = own.source(*m.span())
        if m[0] != text[s:e]:  # holds something rewritten
            # base spans of a kind are ordered and apart, so only the last that begins by s can hold this one
            k = bisect_right(held[kind], s, key=lambda x: x[0])
            if not k or held[kind][k - 1][1] < e:
                out.append((kind, s, e))
    return out


def spans_of(text: str) -> list[dict]:
    base = base_spans(text)
    more = added_spans(text, base)
    rows = [(KINDS.index(k), s, e, True) for k, s, e in base] + [(KINDS.index(k), s, e, False) for k, s, e in more]
    return [{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in sorted(rows)]


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id and all its spans (kind, start, end, base), ordered by kind and start."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            spans = [spans_of(t.as_py() or "") for t in texts]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SPAN_SCHEMA)


def op10_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
