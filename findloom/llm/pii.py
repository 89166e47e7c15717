"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, schemes, digits and cue words; local parsers expand and validate from there."""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findloom.llm.common import fresh, table, without

#: Kinds in the order of the output; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "login", "account", "secret")
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/?#@:]+(?::[^\s/?#@]*)?@[A-Za-z0-9.-]+")
MARK = re.compile(r"[\"']?[\x20\t]*[:=][\x20\t]*[\"']?")
VALUE = re.compile(r"[A-Za-z0-9_./+=-]{8,}")
ACCOUNT = re.compile(r"(?:[\x20]?(?i:no|nr|num|number)\b\.?)?[\x20\t]*(?:[:#=][\x20\t]*)?(?P<value>[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{6,18})(?![A-Za-z0-9])")
SECRET_CUES = ("password", "passwd", "passphrase", "pwd", "token", "secret", "api_key", "api-key", "apikey", "access_key", "access-key", "private_key", "private-key", "bearer")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {c: n for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in codes.split()}
ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "social security", "passport", "routing", "tax id", "konto", "kontonummer", "steuernummer", "compte", "cuenta")


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for x in ["@", "://", "+", *"0123456789"]:
        a.add_word(x, ("digit" if x.isdigit() else x, len(x)))
    for kind, cues in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES)):
        for cue in cues:
            a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban(value: str) -> bool:
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def account_end(value: str) -> int:
    """Where the account number at the start of a matched value ends; 0 if an IBAN is invalid. An IBAN is as long as its country's, so words
    in capitals after it are left out; in countries not listed it ends at any space."""
    if not value[:2].isalpha():
        return len(value)
    ends, n = [len(value)], IBAN_LENGTHS.get(value[:2])
    if n:
        at = [i for i, c in enumerate(value) if c != " "]
        if n <= len(at) and (n == len(at) or value[at[n - 1] + 1] == " "):
            ends.insert(0, at[n - 1] + 1)
    else:
        ends += [i for i in range(len(value) - 1, 14, -1) if value[i] == " "]
    return next((e for e in ends if iban(value[:e])), 0)


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind as listed and then start; code points, end exclusive."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys((*KINDS, "chain"), 0)  # where the last match of a kind ended, dropped ones too
    dull = (0, 0)  # the last run of a secret's characters that has no digit
    small = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z alone, so places stay
    for last, (what, n) in _automaton().iter(small):
        at = last - n + 1
        if what == "digit":
            if at >= done["chain"]:
                m = CHAIN.match(text, at)
                done["chain"] = m.end()
                parts = m[0].split(".") if m.end() - at >= 7 else ()
                start = at
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    width = sum(len(p) + 1 for p in four)
                    if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in four):
                        found["ip"].append((start, start + width - 1))
                    start += width
            if at >= done["card"]:
                m = CARD.match(text, at)
                done["card"] = m.end() if m else at + 1
                if m and m.end() - at >= 16:
                    digits = re.sub("[^0-9]", "", m[0])
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
        elif what == "@":
            if m := HOST.match(text, at + 1):
                start = at
                while start > done["email"] and text[start - 1] in LOCAL:
                    start -= 1
                if start < at:
                    found["email"].append((start, m.end()))
                    done["email"] = m.end()
        elif what == "+":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif what == "://":
            start = at
            while start > done["login"] and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+-."):
                start -= 1
            if start < at and (m := LOGIN.match(text, last + 1)):
                found["login"].append((start, m.end()))
                done["login"] = m.end()
        elif at >= done[what] and not (at and text[at - 1].isalnum()):
            if what == "secret":
                m = MARK.match(text, last + 1)
                # a run without digits has no secret, wherever in it one would begin
                m = None if m is None or dull[0] <= m.end() < dull[1] else VALUE.match(text, m.end())
                span = m and m.span()
                if m and not any(c.isdigit() for c in m[0]):
                    dull, span = span, None
            else:
                m = ACCOUNT.match(text, last + 1)
                n = m and any(c.isdigit() for c in m["value"]) and account_end(m["value"])
                span = n and (m.start("value"), m.start("value") + n)
            if span:
                found[what].append(span)
                done[what] = span[1]
    return [(k, *s) for k in KINDS for s in found[k]]


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span, or each union of overlapping ones, replaced by the first one's kind in brackets."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, end, kind in sorted((s, -e, k) for k, s, e in spans):
        end = -end
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _spans(text: pa.Array) -> pa.Array:
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(x)] for x in text.to_pylist()], _ARROW)


def _masked(text: pa.Array) -> pa.Array:
    return pa.array([masked(x, spans_of(x)) for x in text.to_pylist()], pa.string())


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `spans`, an array of (kind, start, end).

    Email, ip, card and phone are what their patterns match from the left without overlap within a kind, matches that fail validation being
    dropped; login (scheme://user@host), account (a number, SSN or valid IBAN after a cue) and secret (a value after a cue) are added.
    Null and empty texts have no spans. Each row is judged alone, in linear time, so long texts, ties and repeated rows need nothing
    special; an empty table gives an empty result; an input column named spans is replaced, after its use if it's the text.
    """
    own = fresh(docs, "text")
    return without(docs.withColumn(own, F.col(f"`{text}`").cast("string")), "spans").withColumn("spans", F.arrow_udf(_spans, SPAN)(own)).drop(own)


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets. Null texts stay null and empty ones empty; repeated rows are masked alike; an empty table gives an
    empty result; all columns keep their names, whatever these are."""
    return docs.withColumn(text, F.arrow_udf(_masked, T.StringType())(F.col(f"`{text}`")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:4]))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *map(of, KINDS[:4]), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
