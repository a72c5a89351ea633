"""Personal data: anchors that an Aho-Corasick automaton finds, widened and checked by parsers that look around them only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.store import pieces

#: Kinds in the order that spans of one start stand in; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = KINDS[:4]
#: Words that an identifier follows, as they stand in a text; letters A-Z count as a-z.
CUES = ("account", "acct", "iban", "passport", "ssn", "token", "password", "passwd", "pwd", "secret", "api key", "api_key", "apikey", "access key", "access_key", "login", "username", "user id", "user_id")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: User, host and port of an address, then the rest of it.
AUTHORITY = re.compile(r"(?:[^\s/?#@<>\"'\[\]]*@)?(?:\[([0-9A-Fa-f:.]{2,45})\]|([^\s/?#@:<>\"'\[\](),;]+))(?::([0-9]{1,5}))?(?=[/?#]|[^\w:@]|$)")
REST = re.compile(r"[/?#][^\s<>\"'`{}|\\^]*")
HOST = re.compile(r"(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_][\w-]*\.?|localhost", re.ASCII)
#: A separator and the identifier behind a cue; an IBAN needs no separator.
NAMED = re.compile(r"(?:[\x20_-]?(?:number|no\.?|id|code|key))?[\x20\t]{0,8}[:=#][\x20\t]{0,8}[\"']?([A-Za-z0-9][A-Za-z0-9._/+-]*[A-Za-z0-9])", re.IGNORECASE)
IBAN = re.compile(r"[\x20\t:=#]{1,8}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
LEAST_ACCOUNT, LEAST_ACCOUNT_DIGITS = 6, 3


@cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in [("@", "email"), ("+", "phone"), ("://", "address"), *((d, "number") for d in "0123456789"), *((c, "account") for c in CUES)]:
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def octet(number: str) -> bool:
    return len(number.lstrip("0")) <= 3 and int(number[-3:]) <= 255


def addresses_of(text: str, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Fours of the dotted numbers between at and end, from the left; those with a part over 255 give nothing."""
    numbers = text[at:end].split(".")
    for k in range(0, len(numbers) - 3, 4):
        size = sum(map(len, numbers[k : k + 4])) + 3
        if all(map(octet, numbers[k : k + 4])):
            yield at, at + size
        at += size + 1


def address(text: str, at: int, least: int) -> tuple[int, int] | None:
    """The web address whose :// starts at `at`, from its scheme, not before `least`, to the end of its path, without closing punctuation."""
    start = at
    while start > least and text[start - 1] in SCHEME:
        start -= 1
    while start < at and not text[start].isalpha():
        start += 1
    found = AUTHORITY.match(text, at + 3)
    if at - start < 2 or not found or int(found[3] or 0) > 65535:
        return None
    six, host = found[1], found[2]
    if six is None:
        numbers = DOTTED.fullmatch(host) and host.split(".")
        if not (len(numbers) == 4 and all(map(octet, numbers)) if numbers else HOST.fullmatch(host)):
            return None
    elif six.count(":") < 2:
        return None
    rest = REST.match(text, found.end())
    end = rest.end() if rest else found.end()
    while text[end - 1] in ".,;:!?)*&'":
        end -= 1
    return start, end


def account(text: str, at: int, end: int) -> tuple[int, int] | None:
    """The identifier that the cue between at and end names: six or more signs with digits among them, behind a separator, up to where letters and digits
    end; an IBAN by its check digits."""
    if at and (text[at - 1].isalnum() or text[at - 1] == "@"):
        return None
    found = IBAN.match(text, end)
    if found:
        code = found[1].replace(" ", "")
        if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return found.span(1)
    found = NAMED.match(text, end)
    if found and len(found[1]) >= LEAST_ACCOUNT and sum(map(str.isdigit, found[1])) >= LEAST_ACCOUNT_DIGITS and not text[found.end() : found.end() + 1].isalnum():
        return found.span(1)
    return None


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal data in a text, by start and kind; code points, ends exclusive. Time grows with the length alone: no parser goes back
    before the last anchor of its kind, and none looks again at what one before it has read."""
    found: list[tuple[int, int, str]] = []
    email = dotted = digits = web = named = 0
    for last, (kind, size) in automaton().iter(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
        at = last + 1 - size
        if kind == "number":
            if at >= dotted:
                dotted = DOTTED.match(text, at).end()
                if dotted - at >= 7:
                    found += [(s, e, "ip") for s, e in addresses_of(text, at, dotted)]
            if at >= digits:
                digits = DIGITS.match(text, at).end()
                if digits - at >= 14:
                    number = re.sub("[ -]", "", text[at:digits])
                    if 14 <= len(number) <= 19 and luhn(number):
                        found.append((at, digits, "card"))
        elif kind == "email":
            start = at
            while start > email and text[start - 1] in LOCAL:
                start -= 1
            domain = start < at and DOMAIN.match(text, at + 1)
            if domain:
                email = domain.end()
                found.append((start, email, "email"))
        elif kind == "phone":
            m = PHONE.match(text, at)
            if m and 10 <= sum(map(str.isdigit, m.group())) <= 15:
                found.append((*m.span(), "phone"))
        elif kind == "address" and at >= web:
            span = address(text, at, web)
            if span:
                web = span[1]
                found.append((*span, "address"))
        elif kind == "account" and at >= named:
            span = account(text, at, last + 1)
            if span:
                named = span[1]
                found.append((*span, "account"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        texts = [t or "" for t in b.column("text").to_pylist()]
        spans = [[{"kind": k, "start": s, "end": e, "text": t[s:e]} for s, e, k in spans_of(t)] for t in texts]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "text", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans: array<struct<kind, start, end, text>>) for each row of docs (doc_id, text), in code points, ends exclusive.

    Emails, network addresses, cards and phones are those that their patterns match from the left without overlap within a kind, less those that fail
    their check; a web address or an identifier behind a cue may overlap them. Null texts count as empty and have no spans; repeated rows
    stay; null ids and extra columns are fine (the latter aren't kept); an empty table gives no rows. Each row stands alone, so nothing is shuffled and
    a lost executor costs its tasks only."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_batches, f"doc_id {kind}, text string, spans array<struct<kind:string,start:int,end:int,text:string>>")


def masked(found: DataFrame) -> DataFrame:
    """(doc_id, text) from personal_data(), each span replaced by its kind in angle brackets; of spans that overlap, the one that starts first counts, and what later ones add to it goes too."""
    start = F.expr("named_struct('at', 0, 'out', '')")

    def step(s: Column, x: Column) -> Column:
        before = F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"])
        put = F.struct(x["end"].alias("at"), F.concat(s["out"], before, F.lit("<"), x["kind"], F.lit(">")).alias("out"))
        return F.when(x["start"] >= s["at"], put).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out")))

    text = F.aggregate("spans", start, step, lambda s: F.concat(s["out"], F.substring(F.coalesce("text", F.lit("")), s["at"] + 1, F.lit(2**31 - 1))))
    return found.select("doc_id", F.when(F.size("spans") > 0, text).otherwise(F.col("text")).alias("text"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summarised(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) from personal_data()."""
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(of(*BASE)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
