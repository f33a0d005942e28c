"""Prompt-injection guard: signals, redaction and clean-up of crawled text as SQL expressions.

Patterns are put together from word lists. Text is tested as it is in lower case and in its normal form; only text
with characters that have another NFKC form needs the one Arrow function here.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .arrow import map_text
from .urls import SPACE, let

TOKEN = "[REDACTED_PROMPT_INJECTION]"
#: Word borders over ASCII word characters, as the patterns mean them.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def _any(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


_WS = SPACE
_SECRET = "(?:" + "|".join([rf"api{_WS}*key", *"cookie credential password secret session token".split()]) + ")"
_NEAR = "[^\\n\\r\\x{2028}\\x{2029}]{0,40}"
_RUN = "[A-Za-z0-9+/]"
_OVERRIDE = _any("disregard forget ignore override") + f"{_WS}+(?:all{_WS}+)?(?:{_any('my the these those your')}|any{_WS}+)?{_WS}*" + _any("above developer earlier initial original previous prior system") + f"?{_WS}*" + _any("directives? instructions? prompts? rules?")
_EXFIL = _any("display dump expose leak reveal show") + f"{_WS}+(?:the{_WS}+)?" + _any("developer hidden internal system") + f"{_WS}+" + _any("instructions? message prompt")
_ROLE = "(?=[ads])(?<!" + EDGE + _any("an? her his its my new our that the their this your") + f"{_WS})(?:^|{EDGE})" + _any("assistant developer system") + f"{_WS}*:{_WS}*"
_SENT = f"(?:https?://|{EDGE}to{_WS}+(?:[a-z0-9._%+-]+@)?(?:[a-z0-9-]+[.])+[a-z]{{2,}})"
_TOOL = f"(?:exfiltrat[A-Za-z0-9_]*{_NEAR}{_SECRET}|{_any('email mail post send transmit upload')}{_NEAR}{_SECRET}{_NEAR}{_SENT})"
_FILES = "(?:[.]env" + EDGE + "|id_ed25519|id_rsa|" + EDGE + "passwd" + EDGE + "|[.]pem" + EDGE + "|[~/][^\\s]{0,40}(?:credential|secret))"
_LOCAL = _any("cat curl open read wget") + f"{_WS}+{_NEAR}{_FILES}"
_ENCODED = f"(?<!{_RUN})(?:(?={_RUN}*[A-Za-z])(?={_RUN}*[0-9]){_RUN}{{80,}}={{0,2}}|{_RUN}{{80,}}={{1,2}})"


@dataclass(frozen=True)
class Pattern:
    """``needs``: lists of words; a lower-case text that matches ``source`` holds a word of every list.

    ``first``: what is ahead wherever a match in lower-case text begins, for a quick no at other places.
    """

    id: str
    severity: str
    label: str
    source: str
    needs: tuple[str, ...]
    first: str


_SECRETS = "api cookie credential password secret session token"
PATTERNS = (
    Pattern("direct-override", "high", "Direct instruction override", _OVERRIDE, ("disregard forget ignore override", "directive instruction prompt rule"), "[dfio]"),
    Pattern("system-prompt-exfil", "high", "System prompt exfiltration", _EXFIL, ("display dump expose leak reveal show", "developer hidden internal system", "instruction message prompt"), "[delrs]"),
    Pattern("role-spoofing", "medium", "Role spoofing payload", _ROLE, (":", "assistant developer system"), f"(?:assistant|developer|system){_WS}*:"),
    Pattern("tool-exfiltration", "high", "Credential/tool exfiltration", _TOOL, (_SECRETS, "exfiltrat mail post send transmit upload"), "[empstu]"),
    Pattern("local-secret-access", "high", "Local secret access request", _LOCAL, (".env id_ed25519 id_rsa passwd .pem credential secret", "cat curl open read wget"), "[corw]"),
    Pattern("encoded-payload", "medium", "Long encoded payload block", _ENCODED, (), "[a-z0-9+/]{80}"),
)
_LONG_RUN = "[a-z0-9+/]{80}"
URL_RE = f"(?i){EDGE}(?:https?://|data:)[^\\s\"'<>)\\]]+"


@F.arrow_udf(StringType())
def _nfkc(column: pa.Array) -> pa.Array:
    return map_text(lambda x: unicodedata.normalize("NFKC", x), column)


def _stable() -> str:
    """Ranges of a character class: what NFKC leaves as it is, whatever stands beside it."""
    blocks = ((0, 0x24F), (0x370, 0x52F), (0x5D0, 0x5EA), (0x621, 0x64A), (0x2010, 0x205E), (0x20A0, 0x20BF), (0x2190, 0x21FF), (0x2500, 0x25FF), (0x3001, 0x303F), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
    runs: list[list[int]] = []
    for lo, hi in blocks:
        for c in range(lo, hi + 1):
            if unicodedata.combining(chr(c)) or unicodedata.normalize("NFKC", chr(c)) != chr(c):
                continue
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)


STABLE = _stable()


def _odd(text: Column) -> Column:
    return (F.length(text) != F.octet_length(text)) & text.rlike(f"[\\x{{80}}-\\x{{10FFFF}}&&[^{STABLE}]]")


def nfkc(text: Column) -> Column:
    """Compatibility form; text of characters that have no other isn't sent to Python."""
    odd = _odd(text)
    return F.when(~odd, text).otherwise(_nfkc(F.when(odd, text)))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    return trim(F.regexp_replace(text, f"{SPACE}{{2,}}|(?! ){SPACE}", " "))  # a single blank stays as it is


def _squeezed(form: Column) -> Column:
    return collapse(F.regexp_replace(F.regexp_replace(form, CONTROL, " "), r"[|\\/._-]{2,}", " "))


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL_RE, " ")


def _match(low: Column, p: Pattern) -> Column:
    """The first match in lower-case text; null if there is none. (``nullif`` would look for it twice.)"""
    return let(F.regexp_extract(low, f"(?={p.first})({p.source.replace('A-Za-z', 'a-z')})", 1), lambda m: F.when(m != "", m))


def _gate(low: Column, p: Pattern) -> Column:
    """A cheap test that lower-case text passes wherever the pattern matches it."""
    if not p.needs:
        return low.rlike(_LONG_RUN)
    return reduce(and_, (reduce(or_, (F.contains(low, F.lit(w)) for w in words.split())) for words in p.needs))


_SIGNALS = "array<struct<id:string,severity:string,label:string,match:string>>"


def signals(text: Column) -> Column:
    """``array<struct<id, severity, label, match>>``, one of each pattern at most, in their order.

    A match is taken from the text itself in lower case, else from its normal form, and cut to 140 characters.
    A null text has no signal. A pattern is only tried on a form that has the words it can't do without. Unless
    characters have another compatibility form, the words of the normal form are in the text too, so the normal
    form of text without such words is never made; nor is that of text in which all patterns with their words match.
    """
    odd = _odd(text)
    known = F.struct(text.alias("text"), F.lower(text).alias("low"), _nfkc(F.when(odd, text)).alias("nf"), _nfkc(F.when(odd, strip_urls(text))).alias("nf_free"))

    def gated(f: Column) -> Column:
        gates = F.struct(*(_gate(f["low"], p).alias(p.id) for p in PATTERNS))
        return let(gates, lambda g: F.when(f["nf"].isNotNull() | reduce(or_, (g[p.id] for p in PATTERNS)), found(f, g)).otherwise(F.array().cast(_SIGNALS)))

    def found(f: Column, g: Column) -> Column:
        odd = f["nf"].isNotNull()
        free = F.when(odd | g["encoded-payload"], F.struct(F.lower(strip_urls(f["text"])).alias("own"), F.lower(_squeezed(F.coalesce(f["nf_free"], strip_urls(f["text"])))).alias("normal")))
        own = lambda x: F.struct(*(F.when(g[p.id], _match(f["low"] if p.needs else x["own"], p)).alias(p.id) for p in PATTERNS))

        def hits(x: Column, m: Column) -> Column:
            missed = odd | reduce(or_, (g[p.id] & m[p.id].isNull() for p in PATTERNS if p.needs))
            return let(F.when(missed, F.lower(_squeezed(F.coalesce(f["nf"], f["text"])))), lambda n: listed(x, m, n))

        def listed(x: Column, m: Column, n: Column) -> Column:
            def hit(p: Pattern) -> Column:
                normal = n if p.needs else x["normal"]
                return F.coalesce(m[p.id], F.when(g[p.id] | (odd & _gate(normal, p)), _match(normal, p)))

            made = F.array(*(F.struct(F.lit(p.id).alias("id"), F.lit(p.severity).alias("severity"), F.lit(p.label).alias("label"), hit(p).alias("match")) for p in PATTERNS))
            return F.filter(made, lambda x: x["match"].isNotNull())

        return let(free, lambda x: let(own(x), lambda m: hits(x, m)))

    short = lambda m: F.when(F.length(m) > 140, F.concat(F.substring(m, 1, 140), F.lit("..."))).otherwise(m)
    return F.transform(let(known, gated), lambda x: F.struct(x["id"].alias("id"), x["severity"].alias("severity"), x["label"].alias("label"), short(x["match"]).alias("match")))


def sanitized(text: Column, most: int = 20_000) -> Column:
    """``struct(signals, original_length, sanitized_length, truncated, redaction_count, text)``.

    Only patterns that were raised are redacted, one after the other, each over what the last one left.
    """
    start = F.struct(F.replace(F.regexp_replace(text, CONTROL, " "), F.lit("\r"), F.lit("\n")).alias("t"), F.lit(0).alias("n"))

    def redact(acc: Column, p: Pattern, found: Column) -> Column:
        source = f"(?i){p.source}"
        raised = F.array_contains(found["id"], p.id)
        return let(acc, lambda a: F.when(raised, F.struct(F.regexp_replace(a["t"], source, TOKEN).alias("t"), (a["n"] + F.regexp_count(a["t"], F.lit(source))).alias("n"))).otherwise(a))

    def finish(found: Column) -> Column:
        done = F.when(F.size(found) > 0, reduce(lambda acc, p: redact(acc, p, found), PATTERNS, start)).otherwise(start)
        tidy = lambda d: F.struct(trim(F.regexp_replace(F.regexp_replace(d["t"], "[ \t]+\n", "\n"), "\n{3,}", "\n\n")).alias("t"), d["n"].alias("n"))
        return let(let(done, tidy), lambda d: F.struct(found.alias("signals"), F.length(text).alias("original_length"), d["n"].alias("redaction_count"), (F.length(d["t"]) > most).alias("truncated"), F.when(F.length(d["t"]) > most, F.concat(F.substring(d["t"], 1, most), F.lit("\n[TRUNCATED]"))).otherwise(d["t"]).alias("text")))

    return let(let(signals(text), finish), lambda g: F.struct(g["signals"].alias("signals"), g["original_length"].alias("original_length"), F.length(g["text"]).alias("sanitized_length"), g["truncated"].alias("truncated"), g["redaction_count"].alias("redaction_count"), g["text"].alias("text")))
