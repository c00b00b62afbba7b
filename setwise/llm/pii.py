"""Personal data: Aho-Corasick finds anchors, local parsers expand and check what stands around them.

One automaton holds at-signs, plus signs, digits, schemes and identifier cues;
it walks a whole text once. At an anchor a deterministic parser grows the
match to its boundaries by character class, without backtracking, and keeps
where the last match of its kind ended, so matches of a kind never overlap.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Sequence

import ahocorasick
from pyspark.sql import DataFrame

from setwise.llm.texts import add_from_text

Span = tuple[int, int]

DIGITS = set(string.digits)
LOCAL = set(string.ascii_letters + string.digits + "._%+-")
LABEL = set(string.ascii_letters + string.digits + "-")
PHONE = set(string.digits + " ().-")
WORD = set(string.ascii_letters + string.digits + "_-")
VALUE = set(string.ascii_letters + string.digits + "_-./+=")
URL = set(string.ascii_letters + string.digits + "-._~:/?#[]@!$&'()*+,;=%")

# Kinds in the order in which they are listed, and the added ones.
BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "account")
# Schemes that begin an address, and cues that name an account or a credential.
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("account", "api_key", "apikey", "iban", "password", "passwd", "secret", "ssn", "token", "user_id", "username")


def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("email", "@"), ("phone", "+"), ("digit", string.digits), ("url", SCHEMES)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            found.add_word(form, ("account", len(form)))
    found.make_automaton()
    return found


def run_end(text: str, at: int, allowed: set[str]) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def email_at(text: str, sign: int, free: int) -> Span | None:
    """An address around an at-sign: local part, host, and one more label at least; ``free``: where the last one ended."""
    start = sign
    while start > free and text[start - 1] in LOCAL:
        start -= 1
    end = run_end(text, sign + 1, LABEL)
    if start == sign or end == sign + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == "." and (after := run_end(text, end + 1, LABEL)) > end + 1:
        end, labels = after, labels + 1
    return (start, end) if labels else None


def ips_at(text: str, start: int) -> tuple[list[Span], int]:
    """Addresses in the chain of dotted numbers that begins here, four numbers each; and where the chain ends."""
    parts: list[Span] = []
    at = start
    while True:
        end = run_end(text, at, DIGITS)
        parts.append((at, end))
        if end + 1 < len(text) and text[end] == "." and text[end + 1] in DIGITS:
            at = end + 1
        else:
            break
    fits = lambda a, b: len(x := text[a:b].lstrip("0")) <= 3 and int(x or 0) <= 255
    fours = [parts[i : i + 4] for i in range(0, len(parts) - 3, 4)]
    return [(four[0][0], four[3][1]) for four in fours if all(fits(*p) for p in four)], end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def card_at(text: str, start: int) -> tuple[Span | None, int]:
    """A card number in the chain of digits (single blanks or hyphens between them); and where the chain ends."""
    at, digits, n = start + 1, [text[start]], len(text)
    while at < n:
        if text[at] in DIGITS:
            digits.append(text[at])
            at += 1
        elif text[at] in " -" and at + 1 < n and text[at + 1] in DIGITS:
            digits.append(text[at + 1])
            at += 2
        else:
            break
    return ((start, at) if 16 <= len(digits) <= 19 and luhn("".join(digits)) else None), at


def phone_at(text: str, plus: int) -> tuple[Span | None, int]:
    """A number after a plus sign; and where the characters that were looked at end."""
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None, plus + 1
    end = run_end(text, plus + 2, PHONE)
    while text[end - 1] not in DIGITS:
        end -= 1
    if end < plus + 4:
        return None, plus + 1
    count = sum(c in DIGITS for c in text[plus:end])
    return ((plus, end) if 8 <= count <= 15 else None), end


def url_at(text: str, scheme: int, host: int) -> Span | None:
    """An address after a scheme: a host with a label, then anything but closing punctuation."""
    if host >= len(text) or text[host] not in LABEL:
        return None
    end = run_end(text, host, URL)
    while text[end - 1] in ".,;:!?'()[]":
        end -= 1
    return scheme, end


def account_at(text: str, cue: int, after: int) -> Span | None:
    """The value that a cue names: ``cue = "value"``, ``cue: value`` or ``cue#value``, six characters with a digit at least."""
    if cue and text[cue - 1] in WORD:
        return None
    at = run_end(text, after, {'"', "'"})
    at = run_end(text, at, {" ", "\t"})
    if at >= len(text) or text[at] not in ":=#":
        return None
    at = run_end(text, at + 1, {" ", "\t"})
    at = run_end(text, at, {'"', "'"})
    end = run_end(text, at, VALUE)
    while end > at and text[end - 1] in ".=-/+":
        end -= 1
    return (at, end) if end - at >= 6 and any(c in DIGITS for c in text[at:end]) else None


def find_spans(text: str | None, anchors: ahocorasick.Automaton) -> dict[str, list[Span]]:
    """Spans of every kind in code points, end exclusive, by start."""
    found: dict[str, list[Span]] = {k: [] for k in (*BASE, *ADDED)}
    free = dict.fromkeys((*BASE, *ADDED), 0)

    def take(kind: str, span: Span | None) -> None:
        if span:
            found[kind].append(span)
            free[kind] = span[1]

    for last, (kind, size) in anchors.iter(text) if text else ():
        at = last - size + 1
        if kind == "digit":
            if at >= free["ip"]:
                spans, free["ip"] = ips_at(text, at)
                found["ip"] += spans
            if at >= free["card"]:
                span, free["card"] = card_at(text, at)
                if span:
                    found["card"].append(span)
        elif kind == "email":
            take(kind, email_at(text, at, free["email"]))
        elif kind == "phone":
            if at >= free["phone"]:
                span, free["phone"] = phone_at(text, at)
                if span:
                    found["phone"].append(span)
        elif at >= free[kind]:
            take(kind, url_at(text, at, last + 1) if kind == "url" else account_at(text, at, last + 1))
    return found


def listed(found: dict[str, list[Span]], kinds: Sequence[str]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def redact(text: str | None, found: dict[str, list[Span]]) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans the union, named by the first."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, spans in found.items() for a, b in spans):
        if start >= at:
            out += (text[at:start], f"[{kind.upper()}]")
        at = max(at, end)
    return "".join(out) + text[at:]


def find_personal(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", redacted: str | None = None,
) -> DataFrame:
    """``keep`` columns with n_email, n_ip, n_card, n_phone, base_sha256 and spans (kind:start:end) of every whole text.

    With ``redacted`` a column of that name holds the text with its spans
    replaced (NULL stays NULL). NULL and empty texts have no spans. Very long
    texts are read whole, rows that repeat get the same result each, spans of
    one place are listed by kind, and an empty table stays empty. Columns of
    ``keep`` must not have the new names.
    """
    fields = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    fields += f", `{redacted}` string" if redacted else ""

    def work():
        anchors = _anchors()

        def run(texts):
            found = [find_spans(t, anchors) for t in texts]
            out = [[len(f[k]) for f in found] for k in BASE]
            out.append([hashlib.sha256(listed(f, BASE).encode()).hexdigest() for f in found])
            out.append([listed(f, (*BASE, *ADDED)) for f in found])
            return [*out, [redact(t, f) for t, f in zip(texts, found, strict=True)]] if redacted else out

        return run

    return add_from_text(docs, work, fields, keep, text)
