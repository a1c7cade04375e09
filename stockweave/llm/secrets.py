"""Secret scans by lexing assignments.

Base kinds are fixed patterns. Beyond them, the text around each ``=`` and ``:``
is read as an assignment of a source or configuration language: a name, and a
quoted or bare literal, a concatenation of quoted literals, the last literal of a call, a default, or the name of a
constant assigned anywhere in the text; pairs are also read from calls and attributes; a type between name and value is not the name. Constants are followed through
names, with all values they take, and a literal is scored by the sensitive words of the names it reaches and by its own form.

Spans are kind:start:end in code points, end exclusive. Base spans always stay;
a literal inside a base span is not reported again.

Cases: null text counts as empty; texts of any length are scanned whole; rows
that repeat stay; circular constants end the search; empty tables give empty results; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from stockweave.llm.batches import slices

# The base patterns and least lengths. Only ASCII letters stand for each other in either case.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so a shorter match is never part of a longer one
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
KINDS = ("assign", "access", "hex", "literal")

#: Weight of a word inside a target name.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "passcode": 3,
    "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3,
    "privatekey": 3, "accesskey": 3, "secretkey": 3, "authkey": 3, "bearer": 2, "signature": 1, "auth": 2, "pass": 2, "cred": 2, "key": 1,
    "api": 1, "private": 1, "access": 1, "client": 1, "encryption": 1, "signing": 1,
}
#: Literals that stand for a value instead of being one.
PLACEHOLDERS = re.compile(
    r"(?i)^(?:x+|\*+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|your.*|example.*|change_?me.*|todo|none|null|true|false|undefined|redacted|placeholder)$"
)
THRESHOLD = 5.0
LEAST_CHARS = 6

_OPERATOR = re.compile(r"=>|:=|[=:]")
_NAME = re.compile(r"(?<![\w.$-])[A-Za-z_$][\w.$-]*+")
_QUOTED = re.compile(
    r"""[^\S\r\n]*+(?:[rbuf]{1,2}(?=["']))?(?:"{3}((?:[^"\\]|\\[\s\S]|"(?!""))*+)"{3}|'{3}((?:[^'\\]|\\[\s\S]|'(?!''))*+)'{3}"""
    r"""|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`)"""
)
_PLUS = re.compile(r"[^\S\r\n]*+\+")
#: What may stand before the quoted literals of a value: a bracket, a call, or a value that they replace if it is missing.
_BRACKET = re.compile(r"""[^\S\r\n]*+\(\s*+(?=(?:[rbuf]{1,2})?["'])""")
_NEXT = re.compile(r"""\s*+(?:\+\s*+)?(?=(?:[rbuf]{1,2})?["'])""")
_CALL = re.compile(r"""[^\S\r\n]*+(?:new\s++|await\s++)?[A-Za-z_$][\w.$]*+\(\s*+(?=["'])""")
_ARGUMENT = re.compile(r"""\s*+,\s*+(?=["'])""")
_ELSE = re.compile(r"""[^\S\r\n]*+[\w.$]++(?:[(\[][^()\[\]\n]*+[)\]])?[^\S\r\n]++(?:or(?=\s)|\|\||\?\?)[^\S\r\n]*+(?=["'`])""")
#: Names and literals as the two first arguments of a call, or as two attributes of an element.
_PAIRS = re.compile(
    r"""[A-Za-z_$][\w.$]*+\(\s*+(["'])(\w[\w.$-]*+)\1\s*+,\s*+(["'])((?:(?!\3)[^\\\n])*+)\3"""
    r"""|\b(?:key|name|id)\s*+=\s*+(["'])(\w[\w.$-]*+)\5\s++value\s*+=\s*+(["'])((?:(?!\7)[^\n<>])*+)\7"""
)
_CONSTANT = re.compile(r"[^\S\r\n]*+\$?\{?([A-Za-z_][\w.]*)\}?(?=[\s;,)\]}]|\Z)")
_PART = r"""[^\s"'`,;()\[\]{}<>&=:]"""
#: A bare literal holds at most eight colons, and ``=`` only as its padding, so operators of one line share no long text.
_BARE = re.compile(rf"""[^\S\r\n]*+((?={_PART}|:){_PART}*+(?::++{_PART}*+){{0,8}}+(?:=++(?!{_PART}))?+)""")
#: A type between ``:`` and ``=``, without what stands in its brackets.
_TYPE = re.compile(r"\s*+(?:[&*]\s*+)*(?:'\w++\s++)?(?:mut\s++|const\s++|dyn\s++)?[A-Za-z_][\w.]*+[?!]*+\s*+(?:\|\s*+[A-Za-z_][\w.]*+\s*+)*")
#: Types that follow a name without ``:``, and words before a name that any type may follow.
_TYPES = frozenset("string str byte bytes rune char text varchar nvarchar any object error bool int int32 int64 uint float64".split())
_DECLARES = frozenset("var const let val dim declare".split())
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [
        (m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS
    ]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def name_score(name: str) -> float:
    """Sum of the weights of the words of a name; neighbours also count as one word (api_key, privateKey)."""
    parts = [w.lower() for w in _WORDS.findall(name.rpartition(".")[2] or name)]
    joined = [a + b for a, b in zip(parts, parts[1:])]
    return sum(SENSITIVE.get(w, 0) for w in parts) + sum(SENSITIVE.get(w, 0) for w in joined)


def literal_score(literal: str, quoted: bool) -> float:
    """From 0 for words of prose to 4 for long random strings; placeholders and short literals get -10."""
    if len(literal) < LEAST_CHARS or PLACEHOLDERS.match(literal) or " " in literal.strip():
        return -10.0
    counts = Counter(literal)
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    classes = sum(any(test(c) for c in counts) for test in (str.islower, str.isupper, str.isdigit)) + any(
        not c.isalnum() for c in counts
    )
    return (0.5 if quoted else 0.0) + min(1.5, entropy / 3) + (classes - 1) * 0.7


def _back(text: str, at: int, chars: str) -> int:
    """Where the run of ``chars`` that ends at ``at`` begins."""
    while at and text[at - 1] in chars:
        at -= 1
    return at


def _blank(text: str, at: int) -> int:
    """Where the white space of one line that ends at ``at`` begins."""
    while at and text[at - 1] not in "\r\n" and text[at - 1].isspace():
        at -= 1
    return at


def _target(text: str, at: int, names: dict[int, int]) -> tuple[int, int] | None:
    """The span of the name that ends before ``at``: bare, quoted, or in brackets."""
    at = _blank(text, at)
    if text[at - 1 : at] == "]":
        size = _back(text, at - 1, "0123456789")
        at = size - 1 if text[size - 1 : size] == "[" else at - 1  # pwd[32], config["pwd"]
    elif text[at - 1 : at] in ("?", "!"):
        at -= 1
    if at and text[at - 1] in "\"'":
        start = text.rfind(text[at - 1], 0, at - 1)
        if 0 <= start < at - 2 and "\n" not in text[start:at]:
            return start + 1, at - 1
        at -= 1
    return (names[at], at) if at in names else None


def _is_type(between: str) -> bool:
    """Whether the text between ``:`` and ``=`` is a type."""
    depth, outer = 0, []
    for c in between:
        depth += (c in "<[(") - (c in ">])")
        if not depth and c not in ">])":
            outer.append(c)
    return not depth and _TYPE.fullmatch("".join(outer)) is not None


def _declared(text: str, span: tuple[int, int], names: dict[int, int]) -> tuple[int, int]:
    """The name before the type in ``span`` (var pwd string, Dim pwd As String), or else ``span``."""
    at = _back(text, span[0], "[]*&")
    found = []
    while len(found) < 3 and (end := _blank(text, at)) < at and end in names:
        at = names[end]
        found.append((at, end))
    words = [text[a:b].lower() for a, b in found] + [""] * 3
    skip = words[0] == "as"
    if found[skip:] and words[skip] not in _DECLARES:
        if skip or text[span[0] : span[1]] in _TYPES or words[1] in _DECLARES:
            return found[skip]
    return span


def _literals(text: str, at: int) -> list[tuple[int, int]]:
    """The spans of the quoted literals that make the value at ``at``; of a call's arguments, the last counts."""
    bracket = _BRACKET.match(text, at)
    call = None if bracket else _CALL.match(text, at)
    start = bracket or call or _ELSE.match(text, at)
    more = _NEXT if bracket else _ARGUMENT if call else _PLUS
    spans, at = [], start.end() if start else at
    while piece := _QUOTED.match(text, at):
        span = piece.span(piece.lastindex)
        spans = [span] if call else [*spans, span]
        following = more.match(text, piece.end())
        if not following:
            break
        at = following.end()
    return spans


def assignments(text: str) -> list[tuple[str, list[tuple[int, int]], str, bool, str | None]]:
    """(name, spans, literal, quoted, constant) in text order; ``constant`` is the name that a value refers to."""
    found = []
    names = {m.end(): m.start() for m in _NAME.finditer(text)}
    typed = None  # the last ``:``: where it ends, its target, and how many assignments were found before it
    for op in _OPERATOR.finditer(text):
        before, typed = typed, None
        if text[op.end() : op.end() + 1] == "=" or text[op.start() - 1 : op.start()] in ("=", "!", "<", ">", ":"):
            continue  # a comparison, or the middle of a longer operator
        span = _target(text, op.start(), names)
        targets = [span] if span else []
        if op[0] == "=":
            between = text[before[0] : op.start()] if before else "\n"
            if "\n" not in between and _is_type(between):
                del found[before[2] :]
                # The word may also be a name of its own, as in "key: token = ...".
                targets = [before[1]] + [x for x in targets if name_score(text[x[0] : x[1]]) >= 2]
            elif span and span[1] == _blank(text, op.start()):
                targets = [_declared(text, span, names)]
        if not targets:
            continue
        if op[0] == ":":
            typed = op.end(), span, len(found)
        spans = _literals(text, op.end())
        if spans:
            value = spans, "".join(text[a:b] for a, b in spans), True, None
        elif bare := _BARE.match(text, op.end()):
            constant = _CONSTANT.match(text, op.end())
            value = [bare.span(1)], bare[1], False, constant[1] if constant else None
        else:
            continue
        found += [(text[a:b], *value) for a, b in targets]
    for pair in _PAIRS.finditer(text):
        name, literal = (2, 4) if pair[2] is not None else (6, 8)
        found.append((pair[name], [pair.span(literal)], pair[literal], True, None))
    return found


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the literals that reach a sensitive name, directly or through constants."""
    found = assignments(text)
    assigned = {name for name, *_ in found}
    leads: dict[str, list[str]] = {}  # the constants that a name takes its values from
    for name, _, _, _, constant in found:
        if constant in assigned:
            leads.setdefault(name, []).append(constant)
    own = {name: name_score(name) for name in assigned}
    reached: dict[str, float] = {}  # the highest weight of a sensitive name that a name leads to
    for start in sorted((n for n in assigned if own[n] >= 2), key=own.get, reverse=True):
        todo = [start]
        while todo:
            name = todo.pop()
            if name not in reached:
                reached[name] = own[start]
                todo += leads.get(name, ())
    out = set()
    for name, spans, literal, quoted, constant in found:
        if name in reached and constant not in assigned and reached[name] + literal_score(literal, quoted) >= THRESHOLD:
            out.update(spans)
    return [(a, b, "literal") for a, b in sorted(out)]


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), by start and then by kind."""

    def order(span: tuple[int, int, str]) -> tuple[int, int]:
        return span[0], KINDS.index(span[2])

    base = sorted(base_spans(text), key=order)
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
    more = []
    for span in literal_spans(text):
        before = bisect_right(starts, span[0])
        if not before or reach[before - 1] < span[1]:
            more.append(span)
    return base, sorted(base + more, key=order)


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): base spans and all spans of each document, written as kind:start:end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                found = [all_spans(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([written(b) for b, _ in found], pa.string()),
                        pa.array([written(s) for _, s in found], pa.string()),
                    ],
                    names=["doc_id", "base", "spans"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base string, spans string")
