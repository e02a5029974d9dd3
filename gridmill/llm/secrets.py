"""Secret scans: fixed patterns plus an assignment-aware lexer.

The base patterns (kinds ``assign``, ``access``, ``hex``) are matched leftmost and
without overlap over the whole text; matches that are too short are dropped
after matching.  The lexer then reads source and configuration syntax as
name-literal pairs (``name = "x"``, ``name: x``, ``"name" => 'x'``, ``NAME := x``,
``a["name"] = "x"``, ``name: type = "x"``, ``name = f("x")``, joined, escaped and
many-line literals), follows names that stand for a literal assigned anywhere in the
text, and gives names that say nothing (``value``, ``default`` ...) the name of the
section, key or object around them.  It scores each literal by how sensitive the name
it ends up under is and by how random the literal looks.  Literals that reach the
threshold are spans of kind ``lexed``.

Null text counts as empty and gives no spans; rows are independent, so repeated
rows give repeated results and an empty table gives an empty one.  Long texts are read
whole; names and literals may be of any length.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.workers import tidy

#: The base patterns and the least length of what counts (group 2 of the first, all of the others).
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the same maximal runs as [0-9a-f]+ of 32 characters or more
KINDS = ("assign", "access", "hex", "lexed")

_KEYWORD = re.compile(r"(?ai:password|passwd|secret|token|api_?key)")
_PAIR = re.compile(
    r"""(?P<quote>["']|(?<![A-Za-z0-9_.\-]))(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)(?P=quote)\x20*(?P<op>:=|=>|=(?!=)|:(?![:/]))\x20*"""
    r"""(?:"(?P<dq>[^"\n]*)"|'(?P<sq>[^'\n]*)'|(?P<bare>[^\s"',;)}\]]+))"""
)
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: How sensitive a name's part is; a pair is two parts in a row.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 2, "credentials": 2, "auth": 2, "pin": 1}
SENSITIVE_PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("signing", "key"), ("encryption", "key"), ("client", "secret")}
PLACEHOLDER = re.compile(r"(?i)example|changeme|placeholder|your[_-]|xxxx|\*\*\*|<[^>]*>|\$\{|\bnone\b|\bnull\b|\btrue\b|\bfalse\b")
THRESHOLD = 4.0
#: Names that take the name around them, and calls whose argument names a value instead of being it.
GENERIC = frozenset("value val default data content text literal string raw plain plaintext".split())
LOOKUPS = frozenset("get getenv env environ input getpass prompt read load open require include fetch lookup find query header param format join replace".split())
_STEM = re.compile(r"(?ai:pass|pwd|secret|token|key|cred|auth|pin)")
_TOKEN = re.compile(
    r"""(?:\b[rRbBuUfF]{1,2})?(?:(?P<q>\"{3}|'{3})(?P<long>(?:[^\\]|\\.)*?)(?P=q)|"(?P<dq>(?:[^"\\\n]|\\.)*)"|'(?P<sq>(?:[^'\\\n]|\\.)*)'|`(?P<bq>[^`\n]*)`)"""
    r"""|(?P<name>[A-Za-z_$][A-Za-z0-9_]*(?:[.\-][A-Za-z_][A-Za-z0-9_]*)*)|(?P<op>:=|=>|[=!<>]=|\.\.|[^\s])|(?P<nl>\n)""",
    re.S,
)
_LINE = re.compile(r"""(?m)^(?P<indent>[ \t]*+)(?:\[(?P<section>[^\]\n]+)\][ \t]*$|(?P<parent>[A-Za-z_][\w.\-]*+)[ \t]*:[ \t]*$|(?=\S))""")
#: Words of messages and labels, which are no passphrases.
_PROSE = re.compile(r"(?i)\b(?:enter|your|please|password|passwd|token|secret|invalid|required|must|cannot)\b|[.!?:]\s*\Z")
_STRINGS = ("long", "dq", "sq", "bq")


def name_weight(name: str) -> int:
    parts = [p.lower() for p in _PARTS.findall(name)]
    most = max((SENSITIVE.get(p, 0) for p in parts), default=0)
    return max(most, 3 if any(p in SENSITIVE_PAIRS for p in zip(parts, parts[1:], strict=False)) else 0)


def literal_score(value: str) -> float:
    """0 to 3: length, character classes and entropy; placeholders score 0."""
    if len(value) < 8 or PLACEHOLDER.search(value) or (any(c.isspace() for c in value) and _PROSE.search(value)):
        return 0.0
    n = len(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    classes = any(c.isdigit() for c in value) + any(c.islower() for c in value) + any(c.isupper() for c in value) + any(not c.isalnum() for c in value)
    return min(1.0, n / 16) + min(1.0, entropy / 4) + (classes >= 2) * 1.0


class _Tokens:
    """Name-literal pairs of source text, read from its tokens."""

    def __init__(self, text: str) -> None:
        self.tokens = [(m.lastgroup, m[m.lastgroup], m.span(m.lastgroup)) for m in _TOKEN.finditer(text)]
        self.constants: dict[str, tuple[str, tuple[int, int]]] = {}

    def at(self, i: int) -> tuple[str, str, tuple[int, int]]:
        return self.tokens[i] if i < len(self.tokens) else ("end", "", (0, 0))

    def skip_lines(self, i: int) -> int:
        while self.at(i)[0] == "nl":
            i += 1
        return i

    def target(self, i: int) -> tuple[list[str], int]:
        """The names of an assignment's left side at ``i``: a name or quoted key and its subscripts."""
        names, i = [self.at(i)[1]], i + 1
        while self.at(i)[1] == "[" and self.at(i)[0] == "op":
            if self.at(i + 1)[1] == "]":
                i += 2
            elif self.at(i + 2)[1] == "]":
                if self.at(i + 1)[0] in (*_STRINGS, "name"):
                    names.append(self.at(i + 1)[1])
                i += 3
            else:
                break
        return names, i

    def assigned(self, i: int) -> int:
        """The place after the operator at ``i`` and a type, or -1."""
        if self.at(i)[1] in ("?", "!") and self.at(i + 1)[1] == ":":
            i += 1
        kind, sign, _ = self.at(i)
        if kind != "op" or sign not in ("=", ":=", "=>", ":"):
            return -1
        if sign != ":":
            return i + 1
        for k in range(i + 1, i + 24):  # a type ends at "=" on its line
            kind, sign, _ = self.at(k)
            if sign == "=" and kind == "op":
                return k + 1
            if not (kind == "name" or kind == "op" and sign in ".|[]<>?*&,"):
                break
        return i + 1

    def value(self, i: int) -> tuple[str, str, tuple[int, int]] | None:
        """("literal", text, span) at ``i``: strings side by side or joined by an operator; or ("name", name, span) that may stand for one."""
        open_ = 0
        while True:
            k = self.skip_lines(i) if open_ else i
            word = self.at(k)[1]
            if word == "(" and self.at(k)[0] == "op":
                open_, i = open_ + 1, k + 1
                continue
            i = k
            if self.at(k)[0] == "name" and self.at(k + 1)[:2] == ("op", "("):
                parts = {p.lower() for p in _PARTS.findall(word)}
                if parts & LOOKUPS:
                    return None
                open_, i = open_ + 1, k + 2
                continue
            break
        kind, word, span = self.at(i)
        if kind == "name":
            return "name", word, span
        if kind not in _STRINGS:
            return None
        value, (start, end), i = word, self.at(i)[2], i + 1
        while True:
            k = self.skip_lines(i)
            joined = self.at(k)[0] == "op" and self.at(k)[1] in ("+", ".", "..", "\\", "&")
            if joined:
                k = self.skip_lines(k + 1)
            if self.at(k)[0] not in _STRINGS or not (joined or open_ or k == i):
                return "literal", value, (start, end)
            value, end, i = value + self.at(k)[1], self.at(k)[2][1], k + 1

    def secrets(self) -> set[tuple[int, int]]:
        found: set[tuple[int, int]] = set()
        refers: list[tuple[str, int, str]] = []  # (name, weight, the name it stands for)
        around: list[str] = []  # names of the objects that are open
        for i, (kind, word, _) in enumerate(self.tokens):
            if kind == "op":
                if word == "{":
                    before = self.at(i - 1) if i else ("end", "", (0, 0))
                    named = before[0] == "op" and before[1] in (":", "=", "=>", ":=") and i >= 2 and self.at(i - 2)[0] in ("name", *_STRINGS)
                    around.append(self.at(i - 2)[1] if named else "")
                elif word == "}" and around:
                    around.pop()
                continue
            if kind != "name" and kind not in _STRINGS:
                continue
            names, k = self.target(i)
            k = self.assigned(k)
            literal = self.value(k) if k >= 0 else None
            if literal is None:
                continue
            key = names[0] if len(names) == 1 else f"{names[0]}[{names[-1]}]"
            weight = max(name_weight(n) or (name_weight(around[-1]) if around and n.lower() in GENERIC else 0) for n in names)
            if literal[0] == "name":
                refers.append((key, weight, literal[1]))
                continue
            self.constants[key] = literal[1:]
            score = literal_score(literal[1])
            if weight and score > 0 and weight + score >= THRESHOLD:
                found.add(literal[2])
        # Names stand for literals, or for names that do, wherever those are assigned.
        stands = {name: other for name, _, other in refers if name != other}
        for _, weight, other in refers:
            seen: set[str] = set()
            while other not in self.constants and other in stands and other not in seen:
                seen.add(other)
                other = stands[other]
            if weight and other in self.constants:
                value, span = self.constants[other]
                if (score := literal_score(value)) > 0 and weight + score >= THRESHOLD:
                    found.add(span)
        return found


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of literals that score as secrets under the names they reach: those of the tokens, and bare values of configuration."""
    quoted = _Tokens(text).secrets() if _STEM.search(text) and any(q in text for q in "\"'`") else set()
    bare = [x for x in _configured(text) if not any(a <= x[0] and x[1] <= b for a, b in quoted)]
    return sorted({*quoted, *bare})


def _surroundings(text: str) -> list[tuple[int, str]]:
    """(place, name) of what names without a meaning take: the section in brackets, or the key with nothing beside it that the lines below are indented under."""
    out: list[tuple[int, str]] = [(0, "")]
    section, stack = "", []
    for m in _LINE.finditer(text):
        if m["section"]:
            section, stack = m["section"], []
        else:
            depth = len(m["indent"])
            while stack and stack[-1][0] >= depth:
                stack.pop()
            if m["parent"]:
                stack.append((depth, m["parent"]))
                continue
        name = stack[-1][1] if stack else section
        if name != out[-1][1]:
            out.append((m.start(), name))
    return out


def _configured(text: str) -> list[tuple[int, int]]:
    constants: dict[str, tuple[int, int]] = {}
    found: set[tuple[int, int]] = set()
    around = _surroundings(text) if _STEM.search(text) else [(0, "")]
    places = [a for a, _ in around]
    for m in _PAIR.finditer(text):
        group = m.lastgroup
        value, span = m[group], m.span(group)
        given = True
        if group == "bare":
            value = value.rstrip(".")
            span = (span[0], span[0] + len(value))
            given = "(" not in value and not (_IDENTIFIER.match(value) and not any(c.isdigit() for c in value))
            if value in constants:  # a name that stands for an earlier literal
                span, given = constants[value], True
                value = text[slice(*span)]
        constants[m["name"]] = span
        weight = name_weight(m["name"])
        if not weight and m["name"].lower() in GENERIC:
            weight = name_weight(around[bisect.bisect_right(places, m.start()) - 1][1])
        if weight and weight + literal_score(value) >= THRESHOLD and literal_score(value) > 0 and given:
            found.add(span)
    return sorted(found)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    if ("=" in text or ":" in text) and _KEYWORD.search(text):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start, then kind."""
    text = text or ""
    base = base_spans(text)
    more = lexed(text) if "=" in text or ":" in text else []
    kept = [("lexed", a, b) for a, b in more if not any(s <= a and b <= e for _, s, e in base)]
    return base, sorted(base + kept, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """``text`` with each stretch of overlapping spans replaced by ``mark``."""
    if not text:
        return text
    out, at = [], 0
    for _, a, b in scan(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the numbers of base spans by kind, ``base_sha256`` of them, and ``spans``, all of them as kind:start:end in code points."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    arrow = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_assign", "n_access", "n_hex")), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text in batch.column(1):
                base, every = scan(text.as_py())
                kinds = Counter(k for k, _, _ in base)
                for col, x in zip(cols, (kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t.type) for c, t in zip(cols, list(arrow)[1:], strict=True))], schema=arrow)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets blanked out of ``text_col`` and ``length_col`` set to the new length of changed texts."""
    kind = docs.schema
    at = docs.columns.index(text_col)
    k = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [redact(t) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if k is not None:
                columns[k] = pa.array([len(n) if n is not o and n != o else was for n, o, was in zip(new, old, columns[k].to_pylist(), strict=True)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(tidy(run), kind)
