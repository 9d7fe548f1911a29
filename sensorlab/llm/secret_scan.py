"""Secret scans: keywords first, anchored patterns near hits, then checksums.

One Aho-Corasick automaton finds the keywords of all kinds in a single pass over
a text. A kind's pattern is tried only at its keyword's places, anchored there.
A run of hexadecimal digits has no keyword of its own: the text is mapped to
digit classes and searched for 24 digits in a row. Kinds that carry a checksum or
a decodable part are then validated.

Base kinds: ``assign`` ``access`` ``hex``. Added kinds: ``github`` and ``npm``
(base-62 crc32 in the last six characters), ``jwt`` (two decodable JSON
parts), ``pem`` (a private key block) and ``stripe`` (``sk_live_`` or ``rk_live_``
before 24 or more characters).

A key block goes from its first line over the body to the end of its END line or,
without one, of the base64 text. Line ends may be escaped, quoted, commented or
spaces. Where other text stands between body and END line, further parts of the body
are spans of their own. A first line without a body is a span by itself.

Spans are leftmost and non-overlapping within a kind, in code points, end
exclusive. Null and empty texts have no spans; equal rows get equal spans; an
empty table gives an empty table; columns of the table that clash with a result
column are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from sensorlab.llm.common import map_arrow

# Keywords and patterns of the base kinds.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = (
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

# Prefixes and shapes of the added kinds.
GITHUB = rb"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"
NPM = rb"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"
JWT = rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
PEM = rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"
PEM_END = rb"-----END (?:[A-Z]+ )*PRIVATE KEY-----"
#: What may stand between the parts of a key's body: line ends, escaped ones, quotes, comment marks.
PEM_GAP = (
    rb"""(?:\s|\\+[nrt]|\\+u000[aAdD9]|\\+(?!/)|&#(?:1[03]|x0?[aAdD]);|<br\x20?/?>"""
    rb"""|["'`]\s*\+(?=[\s"'`\\])|(?<=\s)(?://|\+)(?=\s)|["'`,;|>\#*()\[\]{}])*+"""
)
PEM_HEADERS = (
    rb"(?:" + PEM_GAP + rb"(?:Proc-Type:\s*4,\s*[A-Z-]+|DEK-Info:\s*[A-Z0-9-]+(?:,\s*[0-9A-Fa-f]+)?"
    rb"|[A-Z][A-Za-z-]*:[^\r\n\\]*(?=[\r\n\\])))*+" + PEM_GAP
)
PEM_PART = rb"(?:[A-Za-z0-9+]|\\*/)+(?:=|\\+u003[dD])*+"
#: Least characters of a part of a body beside others, and of one amid other text.
PEM_LEAST, PEM_ALONE = 16, 32
STRIPE = rb"[sr]k_live_[0-9A-Za-z]{24,}"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem", "stripe")
BASE = KINDS[:3]

SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base62_crc(body: bytes) -> str:
    """crc32 of a token's body as six base-62 digits."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out


def _crc_ends(match: re.Match) -> bool:
    body = match[0][4:]
    return base62_crc(body[:-6]) == body[-6:].decode()


def _json_part(part: bytes) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))), dict)
    except ValueError:
        return False


def _jwt_valid(match: re.Match) -> bool:
    return all(map(_json_part, match[0].split(b".")[:2]))


_END, _PART, _GAP = re.compile(PEM_END), re.compile(PEM_PART), re.compile(PEM_GAP)
_HEADERS = re.compile(PEM_HEADERS)
_PLAIN = re.compile(rb"(?:[A-Za-z0-9+]|\\*/)+")
_BODY = re.compile(rb"(?:" + PEM_PART + PEM_GAP + rb")*+")
_WORD = re.compile(rb"[A-Za-z]?[a-z]+|[A-Z]+")


def _decodes(part: bytes, least: int) -> bool:
    """Whether a part is base64 of some length and not a plain word."""
    bare = re.sub(rb"\\+u003[dD]|[\\=]", b"", part)
    if len(bare) < least or _WORD.fullmatch(bare):
        return False
    whole = len(bare) // 4 * 4
    return len(base64.b64decode(bare[:whole])) == whole // 4 * 3


def _run_end(text: bytes, at: int, stop: int) -> int:
    """End of the parts of a key's body that follow each other from ``at``; ``at`` if there are none."""
    end, found = at, False
    while part := _PART.match(text, at, stop):
        at = _GAP.match(text, part.end(), stop).end()
        padded = part[0][-1] in b"=dD" and not _PLAIN.fullmatch(part[0])
        if _decodes(part[0], PEM_LEAST):
            end, found = part.end(), True
            if not padded:
                continue
        # the last part may be short: padded, or the rest of its line
        elif found and (padded or part.end() == stop or text[part.end()] in b"\r\n\\\"'<&"):
            end = part.end()
        break
    return end


def key_spans(text: bytes, start: int, at: int) -> list[tuple[int, int, str]]:
    """Spans of the private key block whose first line is ``text[start:at]``."""
    stop = text.find(b"-----BEGIN ", at)
    stop = len(text) if stop < 0 else stop
    last = _END.search(text, at, stop)
    stop = last.start() if last else stop
    begin = _HEADERS.match(text, at, stop).end()
    if last and _BODY.match(text, begin, stop).end() == stop:
        parts = _PART.findall(text, begin, stop)
        odd = sum(len(p) for p in parts if not _WORD.fullmatch(p))
        if odd >= PEM_LEAST and 2 * odd >= sum(map(len, parts)):
            return [(start, last.end(), "pem")]
    end = _run_end(text, begin, stop)
    spans = [(start, end if end > begin else at, "pem")]
    if last:
        done = spans[0][1]
        while part := _PART.search(text, done, stop):
            done = part.end()
            if _decodes(part[0], PEM_ALONE):
                done = _run_end(text, part.start(), stop)
                spans.append((part.start(), done, "pem"))
    return spans


#: Kind: anchored pattern and test of a match. A match that fails the test still uses up its text.
PATTERNS = {
    "assign": (re.compile(ASSIGN, re.IGNORECASE), lambda m: len(m[2]) >= ASSIGN_LEAST),
    "access": (re.compile(ACCESS), lambda m: len(m[0]) >= ACCESS_LEAST),
    "github": (re.compile(GITHUB), _crc_ends),
    "npm": (re.compile(NPM), _crc_ends),
    "jwt": (re.compile(JWT), _jwt_valid),
    "pem": (re.compile(PEM), lambda m: True),
    "stripe": (re.compile(STRIPE), lambda m: True),
}
#: Lower-case keyword: kind. Each stands at the start of its kind's pattern.
KEYWORDS = {
    **{w: "assign" for w in ASSIGN_WORDS},
    "akia": "access",
    **{f"gh{c}_": "github" for c in "pousr"},
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
    "sk_live_": "stripe",
    "rk_live_": "stripe",
}

_JWT_RUN = re.compile(rb"[A-Za-z0-9_-]++")
_HEX_RUN = b"h" * HEX_LEAST
_HEX_CLASS = bytes(104 if chr(i) in "0123456789abcdef" else 46 for i in range(256))


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def byte_spans(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret in UTF-8 bytes, in byte offsets."""
    spans = []
    places: dict[str, int] = {}
    # Latin-1 keeps one character per byte, so hits are byte offsets
    for end, (kind, length) in automaton().iter(text.lower().decode("latin-1")):
        start = end - length + 1
        if start >= places.get(kind, 0):
            pattern, valid = PATTERNS[kind]
            match = pattern.match(text, start)
            if match:
                places[kind] = match.end()
                if kind == "pem":
                    spans += key_spans(text, start, match.end())
                elif valid(match):
                    spans.append((start, match.end(), kind))
            elif kind == "jwt":
                # every start in the run of the first part ends as this one did
                places[kind] = _JWT_RUN.match(text, start).end()
    classes = text.translate(_HEX_CLASS)
    start = classes.find(_HEX_RUN)
    while start >= 0:
        end = classes.find(b".", start)
        end = len(text) if end < 0 else end
        spans.append((start, end, "hex"))
        start = classes.find(_HEX_RUN, end)
    return spans


def find_spans(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    spans = byte_spans(text)
    if spans and not text.isascii():
        edges = sorted({x for a, b, _ in spans for x in (a, b)})
        at, points, done = {}, 0, 0
        for edge in edges:
            points += len(text[done:edge].decode())
            at[edge], done = points, edge
        spans = [(at[a], at[b], kind) for a, b, kind in spans]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """Replace what the spans cover; spans that overlap become one mark."""
    out, done, i = [], 0, 0
    while i < len(spans):
        a, b, _ = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][1])
            i += 1
        out += [text[done:a], mark]
        done = b
    return "".join([*out, text[done:]])


def scan_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns of ``SCHEMA``."""
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    rest = [c for c in df.columns if c not in names]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema)
    at = rest.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for value in batch.column(at).to_pylist():
            spans = find_spans((value or "").encode())
            base = [s for s in spans if s[2] in BASE]
            rows.append(
                (
                    *(sum(s[2] == kind for s in base) for kind in BASE),
                    hashlib.sha256(digest(base).encode()).hexdigest(),
                    digest(spans),
                )
            )
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        new = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*rest, *names])

    return map_arrow(df.select(*rest), run, f"{types}, {SCHEMA}")


def redact_secrets(df: DataFrame, mark: str, text: str = "text") -> DataFrame:
    """Replace every secret in the text by a mark; all other columns as they are."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    at = df.columns.index(text)

    def clean(value: str | None) -> str | None:
        spans = find_spans(value.encode()) if value else []
        return redact(value, spans, mark) if spans else value

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        columns[at] = pa.array(map(clean, columns[at].to_pylist()), pa.string())
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_arrow(df, run, types)
