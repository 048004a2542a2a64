"""Operator 3: secret scans with structural confirmation.

Patterns propose candidates. Besides the three base kinds, a candidate is only reported if it proves to be built like a
secret: signed tokens must have a JSON header naming an algorithm and a JSON body, key blocks and bare base64 or hex must
decode to a private-key encoding whose nested lengths add up. Escaped newlines count as newlines, and bare base64 may go on
over lines.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import itertools
import json
import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from quillon.llm import text as T
from quillon.llm.common import configure

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Runs of the characters of signed tokens, with dots; a token starts at the first or last "eyJ" of a part.
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}")
BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[^-]|-(?!----))*)-----END \1-----")
#: Newlines and slashes as strings of programs and JSON escape them.
ESCAPED = re.compile(r"\\+(?:[nrt]|(?=/))")
CIPHER = re.compile(r"^DEK-Info:\s*[A-Za-z0-9-]+,\s*((?:[0-9A-Fa-f]{16}){1,2})\s*$", re.MULTILINE)
#: Where the base64 of a key may begin that goes on in further lines, and one line of it.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-P][A-Za-z0-9+/_-]{10}|b3BlbnNzaC1rZXktdjEA)[A-Za-z0-9+/_-]{20,}(?=\s)")
LINE = re.compile(r"\s*([A-Za-z0-9+/_-]+)")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}")
#: How a key may begin within a longer run, where something is glued to it.
INNER = re.compile(r"M[A-P][A-Za-z0-9+/_-]{2}|b3BlbnNzaC1rZXktdjEA")
HEX_ANY = re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{64,}+")
KINDS = ("assign", "access", "hex", "signed_token", "key_block", "base64_key", "hex_key")

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="]] = 1
_HEX = np.zeros(256, np.uint8)
_HEX[[*b"0123456789abcdefABCDEF"]] = 1


class Span(NamedTuple):
    start: int
    end: int
    kind: str


def _length(d: bytes, i: int) -> tuple[int, int] | None:
    """(length, where the content starts) of a DER value whose length bytes start at i; long forms must be minimal."""
    if i >= len(d):
        return None
    n = d[i]
    if n < 0x80:
        return n, i + 1
    k = n & 0x7F
    if not 1 <= k <= 4 or i + 1 + k > len(d) or d[i + 1] == 0:
        return None
    size = int.from_bytes(d[i + 1 : i + 1 + k], "big")
    return (size, i + 1 + k) if size >= 0x80 else None


def der_children(d: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the values that fill ``d`` exactly, or None."""
    out, i = [], 0
    while i < len(d):
        got = _length(d, i + 1)
        if got is None or got[1] + got[0] > len(d):
            return None
        out.append((d[i], d[got[1] : got[1] + got[0]]))
        i = got[1] + got[0]
    return out


def is_private_key(d: bytes) -> bool:
    """Whether ``d`` is a private key: PKCS#1, PKCS#8, encrypted PKCS#8, SEC1 or OpenSSH, with nested lengths that add up."""
    if d.startswith(b"openssh-key-v1\0"):
        i, parts = 15, []
        while i + 4 <= len(d) and len(parts) < 3:
            n = int.from_bytes(d[i : i + 4], "big")
            if i + 4 + n > len(d):
                return False
            parts.append(d[i + 4 : i + 4 + n])
            i += 4 + n
        return len(parts) == 3 and parts[0].isascii()
    top = der_children(d)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = der_children(top[0][1])
    if not inner:
        return False
    tags = [t for t, _ in inner]
    oid = lambda c: bool((x := der_children(c)) and x[0][0] == 0x06)
    if len(inner) >= 9 and tags[:9] == [2] * 9 and inner[0][1] in (b"\0", b"\1"):
        return True
    if len(inner) >= 3 and tags[:3] == [2, 0x30, 4] and inner[0][1] in (b"\0", b"\1"):
        return oid(inner[1][1])
    if len(inner) >= 2 and tags[:2] == [2, 4] and inner[0][1] == b"\1":
        return len(inner[1][1]) >= 16
    if tags == [0x30, 4]:
        return oid(inner[0][1]) and len(inner[1][1]) >= 32
    return False


def from_base64(s: str) -> bytes | None:
    s = s.replace("-", "+").replace("_", "/").rstrip("=")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_key_block(body: str) -> bool:
    """Whether what a key block holds is a private key; of a body that its headers call encrypted, whole cipher blocks."""
    lines, headers = [], []
    for x in ESCAPED.sub(lambda m: "\n" if m[0][-1] != "\\" else "", body).splitlines():
        if ":" in x or headers and not lines and x[:1] in (" ", "\t") and x.strip():
            headers.append(x.strip())
        else:
            lines += x.split()
    raw = from_base64("".join(lines))
    if raw is None:
        return False
    cipher = CIPHER.search("\n".join(headers))
    return is_private_key(raw) or cipher is not None and len(raw) >= 32 and len(raw) % (len(cipher[1]) // 2) == 0


def _size_by(read: Callable[[int, int], bytes]) -> int | None:
    """Bytes of the key that begins with the bytes ``read(start, number)`` gives, perhaps with more after it; None if they don't tell. Only lengths are read, not what they are of."""
    head = read(0, 15)
    if head != b"openssh-key-v1\0":
        got = _length(head, 1) if head[:1] == b"\x30" else None
        return got and sum(got)
    number = lambda i: int.from_bytes(x, "big") if len(x := read(i, 4)) == 4 else None
    i, cipher = 15, b""
    for k in range(3):
        n = number(i)
        if n is None:
            return None
        cipher = read(i + 4, min(n, 64)) if k == 0 else cipher
        i += 4 + n
    keys = number(i)
    if keys is None:
        return None
    i += 4
    for _ in range(keys + 1):
        n = number(i)
        if n is None:
            return None
        i += 4 + n
    return i + 16 * (b"gcm" in cipher or b"poly1305" in cipher)


class _Run:
    """Base64 words one after another, with white space between them, read once: where each begins and ends, and all of them joined."""

    def __init__(self, t: str, at: int):
        self.starts, self.ends, self.sums, parts = [], [], [0], []
        while x := LINE.match(t, at):
            self.starts.append(x.start(1))
            self.ends.append(at := x.end())
            self.sums.append(self.sums[-1] + len(x[1]))
            parts.append(x[1])
        self.joined = "".join(parts)


def _decoded(s: str, first: int, i: int, n: int) -> bytes:
    """``n`` bytes from the ``i``-th on of what the characters of ``s`` from ``first`` on encode."""
    raw = from_base64(s[first + i // 3 * 4 : first - (-(i + n) // 3) * 4].rstrip("="))
    return b"" if raw is None else raw[i % 3 : i % 3 + n]


def wrapped_keys(t: str) -> list[tuple[int, int]]:
    """(start, end) of private keys in base64 over several lines. A key tells its length, and with that where its last line ends.

    Lines are read once, whatever number of keys seems to begin in them; only a length that ends with a line is looked into.
    """
    t, out, at, run = ESCAPED.sub(lambda m: "\n" * len(m[0]), t), [], 0, None
    for m in WRAPPED.finditer(t):
        if m.start() < at:
            continue
        if run is None or m.start() > run.starts[-1]:
            run = _Run(t, m.start())
        k = bisect.bisect_left(run.starts, m.start())
        first = run.sums[k]
        size = _size_by(lambda i, n, run=run, first=first: _decoded(run.joined, first, i, n))
        if size is None or m[0][0] == "M" and not _starts_key(from_base64(m[0][:32]) or b""):
            continue
        last = first - (-size * 4 // 3)
        j = bisect.bisect_left(run.sums, last)
        if j >= len(run.sums) or run.sums[j] != last or j < k + 2:
            continue
        raw = from_base64(run.joined[first:last])
        if raw is not None and is_private_key(raw):
            end = run.ends[j - 1]
            at = end + len(t[end : end + 2]) - len(t[end : end + 2].lstrip("="))
            out.append((m.start(), at))
    return out


def is_signed_token(head: str, body: str, sig: str) -> bool:
    """Whether the first two parts decode to JSON objects and the first names an algorithm."""
    try:
        h = json.loads(from_base64(head) or b"")
        if not isinstance(h, dict) or not isinstance(h.get("alg"), str):
            return False
        return isinstance(json.loads(from_base64(body) or b""), dict) and (len(sig) >= 16 or h["alg"].lower() == "none")
    except (ValueError, RecursionError):
        return False


def base_spans(t: str) -> list[Span]:
    """assign, access and hex spans, leftmost and non-overlapping per kind, in code points."""
    out = []
    if ":" in t or "=" in t:
        out += [Span(*m.span(), "assign") for m in ASSIGN.finditer(t) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in t:
        out += [Span(*m.span(), "access") for m in ACCESS.finditer(t) if m.end() - m.start() >= 18]
    return out + [Span(*m.span(), "hex") for m in HEX.finditer(t)]


def signed_tokens(t: str) -> list[Span]:
    """Signed tokens, leftmost and non-overlapping. Each dotted run is read once, so long runs of token-like text stay cheap."""
    out = []
    for m in DOTTED.finditer(t):
        if "eyJ" not in m[0]:
            continue
        parts = m[0].split(".")
        at = [m.start()]
        for x in parts:
            at.append(at[-1] + len(x) + 1)
        k = 0
        while k + 2 < len(parts):
            step = 1
            for i in dict.fromkeys((parts[k].find("eyJ"), parts[k].rfind("eyJ"))):
                if i >= 0 and is_signed_token(parts[k][i:], parts[k + 1], parts[k + 2]):
                    out.append(Span(at[k] + i, at[k + 2] + len(parts[k + 2]), "signed_token"))
                    step = 3
                    break
            k += step
    return out


def _starts_key(d: bytes) -> bool:
    """Whether ``d`` begins as a private key does: a sequence of a version 0 or 1, or of a sequence of an object's name."""
    got = _length(d, 1) if d[:1] == b"\x30" else None
    inner = d[got[1] :] if got else b""
    if inner[:1] == b"\x30":
        got = _length(inner, 1)
        return got is not None and inner[got[1] : got[1] + 1] == b"\x06"
    return inner[:3] in (b"\x02\x01\x00", b"\x02\x01\x01")


def _bare_key(s: str) -> tuple[int, int] | None:
    """(start, end) of the first private key in a run of base64: all of it, or from a place where a key says it begins to where its length ends it."""
    raw = from_base64(s)
    if raw is not None and is_private_key(raw):
        return 0, len(s)
    for m in INNER.finditer(s):
        i = m.start()
        size = _size_by(lambda a, n, i=i: _decoded(s, i, a, n))
        if size is None or size < 24 or m[0][0] == "M" and not _starts_key(_decoded(s, i, 0, 24)):
            continue
        n = -(-size * 4 // 3)
        if n <= len(s) - i and (raw := from_base64(s[i : i + n])) is not None and is_private_key(raw):
            return i, i + n + len(s[i + n : i + n + 2]) - len(s[i + n : i + n + 2].lstrip("="))
    return None


def _bare_hex(s: str) -> tuple[int, int] | None:
    n = len(s) // 2 * 2
    return (0, n) if is_private_key(binascii.unhexlify(s[:n])) else None


def confirmed_spans(t: str) -> list[Span]:
    """Spans that structure confirms; a bare key that begins inside a confirmed span is not reported again."""
    out = signed_tokens(t)
    out += [Span(*m.span(), "key_block") for m in BLOCK.finditer(t) if is_key_block(m[2])]
    for spans in ([Span(a, z, "base64_key") for a, z in wrapped_keys(t)], _bare(t, "base64_key", BASE64, _bare_key), _bare(t, "hex_key", HEX_ANY, _bare_hex)):
        # Spans of a kind don't overlap and few overlap others: the running end of those that start before tells whether a start is inside one.
        known = sorted((s.start, s.end) for s in out)
        starts, reach = [a for a, _ in known], list(itertools.accumulate((z for _, z in known), max))
        out += [s for s in spans if not (k := bisect.bisect_right(starts, s.start)) or reach[k - 1] <= s.start]
    return out


def _bare(t: str, kind: str, pattern: re.Pattern, find) -> list[Span]:
    return [Span(m.start() + got[0], m.start() + got[1], kind) for m in pattern.finditer(t) if (got := find(m[0]))]


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def find_secrets(t: str | None) -> list[Span]:
    """All spans of a text by start, then kind; null and empty texts have none."""
    return ordered(base_spans(t) + confirmed_spans(t)) if t else []


def _long_runs(b: np.ndarray, o: np.ndarray, table: np.ndarray, least: int) -> np.ndarray:
    """For each text, whether it has a run of at least ``least`` bytes of the class."""
    s, e, bounds = T.tokens(b, o, table)
    long = np.append(0, np.cumsum(e - s >= least))
    return long[bounds[1:]] > long[bounds[:-1]]


def scan_column(column) -> list[list[Span]]:
    """Spans of every text of an Arrow string column. Texts without any long enough run of key characters, and without the mark of a key block, skip the slower patterns; none of those can match there."""
    b, o = T.strings(column)
    hexes, runs = [], []
    for _, _, bb, oo in T.blocks(b, o):
        hexes.append(_long_runs(bb, oo, _HEX, 16))
        runs.append(_long_runs(bb, oo, _CLASS, 32))
    has_hex, has_run = (np.concatenate(x) if x else np.zeros(0, bool) for x in (hexes, runs))
    out = []
    for i, x in enumerate(column):
        t = x.as_py() or ""
        spans = []
        if ":" in t or "=" in t:
            spans += [Span(*m.span(), "assign") for m in ASSIGN.finditer(t) if m.end(2) - m.start(2) >= 12]
        if "AKIA" in t:
            spans += [Span(*m.span(), "access") for m in ACCESS.finditer(t) if m.end() - m.start() >= 18]
        if has_hex[i]:
            spans += [Span(*m.span(), "hex") for m in HEX.finditer(t)]
        if has_run[i] or "-----BEGIN" in t or "eyJ" in t:
            spans += confirmed_spans(t)
        out.append(ordered(spans) if spans else spans)
    return out


SPANS = ArrayType(StructType().add("start", "integer").add("end", "integer").add("kind", "string"))
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def scan_secrets(docs: DataFrame, keep: list[str], into: str = "secret_spans") -> DataFrame:
    """``keep`` columns and all spans of ``text`` by start, then kind, in one scan.

    Null and empty texts have none; repeated rows stay and get the same spans; spans that start together come in the order
    of KINDS; an empty table gives no rows. Very long texts are scanned whole, in time that grows with their length. Other
    columns are not read, so their names can't clash.
    """
    configure(docs.sparkSession)
    at = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    names = [f.name for f in at.schema.fields[:-1]]

    def run(batches):
        for batch in batches:
            found = [[s._asdict() for s in x] for x in scan_column(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _ARROW)], names=[*names, into])

    return at.mapInArrow(run, at.select(*names).schema.add(into, SPANS))


def redact(text: str | None, spans: list, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones together, replaced by ``mark``."""
    if not text or not spans:
        return text
    out, at = [], 0
    end = None
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if end is not None and s["start"] <= end:
            end = max(end, s["end"])
            continue
        if end is not None:
            at = end
        out += [text[at : s["start"]], mark]
        end = s["end"]
    return "".join(out) + text[end:]


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with its own columns, in which secrets of ``text`` are replaced by ``mark`` and ``n_chars``, if there, follows. No row is dropped."""
    configure(docs.sparkSession)
    schema = docs.schema
    names = schema.names

    def run(batches):
        for batch in batches:
            k = names.index("text")
            col = batch.column(k)
            found = scan_column(col)
            texts = [redact(t.as_py(), [s._asdict() for s in f], mark) if f else t.as_py() for t, f in zip(col, found, strict=True)]
            cols = list(batch.columns)
            cols[k] = pa.array(texts, col.type)
            if "n_chars" in names:
                c = names.index("n_chars")
                cols[c] = pa.array([len(t) if f else n.as_py() for t, f, n in zip(texts, found, cols[c], strict=True)], cols[c].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, schema)
