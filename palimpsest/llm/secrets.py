"""Secret scan with structural confirmation.

scan_secrets(docs) finds spans in every whole text. Three base kinds are plain patterns. The further kinds are
candidates that are only reported once their structure is confirmed:

    jwt   three base64url parts; the first two decode to JSON objects, the first of which names an algorithm
    pem   a PRIVATE KEY block whose body is base64 of a DER SEQUENCE with consistent nested lengths, or has header lines
          that name a cipher and an initial value whose block size its length fits; or base64 of such a block
    ssh   base64 or hex of an SSH key: length-prefixed fields that start with a known key type and fill the whole, or an
          openssh-key-v1 container: cipher, derivation, public keys that parse, and a padded private part that fills the rest
    der   base64 or hex, outside PEM, of a DER SEQUENCE that starts with a version and fills the whole

Base64 outside PEM may be in the url alphabet, and wrapped into lines. A run of base64 is a candidate wherever its first
bytes can be those of one of these structures; that excludes no structure, as all have fixed first bytes. An OpenSSH
PEM block must hold such a container.

Spans are code points, end exclusive, by start and then by kind in the order of KINDS.

Defined cases. Null text: empty, no spans. Repeated rows: each gets its row. Overlapping spans of different kinds
all stay. Very long texts are scanned whole; no pattern backtracks over more than one candidate. Base64 candidates
of any length are decoded whole. Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import chunks, table

KINDS = ("assign", "access", "hex", "jwt", "pem", "ssh", "der")
BASE = KINDS[:3]

# The base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18

_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----((?:\s*[A-Za-z][A-Za-z0-9-]*: [^\n]*\n)*)((?:[A-Za-z0-9+/=\s]|\\[rn])+)-----END \1-----")
_DEK = re.compile(r"^DEK-Info: *[A-Za-z0-9-]+, *((?:[0-9A-Fa-f]{16}){1,2})\s*$", re.MULTILINE)
# All beginnings of an SSH key, its container, a DER SEQUENCE and a PEM block; then lines of either alphabet.
_B64 = re.compile(r"(?<![A-Za-z0-9+/])(?:AAAA|b3BlbnNza|M[A-I]|LS0tLS1)(?=[A-Za-z0-9+/_-]{16})")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_WRAP = re.compile(r"""["']?[ \t]*[+,\\]?[ \t]*(?:\r?\n|\r|\\r\\n|\\n)[ \t]*["']?(?=[A-Za-z0-9+/_-])""")
_TAIL = re.compile(r"={1,2}|(?![A-Za-z0-9+/])")
# The same beginnings in hex.
_HEXKEY = re.compile(r"(?<![0-9A-Fa-f])(?:30|2[dD]2[dD]2[dD]2[dD]2[dD]|6[fF]70656[eE]737368|000000)[0-9A-Fa-f]{30,}(?![0-9A-Fa-f])")
_OPENSSH = b"openssh-key-v1\0"
# Names of SSH key types.
SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")


def decoded(text: str, url: bool = False) -> bytes | None:
    """The bytes of a base64 candidate, or None."""
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    if url:
        text = text.replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_element(raw: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, stop) of the content of the DER element at a position, if its length fits and is the shortest form."""
    if end - at < 2:
        return None
    tag, size, at = raw[at], raw[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size = int.from_bytes(raw[at : at + n], "big")
        if size < 0x80 or size >> (8 * (n - 1)) == 0:
            return None
        at += n
    return (tag, at, at + size) if at + size <= end else None


def is_key_der(raw: bytes) -> bool:
    """A SEQUENCE that fills raw and whose elements fill it in turn; the first is a one-byte version, others follow."""
    top = der_element(raw, 0, len(raw))
    if not top or top[0] != 0x30 or top[2] != len(raw):
        return False
    at, elements = top[1], []
    while at < top[2]:
        if not (e := der_element(raw, at, top[2])):
            return False
        elements.append(e)
        at = e[2]
    if len(elements) < 3 or elements[0][0] != 0x02 or elements[0][2] - elements[0][1] != 1:
        return False
    return all(_nested(raw, e) for e in elements)


def _nested(raw: bytes, element: tuple[int, int, int]) -> bool:
    todo = [element]
    while todo:
        tag, at, end = todo.pop()
        while tag & 0x20 and at < end:
            if not (e := der_element(raw, at, end)):
                return False
            todo.append(e)
            at = e[2]
    return True


def is_ssh_key(raw: bytes) -> bool:
    """Length-prefixed fields that fill raw; the first names a key type."""
    at, fields = 0, 0
    while at < len(raw):
        if at + 4 > len(raw):
            return False
        size = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + size > len(raw) or not fields and raw[4 : 4 + size] not in SSH_TYPES:
            return False
        at, fields = at + 4 + size, fields + 1
    return fields >= 2


def ssh_field(raw: bytes, at: int) -> tuple[bytes, int] | None:
    """(content, end) of the length-prefixed field at a position, if it fits."""
    end = at + 4 + int.from_bytes(raw[at : at + 4], "big")
    return (raw[at + 4 : end], end) if at + 4 <= len(raw) and end <= len(raw) else None


def openssh_end(raw: bytes) -> int | None:
    """Where the openssh-key-v1 container at the start of raw ends, if all its fields are consistent."""
    if not raw.startswith(_OPENSSH):
        return None
    at, head = len(_OPENSSH), []
    for _ in range(3):  # cipher, derivation and its options
        if not (field := ssh_field(raw, at)):
            return None
        head.append(field[0])
        at = field[1]
    n, at = int.from_bytes(raw[at : at + 4], "big"), at + 4
    open_ = head[0] == b"none"
    if not 1 <= n <= len(raw) // 4 or not head[0] or (head[1] == b"none") != open_ or bool(head[2]) == open_:
        return None
    for _ in range(n):
        field = ssh_field(raw, at)
        if not field or not is_ssh_key(field[0]):
            return None
        at = field[1]
    private = ssh_field(raw, at)
    if not private or len(private[0]) < 16 or len(private[0]) % 8:
        return None
    if open_:
        kind = ssh_field(private[0], 8)
        if private[0][:4] != private[0][4:8] or not kind or kind[0] not in SSH_TYPES:
            return None
    return private[1]


def is_signed_token(token: str) -> bool:
    head, body, _ = token.split(".")
    try:
        head, body = (json.loads((decoded(x, url=True) or b"").decode()) for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)


def is_pem_key(label: str, headers: str, body: str) -> bool:
    raw = decoded(re.sub(r"\\[rn]|\s", "", body))
    if raw is None:
        return False
    if "ENCRYPTED" in headers and (dek := _DEK.search(headers)):
        return len(raw) >= 32 and len(raw) % (len(dek[1]) // 2) == 0
    if label == "OPENSSH PRIVATE KEY":
        return openssh_end(raw) == len(raw)
    top = der_element(raw, 0, len(raw))
    return is_key_der(raw) or label == "ENCRYPTED PRIVATE KEY" and bool(top) and top[0] == 0x30 and top[2] == len(raw)


def _lines(text: str, at: int, most: float = float("inf")) -> tuple[str, list[tuple[int, int]]]:
    """Up to so many base64 characters from a position on, over line ends, and (characters so far, end in text) of each line."""
    parts, ends, n = [], [], 0
    while n < most and (m := _LINE.match(text, at)):
        parts.append(m[0] if n + len(m[0]) <= most else m[0][: int(most) - n])
        n += len(parts[-1])
        ends.append((n, m.start() + len(parts[-1])))
        if not (wrap := _WRAP.match(text, ends[-1][1])):
            break
        at = wrap.end()
    return "".join(parts), ends


def _pem_end(raw: bytes) -> int | None:
    """Where the last PEM block of a private key in raw ends."""
    ends = [m.end() for m in _PEM.finditer(raw.decode("latin-1")) if is_pem_key(m[1], m[2], m[3])]
    return ends[-1] if ends else None


def hex_secret(digits: str) -> int | None:
    """The kind of the secret that a run of hex digits holds, or None."""
    if len(digits) % 2:
        return None
    raw = bytes.fromhex(digits)
    if raw.startswith(b"-----"):
        return 4 if _pem_end(raw) else None
    if raw[0] == 0x30:
        return 6 if is_key_der(raw) else None
    return 5 if openssh_end(raw) == len(raw) or is_ssh_key(raw) else None


def base64_secret(text: str, at: int) -> tuple[int, int] | None:
    """(kind, end) of the secret whose base64 begins at a position, or None."""
    head = decoded(text[at : at + 20], url=True)
    if head is None:
        return None
    if head[0] == 0x30:  # its own length says where it ends
        start = 2 + (head[1] & 0x7F if head[1] >= 0x80 else 0)
        if start > 6 or head[start : start + 2] != b"\2\1":
            return None
        size = start + (int.from_bytes(head[2:start], "big") if start > 2 else head[1])
        need = -(-4 * size // 3)
        chars, ends = _lines(text, at, need)
        if len(chars) < need or not (tail := _TAIL.match(text, ends[-1][1])):
            return None
        raw = decoded(chars, url=True)
        return (6, tail.end()) if raw and is_key_der(raw) else None
    if head.startswith(b"-----"):
        chars, ends = _lines(text, at)
        last = _pem_end(decoded(chars[: len(chars) - (len(chars) % 4 == 1)], url=True) or b"")
        if not last:
            return None
        end = next(e for n, e in ends if n >= -(-4 * last // 3))
        return 4, end + len(re.compile("={0,2}").match(text, end)[0])
    if head.startswith(_OPENSSH[: len(head)]):
        chars, ends = _lines(text, at)
        stop = openssh_end(decoded(chars[: len(chars) - (len(chars) % 4 == 1)], url=True) or b"")
        end = dict(ends).get(-(-4 * stop // 3)) if stop else None
        tail = _TAIL.match(text, end) if end else None
        return (5, tail.end()) if tail else None
    if not any(head[4:].startswith(t[: len(head) - 4]) for t in SSH_TYPES):
        return None
    chars, ends = _lines(text, at)
    raw = decoded(chars[: len(chars) - (len(chars) % 4 == 1)], url=True) or b""
    of, pos, found = dict(ends), 0, None
    while pos + 4 <= len(raw):
        pos += 4 + int.from_bytes(raw[pos : pos + 4], "big")
        end = of.get(-(-4 * pos // 3))
        if pos <= len(raw) and end and (tail := _TAIL.match(text, end)) and is_ssh_key(raw[:pos]):
            found = (5, tail.end())
    return found


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of every secret, in order."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "eyJ" in text:
        found += [(m.start(), 3, m.end()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    pems = []
    if "PRIVATE KEY-----" in text:
        pems = [(m.start(), m.end()) for m in _PEM.finditer(text) if is_pem_key(m[1], m[2], m[3])]
        found += [(s, 4, e) for s, e in pems]
    until = 0
    for m in _B64.finditer(text):
        if m.start() < until or any(s <= m.start() < e for s, e in pems):
            continue
        if secret := base64_secret(text, m.start()):
            until = secret[1]
            found.append((m.start(), *secret))
    found += [(m.start(), kind, m.end()) for m in _HEXKEY.finditer(text) if (kind := hex_secret(m[0])) is not None]
    return sorted(found)


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        for part, texts in chunks(batch, "text"):
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(t)] for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>>."""
    return docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")


def _redact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        i = batch.schema.get_field_index("text")
        for part, texts in chunks(batch, "text"):
            out, sizes = [], []
            for text, null in zip(texts.to_pylist(), part.column(i).is_null().to_pylist(), strict=True):
                kept, at = [], 0
                for start, k, end in spans_of(text):
                    if start >= at:
                        kept += [text[at:start], f"[{KINDS[k]} removed]"]
                    at = max(at, end)
                kept.append(text[at:])
                text = "".join(kept)
                out.append(None if null else text)
                sizes.append(len(text))
            part = part.set_column(i, part.schema.field(i), pa.array(out, part.schema.field(i).type))
            if (j := part.schema.get_field_index("n_chars")) >= 0:
                part = part.set_column(j, part.schema.field(j), pa.array(sizes, pa.int64()).cast(part.schema.field(j).type))
            yield part


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with each secret replaced by a mark of its kind, overlapping ones by one; n_chars follows, if there is one."""
    return docs.mapInArrow(_redact, docs.schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def secret_base_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5_secret_scan that SQL can express."""
    return op5_secret_scan(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256")


QUERIES = {"op5_secret_scan": op5_secret_scan, "secret_base_kinds": secret_base_kinds}
# Matches are put between marks that no text holds, so that positions follow from the lengths of the pieces.
ORACLE_SQL = {
    "secret_base_kinds": r"""
WITH d AS (SELECT doc_id, replace(replace(coalesce(text, ''), chr(1), ' '), chr(2), ' ') AS t FROM documents),
marked AS (
  SELECT doc_id, 0 AS k, 'assign' AS kind, regexp_replace(t, '((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+)', chr(1) || '\1' || chr(2), 'g') AS m FROM d
  UNION ALL SELECT doc_id, 1, 'access', regexp_replace(t, '(AKIA[A-Z0-9]+)', chr(1) || '\1' || chr(2), 'g') FROM d
  UNION ALL SELECT doc_id, 2, 'hex', regexp_replace(t, '([0-9a-f]+)', chr(1) || '\1' || chr(2), 'g') FROM d),
piece AS (SELECT doc_id, k, kind, string_split(m, chr(1)) AS p FROM marked WHERE contains(m, chr(1))),
one AS (SELECT doc_id, k, kind, i, p[i] AS x, p FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM piece)),
placed AS (
  SELECT doc_id, k, kind, i, string_split(x, chr(2))[1] AS hit,
    CAST(sum(length(replace(x, chr(2), ''))) OVER (PARTITION BY doc_id, k ORDER BY i) - length(replace(x, chr(2), '')) AS BIGINT) AS a
  FROM one),
kept AS (
  SELECT *, a + length(hit) AS b FROM placed WHERE i > 1 AND CASE k
    WHEN 0 THEN length(regexp_extract(hit, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12
    WHEN 1 THEN length(hit) >= 18 ELSE length(hit) >= 16 END),
total AS (
  SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM kept GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
FROM documents LEFT JOIN total USING (doc_id)""",
}
