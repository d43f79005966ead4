"""Secret scans: three credential patterns and a token-efficiency test.

A text that a byte-pair vocabulary has seen packs several characters into a token; a random key needs a token for
one or two. A long run of key characters is reported as ``random`` when its characters per token fall to
``max_ratio`` or less, unless it is a known kind of digest or identifier (hex of a digest's length, UUID, number).
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from thawline.llm import textbytes as tb
from thawline.llm.common import add_columns

#: The base patterns, and the least length of what they match.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
KNOWN = re.compile(r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
                   r"|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/_=-]+")  # fmt: skip
_RUN_BYTES = tb.byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)) | np.isin(np.arange(256), list(b"+/_=-"))
_HEX_BYTES = tb.byte_set((0x30, 0x39), (0x61, 0x66))
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

SCHEMA = (
    "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, "
    "found array<struct<kind:string,start:int,end:int,chars_per_token:double>>"
)


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def find(text: str, vocabulary: str, min_run: int, max_ratio: float) -> list[tuple[str, int, int, float | None]]:
    """Spans of one text as (kind, start, end, ratio) by start, then kind."""
    out = [("assign", m.start(), m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [("hex", m.start(), m.end(), None) for m in re.finditer(r"[0-9a-f]{%d,}" % HEX_LEAST, text)]
    for m in RUN.finditer(text):
        if len(m[0]) < min_run or KNOWN.fullmatch(m[0]):
            continue
        ratio = len(m[0]) / len(encoder(vocabulary).encode_ordinary(m[0]))
        if ratio <= max_ratio:
            out.append(("random", m.start(), m.end(), ratio))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def suspects(data: np.ndarray, offsets: np.ndarray, min_run: int) -> np.ndarray:
    """Rows that can hold a span; all others hold none."""
    hit = np.zeros(len(offsets) - 1, bool)
    if not len(data):
        return hit
    runs = tb.scan(data, offsets, _HEX_BYTES, hashed=False)
    hit[runs.doc[runs.end - runs.start >= HEX_LEAST]] = True
    runs = tb.scan(data, offsets, _RUN_BYTES, hashed=False)
    hit[runs.doc[runs.end - runs.start >= min_run]] = True
    raw, low = data.tobytes(), tb.LOWER[data].tobytes()
    for where, words in ((raw, (b"AKIA",)), (low, _KEYWORDS)):
        for w in words:
            at = where.find(w)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                hit[row] = True
                at = where.find(w, max(at + 1, int(offsets[row + 1])))
    return hit


def scan_secrets(
    docs: DataFrame,
    text: str = "text",
    vocabulary: str | None = None,
    min_run: int = 20,
    max_ratio: float = 2.0,
) -> DataFrame:
    """Add the spans of secrets in ``text`` to every row of ``docs``; other columns stay, whatever their names.

    Null and empty texts have no spans; long ones are searched whole. Columns of the result that ``docs`` has already
    are replaced. Repeated rows are treated alike, spans of equal start are listed in the order of kinds; an empty table
    gives an empty result. ``vocabulary``: a file of tiktoken ranks.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    none = hashlib.sha256(b"").hexdigest()

    def make(column: pa.Array) -> list[pa.Array]:
        data, offsets = tb.buffers(column)
        found: list[list] = [[] for _ in range(len(column))]
        for r in np.flatnonzero(suspects(data, offsets, min_run)):
            found[r] = find(column[int(r)].as_py() or "", path, min_run, max_ratio)
        told = [[f"{k}:{a}:{b}" for k, a, b, _ in x] for x in found]
        base = [[s for s in x if not s.startswith("random")] for x in told]
        return [
            *[pa.array([sum(y[0] == kind for y in x) for x in found], pa.int64()) for kind in KINDS],
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() if x else none for x in base], pa.string()),
            pa.array([",".join(x) for x in told], pa.string()),
            pa.array(
                [[{"kind": k, "start": a, "end": b, "chars_per_token": r} for k, a, b, r in x] for x in found],
                pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("chars_per_token", pa.float64())])),
            ),
        ]

    return add_columns(docs, text, make, SCHEMA)
