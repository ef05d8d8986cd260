"""Secret scans: fixed patterns, and strings that a tokenizer finds hard to write.

Words and common fragments are few tokens long; random strings are many.  A candidate
string with few characters per token under a byte-pair vocabulary is reported, unless
it is a known digest or reads as an identifier.
"""

from __future__ import annotations

import base64
import re
from hashlib import sha256

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from lakewarden.llm.text import id_and_text, in_slices

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
# Runs that are too short fail whole and hold no other match, so the least length stands in the pattern.
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
HEX = re.compile("[0-9a-f]{16,}")
VALUE_LENGTH = 12

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# Fewer characters per token than this is not language.
RATIO = 2.6
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.IGNORECASE)
# Words, snake, kebab and camel case, paths, numbers: parts of letters alone or digits alone.
IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[_/+=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)|[A-Z][a-z]+)*[_/+=-]*")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and without overlaps within a kind."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= VALUE_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Efficiency:
    """Characters per token of strings under a vocabulary of ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={})

    def random(self, text: str, ratio: float = RATIO) -> bool:
        """Whether a string is neither a known digest nor an identifier, and costs many tokens."""
        if DIGEST.fullmatch(text) or UUID.fullmatch(text) or IDENTIFIER.fullmatch(text):
            return False
        if not any(c.isalnum() for c in text):  # a ruled line
            return False
        return len(text) < ratio * len(self.encoding.encode_ordinary(text))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        return [(m.start(), 3, m.end()) for m in CANDIDATE.finditer(text) if self.random(m[0])]


def joined(spans: list[tuple[int, int, int]]) -> str:
    """``kind:start:end`` by start, then kind; code points, end exclusive."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


_WORKER: dict[str, Efficiency] = {}


def scan(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text.

    Returns one row per row: doc_id, n_assign, n_access, n_hex, base_sha256 (of the
    fixed patterns' spans as ``kind:start:end``), spans (all of them, with the
    ``random`` strings), n_random.  Null counts as empty; texts without a secret have
    counts of 0 and empty spans; repeated rows give repeated results; other columns
    are not read.  ``path`` names a vocabulary file of ranks.
    """
    def scanned(batches):
        if path not in _WORKER:
            _WORKER[path] = Efficiency(path)
        efficiency = _WORKER[path]
        for ids, texts in in_slices(batches):
            base = [base_spans(t) for t in texts]
            extra = [efficiency.spans(t) for t in texts]
            counts = [[sum(k == kind for _, k, _ in spans) for spans in base] for kind in range(3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([sha256(joined(b).encode()).hexdigest() for b in base], pa.string()),
                 pa.array([joined(b + e) for b, e in zip(base, extra)], pa.string()),
                 pa.array(list(map(len, extra)), pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return id_and_text(docs, id_col, text_col).mapInArrow(scanned, SCHEMA)
