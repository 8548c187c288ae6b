"""Secret scans: an Aho-Corasick automaton finds keywords, anchored patterns run only at its hits, checksums decide.

Runs of hex digits have no keyword, so a pattern of their own finds them. A token whose format carries a checksum (a CRC-32 in
base 62 in its last six characters) counts only if that checksum is right.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Kinds in the order in which spans of the same start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm", "pem")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum_holds(body: str) -> bool:
    """Whether the last six of the characters are the base-62 CRC-32 of those before."""
    n, digits = zlib.crc32(body[:-6].encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        digits = _BASE62[r] + digits
    return digits == body[-6:]


#: kind: keywords in lower case, the pattern that is tried at a keyword, and whether a match counts.
RULES = {
    "assign": (
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
        lambda m: len(m[2]) >= 8,
    ),
    "access": (("akia",), re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "github": (tuple(f"gh{x}_" for x in "pousr"), re.compile("gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), lambda m: checksum_holds(m[1])),
    "npm": (("npm_",), re.compile("npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), lambda m: checksum_holds(m[1])),
    "pem": (("-----begin ",), re.compile(r"-----BEGIN ([A-Z ]{0,40}PRIVATE KEY)-----[A-Za-z0-9+/=\s]+-----END \1-----"), lambda m: True),
}
_HEX = re.compile("[0-9a-f]{32,}")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, (words, _, _) in RULES.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


_KEYWORDS = _automaton()


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start, then kind; of one kind they don't overlap, and a match that doesn't
    count still takes its characters, as in a leftmost search."""
    found, after = [], dict.fromkeys(RULES, 0)
    starts = [(end + 1 - n, kind) for end, (kind, n) in _KEYWORDS.iter(text.encode().lower().decode())]
    for start, kind in sorted(starts):
        _, pattern, counts = RULES[kind]
        if start >= after[kind] and (m := pattern.match(text, start)):
            after[kind] = m.end()
            if counts(m):
                found.append((kind, start, m.end()))
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        spans = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_secrets(t or "")] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPANS)], ["doc_id", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans (an array of kind, start, end) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Whole texts are scanned, of any length; a null text counts as empty and has no spans; rows that repeat an id give a row
    each; an empty table gives an empty result. Nothing is shuffled."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", SPANS)]))


def masked(text: str, mask: str) -> str:
    """The text with every span, overlapping ones as one, replaced."""
    out, at, end = [], 0, -1
    for _, start, stop in find_secrets(text):
        if start >= end:
            out += [text[at:start], mask]
            at = end = stop
        else:
            at = end = max(end, stop)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with the same rows and columns, secrets in ``text`` replaced by the mask, and n_chars, where there is such a column
    and the text has changed, the new length. Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            i, texts = batch.schema.get_field_index("text"), batch.column("text").to_pylist()
            new = [t if t is None else masked(t, mask) for t in texts]
            batch = batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))
            if (k := batch.schema.get_field_index("n_chars")) >= 0:
                n = [old if a == b else len(b) for old, a, b in zip(batch.column(k).to_pylist(), texts, new, strict=True)]
                batch = batch.set_column(k, batch.schema.field(k), pa.array(n, batch.schema.field(k).type))
            yield batch

    common.small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
