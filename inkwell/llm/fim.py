"""Fill-in-middle transformation: texts are cut at two code points and put together in another order.

Cuts are found by rank and select on a packed bitvector.  A batch of texts is one run of UTF-8 bytes, with a bit for each
byte that starts a code point.  The bits are packed into 64-bit words, and a directory holds the number of ones before each
block of 8 words.  The ones of a text, the difference of two ranks, are its number of code points n; where code point k of
a text starts is the select of the text's own rank plus k.  So a text is cut as bytes and never decoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_bytes

#: Marks of prefix, suffix and middle; a text that holds one of them is left as it is.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are transformed, and of these, those with the suffix first.
RATE, SPM = 90, 20
#: Words in a block of the directory.
BLOCK = 8
_BIT = np.arange(64, dtype=np.uint64)


class Bits:
    """A packed bitvector with the number of ones before each block of BLOCK words."""

    def __init__(self, flags: np.ndarray):
        words = max(1, -(-len(flags) // 64))
        words = -(-words // BLOCK) * BLOCK
        packed = np.zeros(words * 8, np.uint8)
        bits = np.packbits(flags, bitorder="little")
        packed[: len(bits)] = bits
        self.size = len(flags)
        self.words = packed.view("<u8")
        self.counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(self.counts.reshape(-1, BLOCK).sum(1))])

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position (0 to size)."""
        block = np.minimum(at // (64 * BLOCK), len(self.before) - 2)
        out = self.before[block]
        word = at // 64
        for i in range(BLOCK):
            here = block * BLOCK + i
            out = out + np.where(here < word, self.counts[here], 0)
        inside = at % 64
        last = np.minimum(word, len(self.words) - 1)
        below = np.where(inside > 0, (np.uint64(1) << inside.astype(np.uint64)) - np.uint64(1), np.uint64(0))
        # A position at the end of a block's last word lies past all its words.
        partial = np.where(word < len(self.words), np.bitwise_count(self.words[last] & below), 0)
        return out + partial.astype(np.int64)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Position of the one with so many ones before it; ``size`` for those past the last."""
        found = nth < self.total
        rest = np.where(found, nth, 0)
        block = np.searchsorted(self.before, rest, side="right") - 1
        block = np.minimum(block, len(self.before) - 2)
        rest = rest - self.before[block]
        word = block * BLOCK
        for _ in range(BLOCK - 1):
            skip = (rest >= self.counts[word]) & (word < block * BLOCK + BLOCK - 1)
            rest = rest - np.where(skip, self.counts[word], 0)
            word = word + skip
        # Within the word: halve the span that holds the bit, by the number of ones in its lower half.
        value, at, left = self.words[word], np.zeros(len(nth), np.int64), rest
        for width in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count((value >> at.astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)
            up = left >= low
            left = left - np.where(up, low, 0)
            at = at + np.where(up, width, 0)
        return np.where(found, word * 64 + at, self.size)


@dataclass(frozen=True)
class Draw:
    """The numbers drawn for each key: four unsigned 32-bit integers from the digest of ``seed:key``."""

    h: np.ndarray

    @classmethod
    def of(cls, keys: list, seed: str) -> Draw:
        digests = b"".join(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).digest()[:16] for k in keys)
        return cls(np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64))

    def cuts(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = self.h[:, 0] % (n + 1), self.h[:, 1] % (n + 1)
        return np.minimum(one, two), np.maximum(one, two)


def transform(texts: pa.Array, draw: Draw, rate: int, spm: int) -> pa.RecordBatch:
    """n, form, prefix_chars, middle_chars and output of each text."""
    raw, offsets = text_bytes(texts)
    bits = Bits((raw & 0xC0) != 0x80)
    ranks = bits.rank(offsets)
    n = np.diff(ranks)
    first, second = draw.cuts(n)
    # A cut at the very end of a text is the start of the next one's bytes.
    a = np.where(first < n, bits.select(ranks[:-1] + first), offsets[1:])
    b = np.where(second < n, bits.select(ranks[:-1] + second), offsets[1:])
    whole = raw.tobytes()
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    rows = len(n)
    plain = (n == 0) | (draw.h[:, 2] % 100 >= rate)
    suffix_first = draw.h[:, 3] % 100 < spm
    forms, outputs = [], []
    for i in range(rows):
        begin, end = int(offsets[i]), int(offsets[i + 1])
        own = whole[begin:end]
        if plain[i] or any(m in own for m in marks):
            plain[i] = True
            forms.append("plain")
            outputs.append(own)
            continue
        x, y = int(a[i]) - begin, int(b[i]) - begin
        prefix, middle, suffix = own[:x], own[x:y], own[y:]
        forms.append("spm" if suffix_first[i] else "psm")
        parts = (marks[1], suffix, marks[0], prefix) if suffix_first[i] else (marks[0], prefix, marks[1], suffix)
        outputs.append(b"".join((*parts, marks[2], middle)))
    cut = lambda x: pa.array(x, pa.int64(), mask=plain)
    return pa.RecordBatch.from_arrays([pa.array(n), pa.array(forms), cut(first), cut(second - first), pa.array(outputs, pa.binary()).cast(pa.string())], names=["n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: str = "1", rate: int = RATE, spm: int = SPM) -> DataFrame:
    """key, n (code points), form (plain, psm or spm), prefix_chars, middle_chars and output for every row; no shuffle.

    What happens to a text depends on its key and itself only, so repeated rows come out alike.  A null text counts as
    empty, and an empty one stays as it is, as does one that holds a mark.  A null key draws as an empty one.  A text of
    any length is cut whole.  An empty table gives no rows, and other columns are not looked at.
    """
    kind = docs.schema[key].dataType.simpleString()
    columns = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            made = transform(batch.column(text), Draw.of(batch.column(key).to_pylist(), seed), rate, spm)
            yield pa.RecordBatch.from_arrays([batch.column(key), *made.columns], names=[key, *columns])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from.  No text that was cut holds a mark, so the marks part it."""
    parts = F.split(output, "<[PSM]>")
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM texts
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
