"""Fill-in-middle by succinct rank and select over the bytes of whole texts.

Texts of an Arrow batch lie end to end as UTF-8 bytes. Two bitvectors are packed over them, one bit a byte: line ends, and
first bytes of code points. A directory holds the popcount before each block of 512 bits. The difference of two ranks of the
first vector is n, the number of lines of a text; select of two ranks gives the bytes at which it is cut; ranks of the second
vector turn bytes into code points. All texts of a batch are looked up at once, and nothing is split line by line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import binary_parts, read

# The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are cut, and of those the percent in the order suffix, prefix, middle.
RATE, SPM_RATE, SEED = 100, 50, 7
#: Texts are worked on in runs of so many bytes at least (a longer text is a run of its own).
RUN_BYTES = 8 << 20


class Bits:
    """A packed bitvector with a popcount directory: rank and select of many places at once."""

    WORDS = 8  # words of 64 bits in a block

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        words = -(-self.n // 64) // self.WORDS * self.WORDS + self.WORDS
        self.words = np.concatenate([packed, np.zeros(words * 8 - len(packed), np.uint8)]).view(np.uint64)
        counts = np.bitwise_count(self.words).reshape(-1, self.WORDS).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place (0 to n)."""
        word, block = at >> 6, (at >> 6) // self.WORDS
        inside = self.words.reshape(-1, self.WORDS)[block]
        below = np.arange(self.WORDS) < (word % self.WORDS)[:, None]
        whole = (np.bitwise_count(inside) * below).sum(1, dtype=np.int64)
        last = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + whole + np.bitwise_count(last).astype(np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one, from 1; there must be as many."""
        block = np.searchsorted(self.before, k, "left") - 1
        left = k - self.before[block]
        counts = np.cumsum(np.bitwise_count(self.words.reshape(-1, self.WORDS)[block]), 1, dtype=np.int64)
        inside = (counts < left[:, None]).sum(1)
        left = left - np.where(inside, np.take_along_axis(counts, np.maximum(inside - 1, 0)[:, None], 1)[:, 0], 0)
        word = self.words[block * self.WORDS + inside]
        bits = np.unpackbits(word.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return (block * self.WORDS + inside) * 64 + (np.cumsum(bits, 1) < left[:, None]).sum(1)


def _rolls(ids: list[int | None], seed: int) -> np.ndarray:
    """h1 to h4 of each id: the first four groups of 8 hex digits of sha256 of seed:id (a null id is the empty string)."""
    told = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(told, ">u4").reshape(-1, 4).astype(np.int64)


def transform(ids: list[int | None], column: pa.Array, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of each text."""
    data, at = binary_parts(column)
    lo, hi = at[:-1], at[1:]
    empty = hi == lo
    ends = data == 10
    ends[hi[~empty] - 1] = True  # an unfinished last line ends with its text
    lines, points = Bits(ends), Bits((data & 0xC0) != 0x80)
    first, n = lines.rank(lo), lines.rank(hi) - lines.rank(lo)
    h = _rolls(ids, seed)
    u, v = np.sort(h[:, :2] % (n + 1)[:, None], axis=1).T

    def cut(k: np.ndarray) -> np.ndarray:
        out = lo.copy()
        some = k > 0
        out[some] = lines.select((first + k)[some]) + 1
        return out

    a, b = cut(u), cut(v)
    marked = np.zeros(len(ids), bool)
    if len(data) > 2:
        # Marks are three bytes of which the middle one differs; one that runs over two texts doesn't count.
        found = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & np.isin(data[1:-1], np.frombuffer(b"PSM", np.uint8)))
        text = np.searchsorted(at, found, "right") - 1
        marked[text[found + 3 <= hi[text]]] = True
    plain = empty | marked | (h[:, 2] % 100 >= rate)
    spm = ~plain & (h[:, 3] % 100 < spm_rate)
    raw = data.tobytes()
    p, m, q = PREFIX.encode(), MIDDLE.encode(), SUFFIX.encode()

    def written(lo: int, a: int, b: int, hi: int, plain: bool, spm: bool) -> bytes:
        if plain:
            return raw[lo:hi]
        return b"".join((q, raw[b:hi], p, raw[lo:a], m, raw[a:b]) if spm else (p, raw[lo:a], q, raw[b:hi], m, raw[a:b]))

    texts = [written(*x) for x in zip(*(x.tolist() for x in (lo, a, b, hi, plain, spm)), strict=True)]
    return {
        "n": pa.array(n),
        "form": pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm"))),
        "prefix_chars": pa.array(points.rank(a) - points.rank(lo), mask=plain),
        "middle_chars": pa.array(points.rank(b) - points.rank(a), mask=plain),
        "output": pa.array(texts, pa.binary()).cast(pa.string()),
    }


_FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """docs (all its columns, of which doc_id and text are read) with n, form, prefix_chars, middle_chars and output.

    A text is cut after two of its n lines (from 0), which its doc_id draws; the last line may lack its line end. Forms: plain (the
    text as it is: empty texts, texts that hold a mark, and those beyond the rate), psm and spm. A null text counts as empty, a null
    doc_id as the empty string; a text of one very long line is cut at its start or end. Rows that share an id draw the
    same numbers; repeated rows give repeated results. An empty table gives no rows. Columns of the new names are replaced.
    """
    new = [x.split()[0] for x in _FIELDS.split(", ")]
    rest = [c for c in docs.columns if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(np.diff(binary_parts(batch.column("__text").cast(pa.binary()))[1]))
            lo = 0
            while lo < batch.num_rows:
                past = sizes[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, past + RUN_BYTES, "right")))
                part = batch.slice(lo, hi - lo)
                made = transform(part.column("__id").to_pylist(), part.column("__text").cast(pa.binary()), rate, spm_rate, seed)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *made.values()], names=[*rest, *made])
                lo = hi

    kinds = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest), _FIELDS])
    return docs.select(*rest, F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text")).mapInArrow(run, kinds)


def restored(output: Column, form: Column) -> Column:
    """The text from output and form alone. No part holds a mark, so each mark is the first of its kind."""
    prefix, suffix, middle = (F.lit(x) for x in (PREFIX, SUFFIX, MIDDLE))

    def between(start: Column, end: Column | None) -> Column:
        lo = F.instr(output, start) + 3
        return F.substring(output, lo, F.length(output) if end is None else F.instr(output, end) - lo)

    psm = F.concat(between(prefix, suffix), between(middle, None), between(suffix, middle))
    spm = F.concat(between(prefix, middle), between(middle, None), between(suffix, prefix))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into prefix, middle and suffix, and rebuilt; sha256 digests of both texts."""
    out = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    sha = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || CAST(doc_id AS VARCHAR)) AS hex FROM documents
), h AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l,
    CAST('0x' || hex[1:8] AS BIGINT) AS h1, CAST('0x' || hex[9:16] AS BIGINT) AS h2, CAST('0x' || hex[17:24] AS BIGINT) AS h3, CAST('0x' || hex[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(l[1:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle, array_to_string(l[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
