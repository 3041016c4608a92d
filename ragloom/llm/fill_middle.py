r"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put together anew for training.

A text is cut into tokens: white space with the word after it, or white space at the end. Two cuts and the form are drawn from a hash of the document's id, so a rerun gives the
same rows. ``spm`` puts the suffix first, ``psm`` the prefix; ``plain`` leaves the text as it is.

The cuts of all rows of an Arrow batch are made together, on its UTF-8 buffer: a table of byte classes says which bytes are white space, a mask over adjacent bytes marks where a
token begins, its running sum, reset at each document, numbers the tokens, and a binary search in that sum finds the bytes of both cuts of every row. The outputs are gathered from
the same buffer. Batches are handled in slices of ``SLICE`` bytes, so memory is bounded by it or by the longest text; no row is decoded.

Edge cases: a null text is empty, and an empty one plain with 0 tokens; a text that holds a mark is plain, so that every output can be read back; a null id is hashed as the empty string;
rows with the same id have the same draws; repeated rows are kept; an empty table gives an empty result; texts of any length are cut whole. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = ("plain", "psm", "spm")
#: Bytes of text handled at a time.
SLICE = 8 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[ord(m[1]) for m in (PREFIX, SUFFIX, MIDDLE)]] = True
_MARKS = np.frombuffer((PREFIX + SUFFIX + MIDDLE).encode(), dtype=np.uint8)
RESULT = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"


def draws(doc_id: Column, seed: int = 42) -> list[Column]:
    """Four numbers under 2^32: the first four groups of eight digits of the SHA-256 of seed, colon and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def running(mask: np.ndarray) -> np.ndarray:
    """How many are set before each place, and at the end in all."""
    out = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def gathered(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces of ``source``, one after the other."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return source[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]


def spliced(texts: pa.StringArray, h: list[np.ndarray], rate: int = 50, spm_rate: int = 80) -> pa.StructArray:
    """Token count, form, lengths of prefix and middle, and output of every text; ``h`` are the four draws, the rates are percentages."""
    rows = len(texts)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + rows + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8)[ends[0] : ends[-1]] if buffer is not None else np.zeros(0, dtype=np.uint8)
    ends -= ends[0]
    first, stop = ends[:-1], ends[1:]
    filled = stop > first

    blank = _BLANK[data]
    begins = np.zeros(len(data), dtype=bool)
    begins[1:] = blank[1:] & ~blank[:-1]
    begins[first[filled]] = True
    tokens = running(begins)
    n = tokens[stop] - tokens[first]

    def cut(after: np.ndarray) -> np.ndarray:
        """The byte at which each row's first ``after`` tokens end."""
        at = np.searchsorted(tokens, tokens[first] + after + 1) - 1
        return np.where(after < n, at, stop)

    one, two = h[0] % (n + 1), h[1] % (n + 1)
    low, high = cut(np.minimum(one, two)), cut(np.maximum(one, two))
    del begins, blank, tokens

    marked = np.flatnonzero((data[:-2] == ord("<")) & _LETTERS[data[1:-1]] & (data[2:] == ord(">"))) if len(data) > 2 else np.zeros(0, dtype=np.int64)
    owner = np.searchsorted(ends, marked, side="right") - 1
    holds = np.zeros(rows, dtype=bool)
    holds[owner[marked + 3 <= ends[owner + 1]]] = True
    plain = ~filled | holds | (h[2] % 100 >= rate)
    spm = ~plain & (h[3] % 100 < spm_rate)
    psm = ~plain & ~spm

    points = running((data & 0xC0) != 0x80)
    prefix_chars, middle_chars = points[low] - points[first], points[high] - points[low]
    del points

    # Six pieces a row: a mark and a part, three times. A plain text is the first part, all others are empty.
    source = np.concatenate((data, _MARKS))
    mark = len(data) + 3 * np.arange(3)
    starts = np.empty((rows, 6), dtype=np.int64)
    lengths = np.empty((rows, 6), dtype=np.int64)
    starts[:, 0], starts[:, 2], starts[:, 4] = np.where(spm, mark[1], mark[0]), np.where(spm, mark[0], mark[1]), mark[2]
    lengths[:, ::2] = np.where(plain, 0, 3)[:, None]
    starts[:, 1], lengths[:, 1] = np.where(spm, high, first), np.where(plain, stop - first, np.where(spm, stop - high, low - first))
    starts[:, 3], lengths[:, 3] = np.where(spm, first, high), np.where(plain, 0, np.where(spm, low - first, stop - high))
    starts[:, 5], lengths[:, 5] = low, np.where(plain, 0, high - low)
    made = gathered(source, starts.ravel(), lengths.ravel())
    offsets = np.concatenate(([0], np.cumsum(lengths.sum(axis=1)))).astype(np.int32)
    output = pa.StringArray.from_buffers(rows, pa.py_buffer(offsets), pa.py_buffer(made))
    form = pa.array(FORMS).take(pa.array(psm * 1 + spm * 2))
    numbers = [pa.array(n), form, pa.array(prefix_chars, mask=plain), pa.array(middle_chars, mask=plain), output]
    return pa.StructArray.from_arrays(numbers, names=["n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE) -> DataFrame:
    """The id, ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``: a row for each row of ``docs``."""

    @F.arrow_udf(RESULT)
    def splice(texts: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        h = [x.to_numpy() for x in (a, b, c, d)]
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        parts, at = [], 0
        while at < len(texts) or not parts:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + slice_bytes, side="right")) - 1)
            parts.append(spliced(texts[at:to], [x[at:to] for x in h], rate, spm_rate))
            at = to
        return pa.concat_arrays(parts)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(id_col, splice(text, *draws(F.col(id_col), seed)).alias("x")).select(id_col, "x.*")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    get = lambda k: F.get(part, F.lit(k))
    return F.when(form == "psm", F.concat(get(1), get(3), get(2))).when(form == "spm", F.concat(get(2), get(3), get(1))).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """``transform`` with digests in place of the outputs and of the texts read back from them."""
    back = restored(F.col("output"), F.col("form"))
    made = transform(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
