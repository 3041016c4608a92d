"""Packing token sequences by minimum bin slack.

A document's ids (and a final id) are cut at multiples of the window, which fill windows whole; the rest, shorter than a window, is one piece.
How the rests are packed depends only on how many there are of each length, a table of at most ``window`` rows. From it
the plan is made: for the longest length left, a bitset dynamic programme over the
lengths still in stock finds the multiset that fills the window closest to capacity, backtracking gives the count of each length in it, and that pattern
is used as often as the stock allows. Each use takes one length's stock to less than the pattern needs, so the plan has
some thousands of patterns however many documents there are.

Spark then ranks the pieces of each length (range-partitioned, so that a length that a third of all pieces share is
spread over tasks) and each piece looks up its pattern, sequence and offset from its length and rank.

A sequence is padded to the window, except where its length is a power of two; of fills with some padding
the plan prefers one at a power of two.

Edge cases: a null text is empty, and an empty text is its final id alone; repeated rows are documents of
their own; a null doc_id is kept; an empty table gives an empty result. Only doc_id and text are read. Texts of any length are encoded whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.operators.ranks import ranked
from ragloom.session import cut

WINDOW = 2048
END_ID = 1
#: Words whose ids a Python worker keeps; beyond it, those met once are forgotten, which costs time only.
WORD_STORE = 600_000


class WordEncoder:
    """Encodes texts by their white-space-separated words, each once.

    The tokenizer drops white space and none of its tokens spans it, so the ids of a text are those of its words in order.
    It also lower-cases, and always parts a letter from a full stop or comma after it, so a word with either at its end has the ids of the
    bare word and of the mark.
    """

    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads cost more than they bring
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.once: set[bytes] = set()  # words that only one group of texts has had

    def _learn(self, words: list[bytes]) -> None:
        """Add words to the store. Those of letters alone are one token run each, which ends with a word-end token, so many are encoded as one text."""
        letters, others = [], []
        for w in words:
            (letters if w.isalpha() or not w.isascii() and w.decode("utf-8", "replace").isalpha() else others).append(w)
        runs = [letters[low : low + 500] for low in range(0, len(letters), 500)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([b" ".join(run).decode("utf-8", "replace") for run in runs], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            stops = (4 * (np.flatnonzero(self.word_end[ids]) + 1)).tolist()
            if len(stops) != len(run):  # some letter falls apart when lower-cased
                others += run
                continue
            data = ids.tobytes()
            self.words.update(zip(run, map(data.__getitem__, map(slice, [0, *stops[:-1]], stops))))
        for low in range(0, len(others), 10_000):
            part = others[low : low + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)):
                self.words[w] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [t.split() for t in texts]
        if len(self.words) > WORD_STORE:
            for w in self.once:
                del self.words[w]
            self.once.clear()
            if 2 * len(self.words) > WORD_STORE:
                self.words.clear()
        here, known = set().union(*split), self.words
        self.once.difference_update(here)
        new = here.difference(known)
        marked = {w: (w[:-1].lower(), w[-1:]) for w in new if w.isascii() and w[-1:] in (b".", b",") and w[-2:-1].isalpha()}
        plain = new.difference(marked)
        plain.update(x for pair in marked.values() for x in pair if x not in known)
        self._learn(list(plain))
        for w, (word, mark) in marked.items():
            known[w] = known[word] + known[mark]
        self.once.update(new, plain)
        return [b"".join([known[w] for w in words]) for words in split]


_encoders: dict[str, WordEncoder] = {}


def encoder_of(tokenizer_json: str) -> WordEncoder:
    """One encoder for each Python worker, which outlives its tasks."""
    if tokenizer_json not in _encoders:
        _encoders.clear()
        _encoders[tokenizer_json] = WordEncoder(tokenizer_json)
    return _encoders[tokenizer_json]


def _groups(texts: pa.Array, most: int = 2_000_000) -> Iterator[list[bytes]]:
    """The texts in lists of about ``most`` bytes."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py() or b"")
        size += len(held[-1])
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, a row for each piece; ``ids`` too if wanted."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size is fixed
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    last = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer.value)
        for batch in batches:
            rows, starts, lengths, sums, totals, ids = [], [], [], [], [], []
            encoded = (ids_of for group in _groups(batch.column(1)) for ids_of in encoder.encode(group))
            for row, data in enumerate(encoded):
                data += last
                n = len(data) // 4
                for start in range(0, n, window):
                    part = data[4 * start : 4 * (start + window)]
                    rows.append(row)
                    starts.append(start)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    totals.append(n)
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {doc_type}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(encode, schema)


def best_fill(stock: list[tuple[int, int]], room: int, fits: list[int]) -> dict[int, int]:
    """Counts of the lengths that fill ``room`` best, from ``stock`` (length, count).

    ``fits`` are the sums that need no padding, best first; without any of them, the largest sum is best.
    """
    reach, steps, limit = 1, [], (1 << (room + 1)) - 1
    for length, count in stock:
        if length > room:
            continue
        left, take = min(count, room // length), 1
        while left:
            take = min(take, left)
            grown = (reach | reach << (length * take)) & limit
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total = next((s for s in fits if reach >> s & 1), reach.bit_length() - 1)
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (times used, [(length, count in one window)]), the longest piece first; they use up ``counts``."""
    stock = {k: n for k, n in counts.items() if n > 0}
    powers = [1 << k for k in range(window.bit_length(), -1, -1) if 1 << k <= window]
    patterns = []
    while stock:
        longest = max(stock)
        rest = dict(stock)
        rest[longest] -= 1
        # Long pieces first: short ones fit nearly anywhere and are left for later gaps.
        order = sorted(((k, n) for k, n in rest.items() if n > 0), reverse=True)
        fits = [window - longest] + [p - longest for p in powers if p >= longest and p != window]
        used = best_fill(order, window - longest, fits)
        used[longest] = used.get(longest, 0) + 1
        times = min(stock[k] // n for k, n in used.items())
        for k, n in used.items():
            stock[k] -= times * n
            if not stock[k]:
                del stock[k]
        patterns.append((times, sorted(used.items(), reverse=True)))
    return patterns


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each length, in order of rank: from which rank on which sequence and offset are filled."""
    rows, taken, sequence = [], {}, 0
    for times, used in patterns:
        offset = 0
        for length, n in used:
            first = taken.get(length, 0)
            rows.append((length, first, n, sequence, offset))
            taken[length] = first + n * times
            offset += n * length
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), table.T))


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    rows = cut(pieces(docs, tokenizer_path, window, end_id, with_ids))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``window`` rows
    table = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, window)))

    @F.arrow_udf("sequence long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        s = table.value
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False) - 1
        begin, end = np.searchsorted(s["length"], n, "left"), np.searchsorted(s["length"], n, "right")
        width = 1 << 42  # more than any rank
        at = np.searchsorted(s["length"] * width + s["first"], n * width + r, "right") - 1
        assert ((begin <= at) & (at < end)).all()
        use, nth = np.divmod(r - s["first"][at], s["each"][at])
        return pa.StructArray.from_arrays([pa.array(s["sequence"][at] + use), pa.array(s["offset"][at] + nth * n)], names=["sequence", "offset"])

    placed = ranked(rows, "length", [F.col("doc_id").asc_nulls_first(), F.col("start").asc()]).withColumn("x", place("length", "rank"))
    more = ["ids"] if with_ids else []
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("x.sequence").alias("sequence_id"), F.col("x.offset").alias("offset"), *more)


def padding(total: int, window: int = WINDOW) -> int:
    """Padding tokens of a sequence of ``total`` tokens."""
    return 0 if total & (total - 1) == 0 else window - total
