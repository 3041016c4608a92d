"""Document fingerprints by randomised edit embedding.

A walk reads a text from its first character: at each step it puts the current character out and moves on or stays,
by a random bit that depends on the step and the character alone. All texts share these bits, so two texts that differ by a few edits walk in step again
soon after each edit, and edit distance becomes Hamming distance between the walks' outputs. A whole text of n characters takes about 2n steps.

The fingerprint samples the output at ``SLOTS`` steps. Each slot has its own random priority for every step and takes the step of the best priority within the walk, so texts of
different lengths mostly sample the same steps, without a bound on the length. Each sample gives four bits of a hash of its character: a fingerprint is
``SLOTS`` hex digits, and the likeness of two is the share of equal digits.

``near_classes`` finds similar documents: bands of sampled digits are join keys, and candidates are verified on the whole fingerprints.

Edge cases: a null text is empty; an empty text's fingerprint is all zeros; equal texts have equal fingerprints; the next document of a single one is itself; null doc_ids come
first, dealt over buckets by a hash of their text and ordered by text in each, and rows with the same doc_id are ordered by text; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragloom.llm.simhash import components
from ragloom.session import cut

SLOTS = 128
SEED = 11
#: Steps after which ended walks are put aside, and for which random bits are made at a time.
STRIDE = 64
#: From so few walks on, each is finished on its own.
FEW = 40
#: Strides whose bits are kept for the walks that are finished on their own.
STORED = 4096
#: Characters walked at a time.
BATCH = 3_000_000

#: Bands of a fingerprint, and sampled digits in each: at a likeness of 0.8 some band agrees but for 1 case in 10,000.
BANDS, BAND_DIGITS = 32, 6
#: Members of a band's bucket that are compared in one group; larger buckets are compared in pairs of blocks.
BUCKET_BLOCK = 1024

_END = 64  # the class of the padding, on which a walk stays


@lru_cache(maxsize=1)
def _sampled_steps() -> dict[int, list[int]]:
    """For each step, the slots for which it has a better priority than all steps before it."""
    steps: dict[int, list[int]] = {}
    for slot in range(SLOTS):
        rng = np.random.default_rng((SEED, slot))
        at, best = 0, rng.random()
        while at < 1 << 44:
            steps.setdefault(at, []).append(slot)
            at += int(rng.geometric(max(best, 1e-14)))
            best *= rng.random()
    return steps


def _bits(low: int) -> np.ndarray:
    """For each of the ``STRIDE`` steps from ``low`` and each class of characters, whether the walk moves on."""
    with np.errstate(over="ignore"):
        z = np.arange(low + 1, low + 1 + STRIDE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    bits = np.unpackbits(z.astype("<u8").view(np.uint8).reshape(STRIDE, 8), axis=1, bitorder="little")
    return np.concatenate((bits, np.zeros((STRIDE, 1), dtype=np.uint8)), axis=1)


def samples(texts: list[str]) -> np.ndarray:
    """The sampled characters of each text's walk: a row of ``SLOTS`` code points plus one for each; 0 for none."""
    taken = np.zeros((len(texts), SLOTS), dtype=np.uint32)
    points = [np.frombuffer(t.encode("utf-32-le", "replace"), dtype="<u4") for t in texts]
    lengths = np.array([len(p) for p in points], dtype=np.int64)
    pad = np.zeros(1, dtype="<u4")
    flat = np.concatenate([x for p in points for x in (p, pad)]) if texts else pad
    ends = np.cumsum(lengths + 1) - 1
    classes = ((flat * np.uint32(2654435761)) >> np.uint32(26)).astype(np.uint8)
    classes[ends] = _END
    walk = np.flatnonzero(lengths)
    at, stop = (ends - lengths)[walk], ends[walk]
    marks, step = _sampled_steps(), 0
    marked = sorted(marks)
    nth = 0
    while len(walk) > FEW:
        bits = _bits(step)
        for row in bits:
            if marked[nth] == step:
                on = at < stop
                taken[np.ix_(walk[on], marks[step])] = (flat[at[on]] + 1)[:, None]
                nth += 1
            at += row[classes[at]]
            step += 1
        on = at < stop
        if not on.all():
            walk, at, stop = walk[on], at[on], stop[on]
    strides: list[list[bytes]] = []

    def bits_of(part: int) -> list[bytes]:
        while len(strides) <= part and len(strides) < STORED:
            strides.append([r.tobytes() for r in _bits(step + len(strides) * STRIDE)])
        return strides[part] if part < len(strides) else [r.tobytes() for r in _bits(step + part * STRIDE)]

    for doc, base, end in zip(walk.tolist(), at.tolist(), stop.tolist()):
        own, last, mark, part, i = classes[base : end + 1].tobytes(), end - base, nth, 0, 0
        while i < last:
            rows, now = bits_of(part), step + part * STRIDE
            if marked[mark] >= now + STRIDE:
                for row in rows:
                    i += row[own[i]]
            else:
                for k, row in enumerate(rows, now):
                    if marked[mark] == k:
                        if i < last:
                            taken[doc, marks[k]] = flat[base + i] + 1
                        mark += 1
                    i += row[own[i]]
            part += 1
    return taken


def prints_of(texts: list[str]) -> np.ndarray:
    """Fingerprints as rows of ``SLOTS`` digits 0 to 15."""
    taken = samples(texts)
    odd = (np.arange(SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)) * np.uint32(0x9E3779B1) | np.uint32(1)
    return np.where(taken > 0, (taken * odd[None]) >> np.uint32(28), 0).astype(np.uint8)


def digits(prints: np.ndarray) -> list[str]:
    hexes = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)[prints]
    return [row.tobytes().decode() for row in hexes]


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """``doc_id``, ``text``, ``bucket``, ``extra``: rows in order of doc_id within partitions by range of doc_id.

    Each partition also ends with a copy of the row that follows its last one (``extra`` is true); the last partition's is the very
    first row. Only bounds and one row for each bucket are looked at as a whole, so no task and no driver sees all rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    bounds = sorted(set(rows.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / buckets for i in range(1, buckets)], 0.2 / buckets)))
    limits = F.array(*[F.lit(float(b)) for b in bounds]) if bounds else F.expr("cast(array() as array<double>)")
    # Rows without an id come first, dealt by a hash of their text over as many buckets of their own as is their share.
    n, unknown = rows.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    own = -(-buckets * unknown // n) if unknown else 0
    place = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(max(own, 1)))).otherwise(own + F.size(F.filter(limits, lambda b: b <= F.col("doc_id").cast("double"))))
    placed = rows.withColumn("bucket", place.cast("int"))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"))
    firsts = placed.groupBy("bucket").agg(F.min(key).alias("key")).select(F.col("bucket").alias("b"), "key")
    heads = placed.join(F.broadcast(firsts), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("key.id")))  # a row for each bucket
    heads = heads.groupBy("bucket").agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"))
    turn = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(turn), F.max("bucket").over(Window.partitionBy()))
    extra = heads.select("doc_id", "text", before.alias("bucket"), F.lit(True).alias("extra"))
    both = placed.withColumn("extra", F.lit(False)).unionByName(extra)
    return both.repartitionById(buckets + own, F.col("bucket")).sortWithinPartitions("bucket", "extra", F.col("doc_id").asc_nulls_first(), "text")


def compare(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness, a row for each row of ``docs``."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        """Of rows in order, all but the last, each against the one after it."""
        texts = [t for _, t, _ in rows]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        prints = prints_of(texts + changed)
        own, new = prints[: len(texts)], prints[len(texts) :]
        keep = [i for i in range(len(rows) - 1) if not rows[i][2]]
        near_edited, near_next = (own[:-1] == new).mean(axis=1), (own[:-1] == own[1:]).mean(axis=1)
        columns = [
            pa.array([rows[i][0] for i in keep], doc_arrow[0]),
            pa.array([len(texts[i]) for i in keep], pa.int64()),
            pa.array([hashlib.sha256(changed[i].encode("utf-8", "replace")).hexdigest() for i in keep], pa.string()),
            pa.array(digits(own[keep]), pa.string()),
            pa.array(digits(new[keep]), pa.string()),
            pa.array(near_edited[keep], pa.float64()),
            pa.array(near_next[keep], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    doc_arrow: list = []

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            doc_arrow[:] = [batch.column(0).type]
            for row in zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1)), batch.column(2).to_pylist()):
                held.append(row)
                size += len(row[1])
                if size > BATCH and len(held) > 1:
                    yield judge(held)
                    held, size = held[-1:], len(held[-1][1])
        if len(held) > 1:
            yield judge(held)

    schema = f"doc_id {doc_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, buckets).select("doc_id", "text", "extra").mapInArrow(walk, schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint``, a row for each row of ``docs``."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        out: list[str] = []
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t.as_py() or "")
            size += len(held[-1])
            if size > BATCH:
                out += digits(prints_of(held))
                held, size = [], 0
        return pa.array(out + digits(prints_of(held)), pa.string())

    return docs.select("doc_id", of(F.col("text").cast("string")).alias("fingerprint"))


def bucket_forest(nodes: list[int], prints: list[str], blocks: list[int], most: int) -> list[tuple[int, int]]:
    """Links that span each class of a bucket: pairs that differ in at most ``most`` digits.

    Where members are of two blocks, only pairs across them count; the others are looked at elsewhere.
    """
    table = np.frombuffer("".join(prints).encode(), dtype=np.uint8).reshape(len(nodes), SLOTS)
    block = np.array(blocks)
    across = len(set(blocks)) > 1
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i in range(len(nodes) - 1):
        near = (table[i + 1 :] != table[i]).sum(axis=1) <= most
        if across:
            near &= block[i + 1 :] != block[i]
        for j in (np.flatnonzero(near) + i + 1).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                links.append((nodes[i], nodes[j]))
    return links


def near_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``doc_id``, ``class_id``: documents linked by a fingerprint likeness of ``threshold`` or more share the smallest doc_id.

    Equal fingerprints are one node. Band buckets of any size are compared whole, large ones as pairs of blocks in tasks of their own. Rows without a
    doc_id get the class of their fingerprint; it is null where none of its documents has an id.
    """
    most = int(np.floor((1 - threshold) * SLOTS + 1e-9))
    rng = np.random.default_rng(SEED)
    sampled = np.array([rng.choice(SLOTS, BAND_DIGITS, replace=False) for _ in range(BANDS)])

    @F.arrow_udf("array<long>")
    def bands(prints: pa.Array) -> pa.Array:
        if not len(prints):
            return pa.array([], pa.list_(pa.int64()))
        table = np.array([[int(c, 16) for c in p] for p in prints.to_pylist()], dtype=np.int64)
        keys = (table[:, sampled] << (4 * np.arange(BAND_DIGITS))).sum(axis=2) + (np.arange(BANDS, dtype=np.int64) << (4 * BAND_DIGITS))
        return pa.array(keys.tolist(), pa.list_(pa.int64()))

    def compare_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for members in batch.column(0).to_pylist():
                members.sort(key=lambda m: m["node"])
                found += bucket_forest([m["node"] for m in members], [m["fingerprint"] for m in members], [m["block"] for m in members], most)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    prints = cut(fingerprints(docs))
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").cast("long").alias("node"))
    keyed = cut(nodes.where("node is not null").select("node", "fingerprint", F.explode(bands("fingerprint")).alias("key")))
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    split = F.ceil(F.col("n") / BUCKET_BLOCK)
    dealt = keyed.join(large, "key").withColumn("block", F.pmod(F.xxhash64("node"), split)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), split - 1)))
    groups = dealt.groupBy("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).agg(F.collect_list(F.struct("node", "fingerprint", "block")).alias("members"))
    links = groups.where(F.size("members") > 1).select("members").mapInArrow(compare_buckets, "a long, b long").distinct()
    roots = components(links).withColumnRenamed("node", "n")
    named = nodes.join(roots, nodes["node"] == roots["n"], "left").select("fingerprint", F.coalesce("root", "node").alias("class_id"))
    return prints.join(named, "fingerprint").select("doc_id", "class_id")
