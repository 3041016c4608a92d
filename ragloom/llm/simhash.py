"""SimHash near-duplicate detection with BK-trees.

Fingerprints are 64-bit SimHashes of word shingles. Two fingerprints are linked when they differ
in at most ``radius`` bits; components of links are the near-duplicate classes.

Candidate search: the 64 bits are cut into ``BLOCKS`` equal blocks. Two fingerprints that differ in at
most two bits agree on at least ``BLOCKS - 2`` blocks, so every link lies inside a group of
fingerprints with the same ``BLOCKS - 2`` blocks. Each such group is one shard: it becomes one BK-tree,
and each member is looked up in it along the edges within the radius only. A shard leaves 16 bits
free, so it never holds more than 65,536 distinct fingerprints whatever the data: that is the proven
bound on a tree. Trees travel to their members through the shuffle; a driver-side broadcast
of all of them would grow with the corpus. A shard emits a spanning forest of its links, not its pairs.

Edge cases: a null or empty text has no shingle and fingerprint zero, and links like any other
fingerprint. Repeated rows and equal texts share a fingerprint and a component. Rows with a null
doc_id take part; a component of such rows alone has a null component_id. An empty table gives an
empty result. Other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.session import cut, fresh, release

BLOCKS = 8
SEED = 42
MASK = (1 << 64) - 1
#: Shingles hashed at a time, so that a very long text needs bounded memory.
CHUNK = 1 << 16

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_POS = (np.arange(8, dtype=np.int64) * 256)[None, :]


def shingle_hashes(text: bytes, words_per_shingle: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a UTF-8 text, repeats included, a chunk at a time; of fewer words, that of them all."""
    words = text.lower().split()  # on bytes: A-Z only, and exactly the ASCII white space
    n = max(1, len(words) - words_per_shingle + 1) if words else 0
    hashes = xxhash.xxh64_intdigest
    for low in range(0, n, CHUNK):
        high = min(n, low + CHUNK)
        part = words[low : high + words_per_shingle - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = np.concatenate(([0], ends))[: high - low].tolist()
        stops = (ends[min(words_per_shingle, len(part)) - 1 :][: high - low] - 1).tolist()
        yield np.array([hashes(joined[a:b], seed) for a, b in zip(starts, stops)], dtype="<u8")


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _BYTE_POS).ravel(), minlength=2048)
    return (counts.reshape(8, 256) @ _BYTE_BITS).ravel()


def _majority(ones: np.ndarray, n: int) -> int:
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist()))


def simhash_bytes(text: bytes, words_per_shingle: int = 3, seed: int = SEED) -> int:
    """The 64-bit SimHash of a UTF-8 text, as an unsigned integer; zero without words."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, words_per_shingle, seed):
        ones += _ones(h)
        n += len(h)
    return _majority(ones, n)


def _as_long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """``doc_id`` and its fingerprint ``fp`` (the 64 bits as a signed long), a row for each row."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.binary())
        return pa.array([_as_long(simhash_bytes(x.as_py() or b"", words_per_shingle)) for x in raw], pa.int64())

    return docs.select(F.col(id_col).alias("doc_id"), simhash(F.col(text_col).cast("string")).alias("fp"))


def shard_masks(blocks: int = BLOCKS, free: int = 2) -> list[int]:
    """A mask for each way to leave ``free`` of the blocks out."""
    width = 64 // blocks
    whole = (1 << width) - 1
    return [sum(whole << (width * b) for b in range(blocks) if b not in out) for out in combinations(range(blocks), free)]


class BKTree:
    """Distinct integers; a node's children are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        node = 0
        while node != new:
            d = (self.values[node] ^ value).bit_count()
            node = self.children[node].setdefault(d, new)
        return new

    def within(self, value: int, radius: int) -> Iterator[int]:
        """The nodes at most ``radius`` away: only edges within the radius of the distance are followed."""
        stack = [0] if self.values else []
        while stack:
            node = stack.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                yield node
            for edge, child in self.children[node].items():
                if -radius <= edge - d <= radius:
                    stack.append(child)


def shard_forest(members: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that span each class of one shard."""
    tree, parent, links = BKTree(), [], []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for value in members:
        near = list(tree.within(value, radius))
        new = tree.add(value)
        parent.append(new)
        for other in near:
            a, b = root(other), root(new)
            if a != b:
                parent[b] = a
                links.append((tree.values[other], value))
    return links


def fingerprint_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """``a``, ``b``: a spanning set of the links among the distinct fingerprints in column ``fp``."""
    if not 0 <= radius <= 2:
        raise ValueError("shards hold every link of a radius of up to 2")
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_as_long(m))).alias("k")) for i, m in enumerate(shard_masks())])
    # A fixed number of partitions: each row becomes many, which size-based coalescing of the input does not foresee.
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    shards = (
        spread.select("fp", F.explode(keys).alias("s"))
        .groupBy("s.i", "s.k")
        .agg(F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1)
        .select("members")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Trees compare unsigned integers: of a negative one, bit_count would count the bits of its absolute value.
            found = [x for members in batch.column(0) for x in shard_forest(sorted(m & MASK for m in members.as_py()), radius)]
            ends = [pa.array([_as_long(x[i]) for x in found], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])

    return shards.mapInArrow(search, "a long, b long").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``root``: the smallest node of each linked node's component.

    Alternating large-star and small-star rounds on the links, each cut by a checkpoint; the driver sees two
    numbers a round. Minima are pre-aggregated before the shuffle, so a hub is no hot key.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        moved = joined.where(F.col("v") > F.col("u")) if large else joined
        out = moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    pairs = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(pairs)
    for _ in range(max_rounds if before[0] else 0):
        pairs = cut(star(star(pairs, True), False))
        now = mark(pairs)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("the components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """``fp``, ``component_id``, a row for each distinct fingerprint."""
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(fingerprint_links(first.select("fp"), radius))
    named = first.join(roots, first["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 2, words_per_shingle: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``: a row for each row of ``docs``."""
    prints = cut(fingerprints(docs, words_per_shingle=words_per_shingle))
    return prints.join(_classes(prints, radius), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# Near copies by similarity: fingerprints find the candidates, the shingle sets decide.

#: Shards that a document joins, and least shingle hashes (each under an order of its own) that the key of one is made of. Documents with a similarity of 0.8
#: share a key with a chance of 0.512, so they share none in one case of 400,000; at a similarity of 0.2, as from a common passage, they meet in one shard of 125.
TABLES, ROWS = 18, 3
#: 64-bit words of a near-copy fingerprint.
WORDS = 4
#: Bits of 256 in which the fingerprints of documents with a similarity of 0.8 may differ. A bit differs with a chance of 0.152 for large sets and of 0.1875 at
#: most (four of five shingles shared), so a pair is missed once in 3e10 times for large sets and once in 1.8 million times at worst.
COPY_RADIUS = 80
#: Members of a shard that are compared in one task; larger shards are compared as pairs of blocks in tasks of their own.
SHARD_BLOCK = 2048
#: Candidate pairs for each member up to which a group gives out its pairs, to be decided one by one; of a group with more, the members meet with their shingle sets.
PAIRS_EACH = 4
#: Members of a shard's tree up to which it is walked for one member at a time.
TREE_ROWS = 128
#: Texts that are signed at a time.
SIGNED = 256

_ODD = np.random.default_rng(SEED).integers(1, 1 << 63, TABLES * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FP = [f"f{i}" for i in range(WORDS)]


_RANDOM = np.random.default_rng(SEED)
#: A number for each byte, A-Z as a-z, and powers of an odd number and of its inverse: a word's hash is a sum over its bytes, found from running sums over a whole text.
_BYTE_VALUE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_VALUE[np.arange(ord("A"), ord("Z") + 1)] = _BYTE_VALUE[np.arange(ord("a"), ord("z") + 1)]
_IS_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_BASE = 0x9E3779B97F4A7C15
#: Bytes of which the running sums are made at a time.
SPAN = 1 << 20


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base & MASK, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word of a text, whatever the case of A-Z; words are runs of other bytes than ASCII white space."""
    data = np.frombuffer(text, dtype=np.uint8)
    found = []
    low = 0
    while low < len(data):
        high = min(len(data), low + SPAN)
        if high < len(data):  # cut after white space, or else take the word in whole
            spaces = np.flatnonzero(_IS_SPACE[data[low:high]])
            while not len(spaces) and high < len(data):
                high = min(len(data), high + SPAN)
                spaces = np.flatnonzero(_IS_SPACE[data[low:high]])
            if high < len(data):
                high = low + int(spaces[-1]) + 1
        part = data[low:high]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], _IS_SPACE[part], [True]))))
        starts, ends = edges[::2], edges[1::2]
        with np.errstate(over="ignore"):
            up, down = (_UP, _DOWN) if len(part) <= SPAN else (_powers(_BASE, len(part) + 1), _powers(pow(_BASE, -1, 1 << 64), len(part) + 1))
            sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE_VALUE[part] * up[: len(part)])))
            found.append(_mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        low = high
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, SPAN + 1), _powers(pow(_BASE, -1, 1 << 64), SPAN + 1)


def shingles_of(words: np.ndarray, words_per_shingle: int) -> np.ndarray:
    """The shingle that starts at each word, folded from the words' hashes; the last ones run over the end."""
    found = np.full(len(words), words_per_shingle, dtype=np.uint64)
    padded = np.concatenate((words, np.zeros(words_per_shingle, dtype=np.uint64)))
    with np.errstate(over="ignore"):
        for k in range(words_per_shingle):
            found = _mixed(found + padded[k : k + len(words)])
    return found


def shingle_sets(texts: list[bytes], words_per_shingle: int) -> list[np.ndarray]:
    """The hashes of the distinct shingles of each text, in order; of fewer words, that of them all."""
    out: list[np.ndarray] = []
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) <= SPAN):
            size += len(texts[high])
            high += 1
        some = texts[low:high]
        words = word_hashes(b"\n".join(some))
        counts = [len(t.split()) for t in some] if len(some) > 1 else [len(words)]
        shingles = shingles_of(words, words_per_shingle)
        at = 0
        for n in counts:
            if n < words_per_shingle:
                found = shingles_of(words[at : at + n], n)[:1] if n else words[:0]
            else:
                found = np.sort(shingles[at : at + n - words_per_shingle + 1])
                found = found[np.concatenate(([True], found[1:] != found[:-1]))]
            out.append(found)
            at += n
        low = high
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For sets of shingle hashes, none of them empty: ``WORDS`` words of fingerprint and ``TABLES`` shard keys each, as rows of signed longs."""
    sizes = np.array([len(s) for s in sets])
    h, starts, owner = np.concatenate(sets), np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sets)), sizes)
    prints = np.zeros((len(sets), WORDS), dtype=np.int64)
    with np.errstate(over="ignore"):
        for w in range(WORDS):
            counts = np.zeros(len(sets) * 2048, dtype=np.int64)
            for low in range(0, len(h), CHUNK):
                part = _mixed(h[low : low + CHUNK] + np.uint64((w + 1) * 0x9E3779B97F4A7C15 & MASK))
                places = part.view(np.uint8).reshape(-1, 8) + (_BYTE_POS + owner[low : low + CHUNK, None] * 2048)
                counts += np.bincount(places.ravel(), minlength=len(counts))
            ones = counts.reshape(len(sets), 8, 256).astype(np.float64) @ _BYTE_BITS.astype(np.float64)
            bits = 2 * ones > sizes[:, None, None]
            prints[:, w] = np.packbits(bits.reshape(len(sets), 64), axis=1, bitorder="little").view("<i8").ravel()
        keys = np.zeros((TABLES, len(sets)), dtype=np.uint64)
        for n, odd in enumerate(_ODD):
            table = n // ROWS
            keys[table] = _mixed(keys[table] + np.minimum.reduceat(h * odd, starts) + np.uint64(table + 1))
    return prints, keys.T.astype(np.int64)


def sign_texts(texts: list[bytes], words_per_shingle: int) -> tuple[np.ndarray, list[list[int]], list[int]]:
    """Fingerprint words, shard keys (none without words) and numbers of distinct shingles of texts."""
    sets = shingle_sets(texts, words_per_shingle)
    some = [i for i, s in enumerate(sets) if len(s)]
    prints, keys = np.zeros((len(texts), WORDS), dtype=np.int64), [[] for _ in texts]
    if some:
        prints[some], found = signatures([sets[i] for i in some])
        for i, k in zip(some, found.tolist()):
            keys[i] = k
    return prints, keys, [len(s) for s in sets]


def _members(column: pa.Array) -> Iterator[dict[str, np.ndarray]]:
    """The lists of shard members in a column, each as arrays by field; fingerprints as rows of 64-bit words, members in order of node."""
    for members in column:
        rows = members.values
        numbers = {f.name: rows.field(f.name).to_numpy(zero_copy_only=False) for f in rows.type if f.name != "s"}
        order = np.argsort(numbers["node"], kind="stable")
        out = {name: x[order] for name, x in numbers.items() if name not in _FP}
        if _FP[0] in numbers:
            out["fp"] = np.stack([numbers[f][order] for f in _FP], axis=1).view(np.uint64)
        if rows.type.get_field_index("s") >= 0:
            sets = rows.field("s")
            flat, ends = sets.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(len(x) for x in sets)])
            out["s"] = [flat[ends[i] : ends[i + 1]] for i in order.tolist()]
        yield out


def _apart(words: np.ndarray, some: np.ndarray, node: int) -> np.ndarray:
    """Bits in which the fingerprints of some members, columns of 64-bit words, differ from that of one."""
    return np.bitwise_count(words[:, some] ^ words[:, node, None]).sum(axis=0, dtype=np.int64)


def tree_pairs(words: np.ndarray, members: np.ndarray, asked: np.ndarray, radius: int, later: bool) -> Iterator[tuple[int, np.ndarray]]:
    """The BK-tree of ``members``, entered in their order, and a walk of all ``asked`` through it at once: each node that some of them have within the radius, with these.

    A node's children are keyed by their Hamming distance to it, and only those of the asked whose distance to the node is within the radius of an edge follow it. With ``later`` the members are
    asked for one another, each for those before it only, so a pair comes once. Few members are one ``BKTree``; of more, the nodes are made on the way and their distances found as arrays.
    """
    if len(members) + len(asked) <= 2 * TREE_ROWS:
        tree, whole = BKTree(), [int.from_bytes(x.tobytes(), "little") for x in words.T]
        near: list[list[int]] = [[] for _ in members]
        if not later:
            for member in members.tolist():
                tree.add(whole[member])
        for one in asked.tolist():
            for node in tree.within(whole[one], radius):
                near[node].append(one)
            if later:
                tree.add(whole[one])
        yield from ((int(node), np.array(x)) for node, x in zip(members, near) if x)
        return
    stack = [(members, asked)]
    while stack:
        members, asked = stack.pop()
        node, below = members[0], members[1:]
        asked = asked[asked > node] if later else asked
        if not len(asked):
            continue
        d = _apart(words, asked, node)
        near = asked[d <= radius]
        if len(near):
            yield int(node), near
        if len(below):
            edge = _apart(words, below, node)
            order = np.argsort(edge, kind="stable")
            below, edge = below[order], edge[order]
            starts = np.flatnonzero(np.concatenate(([True], edge[1:] != edge[:-1])))
            for low, high in zip(starts, [*starts[1:], len(below)]):
                stack.append((below[low:high], asked[np.abs(d - edge[low]) <= radius]))


def undecided(m: dict[str, np.ndarray], radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray | None]:
    """The members of a group that have another within the radius in another class, with a number of shingles that allows the similarity; and all such pairs, or
    None if there are more than ``PAIRS_EACH`` for a member of the group.

    Members of one side are compared with each other, those of two sides with those of the other side only; both along the BK-tree of a side.
    """
    fp, side, size, root = m["fp"], m["side"], m["size"], m["root"]
    sides = np.unique(side)
    left, right = np.flatnonzero(side == sides[0]), np.flatnonzero(side == sides[-1])
    found, pairs, count = np.zeros(len(fp), dtype=bool), [], 0
    for node, near in tree_pairs(np.ascontiguousarray(fp.T), right, left, radius, len(sides) == 1):
        a, b = size[near], size[node]
        near = near[(root[near] != root[node]) & (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9)]
        if not len(near):
            continue
        found[near] = found[node] = True
        count += len(near)
        if count <= PAIRS_EACH * len(fp):
            pairs.append(np.stack((near, np.full(len(near), node)), axis=1))
    if count > PAIRS_EACH * len(fp):
        return np.flatnonzero(found), None
    pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), dtype=np.int64)
    return np.flatnonzero(found), pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]


def verified_links(roots: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between classes, as pairs of roots, that span what the Jaccard similarities of all pairs of sets join.

    With two sides the pairs are those of a set of one side with one of the other. Shared elements are counted along lists of the sets that have each element.
    """
    sizes = np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    having = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]
    starts = np.concatenate(([0], np.cumsum(np.bincount(ids))))
    begin = np.concatenate(([0], np.cumsum(sizes)))
    sides, counts = np.unique(side, return_counts=True)
    asked = np.flatnonzero(side == sides[np.argmin(counts)])
    class_of, links = np.array(roots), []
    for i in asked.tolist():
        others = class_of != class_of[i]
        others &= side != side[i] if len(sides) > 1 else np.arange(len(sets)) < i
        if not others.any():
            continue
        shared = np.zeros(len(sets), dtype=np.int64)
        for low in range(begin[i], begin[i + 1], CHUNK // 64):
            mine = ids[low : min(low + CHUNK // 64, begin[i + 1])]
            n = starts[mine + 1] - starts[mine]
            at = np.repeat(starts[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared += np.bincount(having[at], minlength=len(sets))
        near = others & (shared >= similarity * (sizes[i] + sizes - shared) - 1e-9)
        for other in np.flatnonzero(near).tolist():
            if class_of[other] != class_of[i]:
                links.append((int(roots[other]), int(roots[i])))
                class_of[class_of == class_of[other]] = class_of[i]
    return links


def _digest(text: Column) -> Column:
    """128 bits of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256), 1, 32))


def _partitions(df: DataFrame) -> int:
    """A fixed number, for groups whose cost doesn't follow from their bytes."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def copy_classes(docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5, radius: int = COPY_RADIUS) -> DataFrame:
    """``same`` (a text's digest), ``least`` (its smallest doc_id) and ``class`` for each distinct text of ``docs``: texts with a Jaccard similarity of their shingle sets
    of at least ``similarity`` share a class, and so do those that a chain of such pairs joins. Texts without words are classes of their own.

    Nodes are texts, whatever their doc_ids. Texts that share a shard key are candidates if their fingerprints differ within the radius.
    Candidates are found along BK-trees, one for each shard or block of it.
    First each member of a shard is held against the shard's first one, and pairs unite once their whole shingle sets have been compared: work in proportion to the members,
    which gathers a large group of copies. Then members of different classes in one shard are compared, in blocks: all those outside the shard's largest class with one
    another and with that class, whose members aren't compared among themselves. Where that leaves few candidate pairs for a member they are decided one by one, each once for all shards;
    elsewhere the members with a candidate in another class take their shingle sets to the shard, where all pairs are decided. So classes merge on decided pairs only, and what
    is given out stays in proportion to the members.
    """

    @F.arrow_udf(", ".join(f"{f} long" for f in _FP) + ", keys array<long>, size int")
    def sign(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.binary())
        parts = [sign_texts([t.as_py() or b"" for t in raw[low : low + SIGNED]], words_per_shingle) for low in range(0, len(raw), SIGNED)]
        prints = np.concatenate([p for p, _, _ in parts]) if parts else np.zeros((0, WORDS), dtype=np.int64)
        columns = [*(pa.array(prints[:, w]) for w in range(WORDS)), pa.array([k for _, keys, _ in parts for k in keys], pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays([*columns, pa.array([n for *_, sizes in parts for n in sizes], pa.int32())], names=[*_FP, "keys", "size"])

    @F.arrow_udf("array<long>")
    def shingles(texts: pa.Array) -> pa.Array:
        sets = shingle_sets([t.as_py() or b"" for t in texts.cast(pa.binary())], words_per_shingle)
        ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *sets]).view(np.int64)))

    def still_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in enumerate(_members(batch.column(4))):
                found, pairs = undecided(m, radius, similarity)
                left, right = (found, None) if pairs is None else (pairs[:, 0], pairs[:, 1])
                others = [pa.nulls(len(left), pa.int64()) if right is None else pa.array(m[x][right]) for x in ("node", "root")]
                keys = [pa.array([batch.column(c)[at].as_py()] * len(left), batch.schema.types[c]) for c in range(4)]
                names = ["k", "top", "low", "high", "node", "root", "side", "other", "other_root"]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(m[x][left]) for x in ("node", "root", "side")), *others], names=names)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for m in _members(batch.column(0)) for x in verified_links(m["root"], m["side"], m["s"], similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    texts = docs.select(F.col("doc_id"), _digest(F.col("text")).alias("same"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = texts.select("doc_id", "same", sign("text").alias("x"))
    nodes = signed.groupBy("same").agg(F.min("doc_id").alias("least"), F.first("x").alias("x"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), "same", "least", "x.*"))
    prints = nodes.select("node", "size", *_FP)
    release(docs.sparkSession)

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs ``a``, ``b`` those that are similar enough."""
        left, right = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        near = both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both) - 1e-9
        return pairs.join(left, "a").join(right, "b").where(near).select(*pairs.columns)

    def alike(size_a: str, size_b: str) -> Column:
        return F.least(size_a, size_b) >= F.lit(similarity) * F.greatest(size_a, size_b) - 1e-9

    keyed = nodes.select("node", F.explode("keys").alias("k"))
    shards = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where("n > 1")
    members = cut(keyed.join(shards.select("k", "first"), "k"))

    pairs = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(prints.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}"), *(F.col(f).alias(f"{f}_{end}") for f in _FP)), end)
    far = sum((F.bit_count(F.col(f"{f}_a").bitwiseXOR(F.col(f"{f}_b"))) for f in _FP), F.lit(0))
    pairs = cut(pairs.where((far <= radius) & alike("size_a", "size_b")).select("a", "b"))
    # The shingle sets of all nodes that share a shard, each from one row that holds the text.
    at = members.select("node").distinct().join(nodes, "node").select("node", "same", F.xxhash64("least").alias("at"))
    rows = texts.select(F.xxhash64("doc_id").alias("at"), "same", "text").join(at, ["at", "same"]).dropDuplicates(["at", "same"])
    sets = cut(rows.select("node", shingles("text").alias("s")))
    release(docs.sparkSession)
    roots = cut(components(verified(pairs)))
    release(docs.sparkSession)

    rooted = members.select("k", "node").join(roots, "node", "left").select("k", "node", F.coalesce("root", "node").alias("root"))
    cells = rooted.groupBy("k", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("k")
    cells = cells.agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most")).where("roots > 1")
    blocks = lambda n: F.ceil(n / SHARD_BLOCK)
    cells = cut(cells.select("k", F.col("most.root").alias("top_root"), blocks(F.col("most.n")).alias("top_blocks"), blocks(F.col("n") - F.col("most.n")).alias("blocks")))
    dealt = rooted.join(cells, "k").withColumn("is_top", F.col("root") == F.col("top_root"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("is_top"), F.col("top_blocks")).otherwise(F.col("blocks"))))
    count_to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    group = lambda top, low, high, side: F.struct(F.lit(top).alias("top"), low.alias("low"), high.alias("high"), side.alias("side"))
    own, zero, one = F.col("own"), F.lit(0).cast("long"), F.lit(1).cast("long")
    with_rest = F.transform(count_to("blocks"), lambda x: group(False, F.least(own, x), F.greatest(own, x), own))
    with_top = F.transform(count_to("top_blocks"), lambda x: group(True, own, x, zero))
    from_top = F.transform(count_to("blocks"), lambda x: group(True, x, own, one))
    dealt = dealt.select("k", "node", "root", F.explode(F.when(F.col("is_top"), from_top).otherwise(F.concat(with_rest, with_top))).alias("g")).select("k", "g.*", "node", "root")
    key = ["k", "top", "low", "high"]
    groups = dealt.join(prints, "node").repartition(_partitions(docs), *key).groupBy(*key).agg(F.collect_list(F.struct("node", "root", "side", "size", *_FP)).alias("members"))
    schema = "k long, top boolean, low long, high long, node long, root long, side long, other long, other_root long"
    unsure = cut(groups.where(F.size("members") > 1).mapInArrow(still_open, schema))
    single = unsure.where("other is not null").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), F.col("root").alias("ra"), F.col("other_root").alias("rb"))
    single = single.dropDuplicates(["a", "b"]).join(pairs, ["a", "b"], "left_anti")
    met = unsure.where("other is null").select(*key, "node", "root", "side").join(sets, "node").repartition(_partitions(docs), *key)
    met = met.groupBy(*key).agg(F.collect_list(F.struct("node", "root", "side", "s")).alias("members"))
    late = verified(single).select(F.col("ra").alias("a"), F.col("rb").alias("b")).unionAll(met.select("members").mapInArrow(decide, "a long, b long"))
    late = components(cut(late))
    release(docs.sparkSession)

    early = nodes.select("node", "same", "least").join(roots, "node", "left").select("same", "least", F.coalesce("root", "node").alias("early"))
    late = late.select(F.col("node").alias("early"), F.col("root").alias("late"))
    return early.join(late, "early", "left").select("same", "least", F.coalesce("late", "early").alias("class"))


def near_copies(docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5, radius: int = COPY_RADIUS) -> DataFrame:
    """``doc_id``, ``class_id``: a row for each row of ``docs``, with the smallest doc_id of its class of near copies; null for a class of rows without one.

    A null text is the empty text.
    """
    classes = copy_classes(docs, similarity, words_per_shingle, radius)
    named = classes.groupBy("class").agg(F.min("least").alias("class_id"))
    named = classes.join(named, "class").select("same", "class_id")
    return docs.select("doc_id", _digest(F.col("text")).alias("same")).join(named, "same").select("doc_id", "class_id")


def keep_one_of_each(docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5) -> DataFrame:
    """One row of ``docs`` for each class of near copies: of its smallest doc_id (nulls last); if several texts of the class have that one, the text with the smallest digest.

    Texts that share a doc_id but aren't similar are kept each by its own. Of rows that repeat doc_id and text, one stays, the least by its other columns.
    """
    at, same, keeper, row, rest = (fresh(x, docs) for x in ("at", "same", "keeper", "row", "rest"))
    classes = copy_classes(docs, similarity, words_per_shingle)
    kept = classes.groupBy("class").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "same")).alias("x"))
    kept = kept.select(F.xxhash64("x.least").alias(at), F.col("x.same").alias(same), F.col("x.least").alias(keeper))
    rows = docs.withColumn(at, F.xxhash64("doc_id")).withColumn(same, _digest(F.col("text")))
    rows = rows.join(kept, [at, same]).where(F.col("doc_id").eqNullSafe(F.col(keeper)))
    quoted = [f"`{c}`" for c in docs.columns]
    others = F.to_json(F.struct(F.col("text").isNull().alias("none"), *(F.col(q) for c, q in zip(docs.columns, quoted) if c not in ("doc_id", "text"))))
    one = rows.groupBy(at, same).agg(F.min_by(F.struct(*quoted), others).alias(row))
    return one.select(f"`{row}`.*")
