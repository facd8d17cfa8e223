"""SimHash near-duplicates: fingerprints, candidates by equal parts, bit-sliced comparison, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, row_key, rows, written
from .components import components

#: Rows of one bucket that are compared in one go; a larger bucket is dealt to several such blocks.
BLOCK = 2048
_U = np.uint64


def simhash(text: str | None, shingle: int = 3, lanes: int = 1) -> bytes:
    """The SimHash of a text, 64 bits a lane, big-endian: a bit is 1 if it is set in over half of the shingles' hashes.

    Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case. Shingles are so many words, repeats included; fewer
    words give the whole sequence, and none gives zero. A hash is XXH64 (seed 42); further lanes mix it by a multiplication."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and white space of ASCII only
    if not words:
        return bytes(8 * lanes)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], _U)
    else:
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        begins = [0, *(ends + 1).tolist()]
        hashes = np.array([xxhash.xxh64_intdigest(line[i:j], 42) for i, j in zip(begins, ends[shingle - 1 :].tolist())], _U)
    out = []
    for lane in range(lanes):
        h = hashes
        if lane:
            h = (h ^ (h >> _U(29)) ^ _U(lane)) * _U(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> _U(32))) * _U(0x94D049BB133111EB)
            h ^= h >> _U(29)
        ones = np.zeros(64, np.int64)
        for k in range(0, len(h), 4096):
            ones += np.unpackbits(np.ascontiguousarray(h[k : k + 4096]).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(h)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, shingle: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """doc_id and fp (binary) of every row; if asked for, row (see row_key, over all columns) and words_hash (binary), one for all texts of the same words. No shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary()), *[("row", pa.binary()), ("words_hash", pa.binary())] * hashed])

    def words_hash(text: str | None) -> bytes:
        return hashlib.blake2b(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()), digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("simhash", None)
        for b in batches:
            texts = [t for (t,) in rows(iter([b]), "text")]
            columns = [b.column("id"), pa.array([simhash(t, shingle, lanes) for t in texts], pa.binary())]
            if hashed:
                columns += [b.column("row").cast(pa.binary()), pa.array([words_hash(t) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[row_key(docs).alias("row")] * hashed)
    return chosen.mapInArrow(run, "doc_id long, fp binary" + ", row binary, words_hash binary" * hashed)


def all_parts(radius: int, bits: list[int] | None = None) -> list[list[int]]:
    """Bit positions of key tables such that fingerprints that differ in at most ``radius`` of the ``bits`` (all 64) agree in all bits of one table.

    The bits are cut into radius + 2 parts; at most ``radius`` parts differ, so two parts are equal."""
    parts = [list(map(int, x)) for x in np.array_split(np.arange(64) if bits is None else np.array(bits), radius + 2)]
    return [a + b for a, b in combinations(parts, 2)]


def drawn_parts(bits: int, width: int, tables: int) -> list[list[int]]:
    """Key tables of ``width`` bits drawn at random, for radii beyond all_parts. A pair that differs in a share d of
    its bits meets in one of them with probability 1 - (1 - (1 - d) ** width) ** tables."""
    draw = np.random.default_rng(7)
    return [sorted(map(int, draw.choice(bits, width, replace=False))) for _ in range(tables)]


class _Planes:
    """Fingerprints stored vertically: plane k has bit k of all of them, as one long integer."""

    def __init__(self, fps: np.ndarray):
        bits = np.unpackbits(fps, axis=1)
        self.n = len(fps)
        self.planes = [int.from_bytes(x.tobytes(), "little") for x in np.packbits(bits.T, axis=1, bitorder="little")]


def _within(differences: Iterator[int], mask: int, radius: int) -> int:
    """Lanes of mask with at most ``radius`` differences. The k-th integer has the k-th bit's differences of all lanes.

    Carry-save counters: digit[i] has the bits of value 2 ** i of all lanes' counts. Four planes are added at a time by full adders and their carry ripples
    upwards. Now and then all lanes are compared with the radius, and the block is given up once none is left."""
    digits = [0] * (radius.bit_length() + 2)
    over = 0
    alive = mask
    batch: list[int] = []
    for k, x in enumerate(differences):
        batch.append(x)
        if len(batch) < 4:
            continue
        ones, twos = digits[0], digits[1]
        a, b, c, d = batch
        batch = []
        u = ones ^ a
        carry1 = ones & a | u & b
        ones = u ^ b
        u = ones ^ c
        carry2 = ones & c | u & d
        ones = u ^ d
        u = twos ^ carry1
        carry = twos & carry1 | u & carry2
        digits[0], digits[1] = ones, u ^ carry2
        for i in range(2, len(digits)):
            if not carry:
                break
            digits[i], carry = digits[i] ^ carry, digits[i] & carry
        over |= carry
        if k % 8 == 7:
            more, equal = over, alive
            for i in range(len(digits) - 1, -1, -1):
                if radius >> i & 1:
                    equal &= digits[i]
                else:
                    more |= equal & digits[i]
                    equal &= ~digits[i]
            alive &= ~more
            if not alive:
                return 0
    return alive


def _lanes(x: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little", count=n))


class _Forest:
    """Which rows are linked so far."""

    def __init__(self, start: np.ndarray):
        _, self.root = np.unique(start, return_inverse=True)
        first = np.full(self.root.max() + 1 if len(start) else 0, len(start), np.int64)
        np.minimum.at(first, self.root, np.arange(len(start)))
        self.root = first[self.root]
        self.links: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Link rows i and j; a link within a tree says nothing new."""
        new = self.root[i] != self.root[j]
        if not new.any():
            return
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for a, b in zip(i[new].tolist(), j[new].tolist()):
            ra, rb = top(int(self.root[a])), top(int(self.root[b]))
            if ra != rb:
                up[max(ra, rb)] = min(ra, rb)
                self.links.append((a, b))
        if up:
            of = {x: top(x) for x in up}
            flat = np.arange(len(self.root))
            flat[list(of)] = list(of.values())
            self.root = flat[self.root]


def trees_within(fps: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """For every row, the first row of its tree of pairs of one group within ``radius`` bits. Rows are sorted by group; fps is (n, bytes)."""
    return _linked(_Forest(np.arange(len(fps))), fps, group, radius).root


def _linked(forest: _Forest, fps: np.ndarray, group: np.ndarray, radius: int) -> _Forest:
    """The forest with the pairs of one group within ``radius`` bits added.

    All rows are compared at once with the row s further on, for s = 1, 2, ...; rows of smaller groups, and of
    groups that are one tree by then, are dropped from the planes."""
    rows_left, s = np.arange(len(fps)), 0
    while True:
        g = group[rows_left]
        last = np.searchsorted(g, g, "right") - 1
        reach = last - np.arange(len(g))
        size = last - np.searchsorted(g, g, "left") + 1
        r = forest.root[rows_left]
        head = np.searchsorted(g, g, "left")
        mixed = np.zeros(len(g), bool)
        if len(g):
            odd = np.zeros(len(g) + 1, np.int64)
            odd[1:] = np.cumsum(r != r[head])
            mixed = odd[last + 1] - odd[head] > 0
        stay = (size > s + 1) & mixed
        if not stay.any():
            return forest
        if not stay.all():
            rows_left = rows_left[stay]
            continue
        p = _Planes(fps[rows_left])
        limit = len(g)
        until = max(2 * s, s + 4)
        while s < until:
            s += 1
            here = reach >= s
            if not here.any():
                break
            mask = int.from_bytes(np.packbits(here, bitorder="little").tobytes(), "little")
            found = _within((x ^ x >> s for x in p.planes), mask, radius)
            if found:
                i = _lanes(found, limit)
                forest.add(rows_left[i], rows_left[i + s])


def links_between(a: np.ndarray, b: np.ndarray, label_a: np.ndarray, label_b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that span all pairs of a row of a and a row of b within ``radius`` bits; each row of a goes over b's planes."""
    forest = _Forest(np.concatenate([label_a, label_b]))
    p, n = _Planes(b), len(b)
    full = (1 << n) - 1
    for i, bits in enumerate(np.unpackbits(a, axis=1)):
        other = forest.root[len(a) :] != forest.root[i]
        if not other.any():
            continue
        mask = int.from_bytes(np.packbits(other, bitorder="little").tobytes(), "little")
        found = _within((x ^ full if bit else x for x, bit in zip(p.planes, bits.tolist())), mask, radius)
        if found:
            j = _lanes(found, n)
            forest.add(np.full(len(j), i), j + len(a))
    return [(i, j - len(a)) for i, j in forest.links]


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _matrix(fps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1)


def _link_batch(ids: np.ndarray, other: np.ndarray, links: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(other[at[:, 1]])], schema=_LINK)


_KEYED = pa.schema([("part", pa.int64()), ("key", pa.int64()), ("rep", pa.int64()), ("fp", pa.binary())])


def _keys(bits: np.ndarray, table: list[int]) -> np.ndarray:
    return bits[:, table].astype(np.int64) @ np.array([1 << i for i in range(len(table))], np.int64)


def _in_tables(vertices: DataFrame, tables: list[list[int]]) -> DataFrame:
    """Vertices (rep, fp) with part and key, once for every key table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bits = np.unpackbits(_matrix(b.column("fp").to_pylist()), axis=1)
                for k, t in enumerate(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), k), pa.int64()), pa.array(_keys(bits, t)), b.column("rep"), b.column("fp").cast(pa.binary())], schema=_KEYED)

    return vertices.select("rep", "fp").mapInArrow(run, "part long, key long, rep long, fp binary")


def _counted(keyed: DataFrame) -> DataFrame:
    """part, key and n of the buckets of more than BLOCK rows, few by their size."""
    return written(keyed.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))


def _buckets(vertices: DataFrame, tables: list[list[int]]) -> tuple[DataFrame, DataFrame]:
    """Vertices (rep, fp) with part, key and block once for every key table, and the buckets of more than BLOCK rows, which are dealt to several blocks."""
    keyed = _in_tables(vertices, tables)
    large = _counted(keyed)
    block = F.coalesce(F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / BLOCK)), F.lit(0)).cast("int")
    return keyed.join(large, ["part", "key"], "left").withColumn("block", block), large


def _free_bits(part: int, radius: int) -> list[int]:
    """The bits that are in no key along a part's path: part is part before * (tables + 1) + table + 1, from 0 on."""
    path, tables = [], (radius + 2) * (radius + 1) // 2
    while part:
        path.append(part % (tables + 1) - 1)
        part //= tables + 1
    free = list(range(64))
    for table in reversed(path):
        key = set(all_parts(radius, free)[table])
        free = [x for x in free if x not in key]
    return free


def _exact_buckets(vertices: DataFrame, radius: int) -> DataFrame:
    """Vertices (rep, fp of 64 bits, all different) in buckets of at most BLOCK rows in which every pair within ``radius`` bits meets.

    A bucket beyond BLOCK rows, in which the bits of its key are equal, is taken apart by key tables over its other bits: a pair
    within the radius meets in one of those as well. So many different fingerprints can't share all but a few bits, so this ends after a few levels
    and no bucket is compared with itself block by block."""
    tables = len(all_parts(radius))
    level, out = vertices.select(F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("key"), "rep", "fp"), []

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free: dict[int, list[int]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            bits, part, key = np.unpackbits(_matrix(b.column("fp").to_pylist()), axis=1), b.column("part").to_numpy(), b.column("key").to_numpy()
            for p in np.unique(part).tolist():
                at = np.flatnonzero(part == p)
                rest = free.setdefault(p, _free_bits(p, radius))
                some = b.take(pa.array(at))
                for k, t in enumerate(all_parts(radius, rest)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p * (tables + 1) + k + 1)), pa.array((key[at] << len(t)) + _keys(bits[at], t)), some.column("rep"), some.column("fp").cast(pa.binary())], schema=_KEYED)

    while True:
        keyed = level.mapInArrow(deeper, "part long, key long, rep long, fp binary")
        large = _counted(keyed)
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*out, keyed]).withColumn("block", F.lit(0))
        out.append(keyed.join(large, ["part", "key"], "left_anti"))
        level = written(keyed.join(large.drop("n"), ["part", "key"]))


def near_components(prints: DataFrame, radius: int) -> DataFrame:
    """doc_id, fp, component_id for rows (doc_id, fp of 64 bits): fingerprints within ``radius`` bits are linked, and none of those is missed.

    Equal fingerprints are one vertex, named by its least doc_id, so that copies are never compared. A bucket is the vertices of
    equal key in a table (see _exact_buckets), and one shuffle brings it together."""
    prints = written(prints)
    vertices = written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = written(_fewer(written(_first_links(_exact_buckets(vertices, radius), radius))))
    labels = components(links).withColumnRenamed("id", "rep")
    named = vertices.join(labels, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    found = prints.join(named, "fp", "left")
    return found.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _fewer(links: DataFrame) -> DataFrame:
    """Links with the same components: each row's links (a, b), one per table, become a's link to its least b, and links of the other b to that one."""
    least = links.select("b", "a", F.min("b").over(Window.partitionBy("a")).alias("least"))
    return least.select("a", F.col("least").alias("b")).union(least.select(F.col("b").alias("a"), F.col("least").alias("b"))).where("a <> b").distinct()


def _first_links(shared: DataFrame, radius: int) -> DataFrame:
    """Links within blocks, from each row to the least of its tree. A partition is sorted by block, and whole blocks are gathered up to a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[int] = []
        reps: list[int] = []
        fps: list[bytes] = []
        last, n = None, 0

        def compare() -> pa.RecordBatch:
            ids, least = np.array(reps, np.int64), np.array(reps, np.int64)
            root = trees_within(_matrix(fps), np.array(group), radius)
            np.minimum.at(least, root, ids)
            low = least[root]
            far = ids != low
            return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(low[far])], schema=_LINK)

        for part, key, block, rep, fp in rows(batches, "part", "key", "block", "rep", "fp"):
            if (part, key, block) != last:
                last, n = (part, key, block), n + 1
                if len(fps) > 8 * BLOCK:
                    yield compare()
                    group, reps, fps = [], [], []
            group.append(n)
            reps.append(rep)
            fps.append(fp)
        if fps:
            yield compare()

    dealt = shared.select("part", "key", "block", "rep", "fp").repartition("part", "key", "block").sortWithinPartitions("part", "key", "block")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _cross_links(rest: DataFrame, radius: int) -> DataFrame:
    """Links between different blocks of a bucket. A block is one row with its fingerprints; pairs of blocks in one component are left out."""
    cols = ["part", "key", "block"]
    blocks = rest.groupBy(*cols).agg(F.collect_list(F.struct("rep", "fp", "label")).alias("rows"), F.min("label").alias("least"), F.max("label").alias("most"))
    blocks = written(blocks.select(*cols, "least", "most", F.col("rows.rep").alias("reps"), F.col("rows.fp").alias("fps"), F.col("rows.label").alias("labels")))
    a, b = blocks.alias("a"), blocks.alias("b")
    on = (F.col("a.part") == F.col("b.part")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.block") < F.col("b.block"))
    open_pairs = a.join(b, on).where("least(a.least, b.least) < greatest(a.most, b.most)")
    pairs = open_pairs.select(*(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("reps", "fps", "labels")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ra, fa, la, rb, fb, lb in rows(batches, "a_reps", "a_fps", "a_labels", "b_reps", "b_fps", "b_labels"):
            yield _link_batch(np.array(ra), np.array(rb), links_between(_matrix(fa), _matrix(fb), np.array(la), np.array(lb), radius))

    return pairs.repartition(2 * int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable over links of at most ``radius`` bits, <= 6).

    Null and wordless texts have fingerprint zero and are linked like any other. Rows with a null id get a fingerprint
    and a null component, and link nothing. Repeated ids are one document if their texts link. An empty table gives no rows."""
    if not 0 <= radius <= 6:
        raise ValueError("key tables without misses are built for a radius of 0 to 6")
    found = near_components(fingerprints(docs, shingle, 1, id_col, text_col), radius)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: For shingle sets of Jaccard J, SimHash bits differ with probability acos(2J / (1 + J)) / pi: 0.152 at J = 0.8.
SIMILAR_BITS, SIMILAR_WIDTH, SIMILAR_TABLES, SIMILAR_RADIUS = 256, 18, 64, 56


#: Vertices of a group that are checked with each other in one go, and the central ones of a larger group that all others are checked with.
GROUP, PIVOTS = 512, 64
#: Bytes of sets that a task should hold at most.
SET_BYTES = 64 << 20


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct shingles of a text, as simhash has them, by their hashes in rising order; none of a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.unique(np.array([xxhash.xxh3_64_intdigest(b" ".join(words[i : i + shingle])) for i in range(max(1, len(words) - shingle + 1))] if words else [], _U))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets have a similarity (Jaccard) of 0.8 or more."""
    n, m = len(a), len(b)
    if 5 * min(n, m) < 4 * max(n, m):
        return False
    both = np.concatenate([a, b])
    both.sort()
    return 9 * int((both[1:] == both[:-1]).sum()) >= 4 * (n + m)  # common / (n + m - common) >= 4 / 5


class _Group:
    """Vertices of one group with their sets. linked() checks pairs of trees that aren't connected yet, and nothing else."""

    def __init__(self, fps: list[bytes], sets: list[bytes], labels: list[int]):
        self.fps, self.sets = _matrix(fps), [np.frombuffer(x, _U) if x else np.zeros(0, _U) for x in sets]
        self.forest = _Forest(np.array(labels, np.int64))

    def linked(self, firsts: int, radius: int) -> list[tuple[int, int]]:
        """Links that span all pairs of a similarity of 0.8 or more of one of the first rows and any later one. Bit planes leave only rows within the radius to check."""
        n = len(self.sets)
        planes, bits, full = _Planes(self.fps), np.unpackbits(self.fps, axis=1), (1 << n) - 1
        for i in range(min(firsts, n - 1)):
            other = self.forest.root != self.forest.root[i]
            other[: i + 1] = False
            if not other.any():
                continue
            mask = int.from_bytes(np.packbits(other, bitorder="little").tobytes(), "little")
            found = _within((x ^ full if bit else x for x, bit in zip(planes.planes, bits[i].tolist())), mask, radius)
            for j in _lanes(found, n).tolist() if found else ():
                if self.forest.root[i] != self.forest.root[j] and similar(self.sets[i], self.sets[j]):
                    self.forest.add(np.array([i]), np.array([j]))
        return self.forest.links


_CHECK = ["g", "block", "chunk", "role", "rep", "label", "fp", "shingles"]


def _checked_links(rows_of: DataFrame, radius: int) -> DataFrame:
    """Verified links within every (g, block, chunk) of rows as in _CHECK, without those of rows of one label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        held_rows: list[tuple] = []

        def compare() -> pa.RecordBatch:
            reps = np.array([x[1] for x in held_rows], np.int64)
            group = _Group([x[3] for x in held_rows], [x[4] for x in held_rows], [x[2] for x in held_rows])
            return _link_batch(reps, reps, group.linked(len(reps), radius))

        for g, block, chunk, *row in rows(batches, *_CHECK):
            if (g, block, chunk) != last:
                if len(held_rows) > 1:
                    yield compare()
                last, held_rows = (g, block, chunk), []
            held_rows.append(row)
        if len(held_rows) > 1:
            yield compare()

    dealt = rows_of.select(*_CHECK).repartition("g", "block", "chunk").sortWithinPartitions("g", "block", "chunk", F.col("role").desc(), "rep")
    return dealt.mapInArrow(run, "a long, b long").where("a <> b")


def _central(members: DataFrame) -> DataFrame:
    """members (g, block, ...) with far: in how many bits a fingerprint differs from what most of its block have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held_rows = None, []

        def ranked() -> pa.RecordBatch:
            bits = np.unpackbits(_matrix([x[3] for x in held_rows]), axis=1)
            far = (bits != (2 * bits.sum(0, dtype=np.int64) > len(bits))).sum(1)
            best = np.argsort(far, kind="stable")[:PIVOTS]
            columns = [[held_rows[k][c] for k in best] for c in range(4)]
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))), pa.array(far[best], pa.int64())], names=["g", "block", "rep", "fp", "far"])

        for row in rows(batches, "g", "block", "rep", "fp"):
            if row[:2] != last:
                if held_rows:
                    yield ranked()
                last, held_rows = row[:2], []
            held_rows.append(row)
        if held_rows:
            yield ranked()

    dealt = members.select("g", "block", "rep", "fp").repartition("g", "block").sortWithinPartitions("g", "block", "rep")
    return dealt.mapInArrow(run, "g long, block int, rep long, fp binary, far long")


def _verified(vertices: DataFrame, groups: DataFrame, texts: DataFrame, shingle: int, radius: int) -> DataFrame:
    """Links (a, b) of vertices (rep, row, fp) with a similarity of 0.8 or more that span all those within groups (id, component). texts is (row, text).

    A group is checked in blocks of about GROUP vertices, or fewer where their sets are large. A larger one is first checked block by block, each together with the group's PIVOTS most central
    vertices, which connects a document with all its near copies. What is then still apart from the group's largest part meets the rest of the group by rare shingles (see _rare_links).
    Pairs that are connected already aren't checked."""
    chosen = vertices.join(groups.select(F.col("id").alias("rep"), F.col("component").alias("g")), "rep")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                found = pa.array([shingle_hashes(t, shingle).tobytes() for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("g"), part.column("fp").cast(pa.binary()), found], names=["rep", "g", "fp", "shingles"])

    texts_of = texts.join(chosen.select("row", "rep", "g", "fp"), "row").groupBy("rep", "g", "fp").agg(F.min("text").alias("text"))
    members = texts_of.select("rep", "g", "fp", "text").mapInArrow(sets, "rep long, g long, fp binary, shingles binary")
    members = written(members)
    sizes = members.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum(F.length("shingles")) / SET_BYTES)).alias("blocks"))
    large_ones = written(sizes.where("blocks > 1"))  # few, so that Spark can broadcast them by their size
    members = members.join(large_ones, "g", "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("rep"), F.col("blocks"))).cast("int"))
    rows_of = members.withColumns({"chunk": F.lit(0), "role": F.lit(0), "label": F.col("rep")})
    large = members.where("blocks > 1")
    if large.isEmpty():
        return written(_checked_links(rows_of, radius))
    nearest = Window.partitionBy("g").orderBy("far", "rep")
    pivots = written(_central(large).withColumn("_k", F.row_number().over(nearest)).where(F.col("_k") <= PIVOTS).select("rep"))
    shown = written(members.join(pivots, "rep", "left_semi").select("g", "rep", "fp", "shingles", F.col("block").alias("own")))
    blocks = written(large.select("g", "block").distinct())
    also = shown.join(blocks, "g").where("own <> block").select("g", "block", F.lit(0).alias("chunk"), F.lit(1).alias("role"), "rep", F.col("rep").alias("label"), "fp", "shingles")
    links = written(_checked_links(rows_of.select(*_CHECK).unionByName(also), radius))
    labels = components(links).withColumnRenamed("id", "rep")
    named = written(large.select("g", "rep").join(labels, "rep", "left").select("g", "rep", F.coalesce("component", "rep").alias("label")))
    parts = named.groupBy("g", "label").agg(F.count("*").alias("n"))
    main = parts.groupBy("g").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("g", "main")
    main = written(main)
    if main.isEmpty():
        return links
    opened = named.join(main, "g").select("g", "rep", "label", (F.col("label") != F.col("main")).alias("apart"))
    return links.union(written(_rare_links(members.join(opened, ["g", "rep"]).select("g", "rep", "label", "apart", "shingles"))))


def _rare_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of vertices of one group and different labels, one of them apart, that may have a similarity of 0.8 or more: none that has is missed.

    With all shingles in one order, two sets of such similarity share one of their first n // 5 + 1 (n: a set's own size). The order is by rising frequency in the group, so what all texts
    of a family share stands last, and texts meet by what only few have. Shingles that one text has alone meet nothing and go before anything is sorted.
    Every step is an aggregate or an equi-join of rows (group, shingle, vertex), in proportion to the sets' sizes and to the pairs that share a rare shingle."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                sets = [np.frombuffer(x, np.int64) for x in part.column("shingles").to_pylist()]
                size = np.array([len(x) for x in sets], np.int64)
                at = pa.array(np.repeat(np.arange(len(sets)), size))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("g", "rep", "label", "apart")), pa.array(np.repeat(size, size)), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], names=["g", "rep", "label", "apart", "size", "h"])

    tokens = members.mapInArrow(explode, "g long, rep long, label long, apart boolean, size long, h long")
    common = tokens.groupBy("g", "h").agg(F.count("*").alias("f"), F.bool_or("apart").alias("some"), F.min("label").alias("least"), F.max("label").alias("most")).where("f > 1")
    shared = tokens.join(common, ["g", "h"])
    of = Window.partitionBy("g", "rep")
    alone = F.col("size") - F.count("*").over(of)
    place = F.row_number().over(of.orderBy("f", "h")) + alone
    first = shared.withColumn("place", place).where("place <= floor(size / 5) + 1 and some and least < most")
    first = written(first.select("g", "h", "rep", "label", "apart", "size"))
    a, b = first.where("apart").alias("a"), first.alias("b")
    sizes = 5 * F.least("a.size", "b.size") >= 4 * F.greatest("a.size", "b.size")
    on = (F.col("a.g") == F.col("b.g")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.label") != F.col("b.label")) & sizes & (~F.col("b.apart") | (F.col("a.rep") < F.col("b.rep")))
    return a.join(b, on).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()


def _rare_links(members: DataFrame) -> DataFrame:
    """Verified links (a, b) between vertices of one group and different labels, one of them apart. members is (g, rep, label, apart, shingles)."""
    sets = members.select("rep", "shingles")
    pairs = _rare_pairs(members).join(sets.withColumnsRenamed({"rep": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"rep": "b", "shingles": "y"}), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                good = [similar(np.frombuffer(x, _U), np.frombuffer(y, _U)) for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")], schema=_LINK)

    return pairs.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def _candidates(vertices: DataFrame, tables: list[list[int]], radius: int) -> DataFrame:
    """Links (a, b) that span all pairs of vertices (rep, fp) within ``radius`` bits that meet in a key table."""
    shared, large = _buckets(vertices, tables)
    links = written(_fewer(written(_first_links(shared, radius))))
    if not large.isEmpty():
        labels = components(links)
        rest = shared.where("n is not null").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep"))
        links = links.union(written(_cross_links(rest, radius)))
    return links


def similar_documents(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, component_id and stays for every row: documents whose five-word shingle sets have a similarity of 0.8 or more are linked. A wider SimHash finds groups, in which pairs are checked.

    Bits are 256, so that a similarity of 0.8 is 39 differing bits, with a standard deviation of 6. The radius is 56. SIMILAR_TABLES random key tables
    of SIMILAR_WIDTH bits find a pair of similarity 0.8 with probability 0.96, 0.9 with 0.99993; what they connect is a group, and within it every pair in the radius is checked or connected already.
    Texts of the same words are one vertex, whatever ids they have.
    row is row_key of the row. Of a component, the row with the least doc_id stays, nulls last, then the least row; component_id is that doc_id.
    Rows alike in all columns are one. Null and wordless texts are one component. An empty table gives no rows."""
    tables = drawn_parts(SIMILAR_BITS, SIMILAR_WIDTH, SIMILAR_TABLES)
    texts = docs.select(row_key(docs).alias("row"), F.col(text_col).alias("text"))
    prints = written(fingerprints(docs, shingle, SIMILAR_BITS // 64, id_col, text_col, hashed=True))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("first")
    grouped = prints.groupBy("words_hash", "fp").agg(first)
    vertices = written(grouped.select("words_hash", "fp", "first", F.col("first.row").alias("row"), F.monotonically_increasing_id().alias("rep")))  # fixed once they are written
    groups = components(_candidates(vertices, tables, SIMILAR_RADIUS))
    labels = components(_verified(vertices, groups, texts, shingle, SIMILAR_RADIUS))
    named = vertices.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("words_hash", "first", F.coalesce("component", "rep").alias("component"))
    keepers = named.groupBy("component").agg(F.min("first").alias("keeper"))
    of_words = written(named.join(keepers, "component").select("words_hash", F.col("keeper.doc_id").alias("component_id"), F.col("keeper.row").alias("kept_row")))
    found = prints.join(of_words, "words_hash", "left")
    return found.select("doc_id", "row", "component_id", (F.col("row") == F.col("kept_row")).alias("stays"))
