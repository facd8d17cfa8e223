"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of a few words."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, rows

#: A sentence with its end, and a piece of up to three words of it. Every character is in one piece.
SENTENCE = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+")
PIECE = re.compile(r"\s*(?:\S+\s*){1,3}|\s+")
SLOTS = 128
_EMPTY = np.uint64(2**64 - 1)


@dataclass
class Node:
    """A part [start, end) of a text, its digest, and the parts it consists of."""

    digest: bytes
    start: int
    end: int
    children: list


def _pieces(line: str) -> list[str]:
    return [piece for sentence in SENTENCE.findall(line) for piece in PIECE.findall(sentence)]


def _paragraph(line: str) -> tuple[bytes, bytes]:
    """The digest of a paragraph, and its pieces' digests one after another."""
    leaves = b"".join(map(xxhash.xxh3_128_digest, _pieces(line)))
    return xxhash.xxh3_128_digest(b"p" + leaves), leaves


def _sections(digests: list[bytes]) -> list[tuple[bytes, int, int]]:
    """Digest, first and last paragraph of each section.

    A section ends behind a paragraph whose digest says so, so that an edit moves only the section ends near it."""
    out, first = [], 0
    for k, d in enumerate(digests):
        if d[0] % 8 == 0 or k == len(digests) - 1:
            out.append((xxhash.xxh3_128_digest(b"s" + b"".join(digests[first : k + 1])), first, k))
            first = k + 1
    return out


def _root(sections: list[tuple[bytes, int, int]]) -> bytes:
    return xxhash.xxh3_128_digest(b"r" + b"".join(s[0] for s in sections))


def tree(text: str | None) -> Node:
    """The Merkle tree of a text: root, sections, paragraphs (lines), pieces. A parent's digest covers its children's."""
    text = text or ""
    paragraphs, at = [], 0
    for line in text.split("\n"):
        pieces, p = [], at
        for piece in _pieces(line):
            pieces.append(Node(xxhash.xxh3_128_digest(piece), p, p + len(piece), []))
            p += len(piece)
        paragraphs.append(Node(_paragraph(line)[0], at, at + len(line), pieces))
        at += len(line) + 1
    sections = _sections([p.digest for p in paragraphs])
    return Node(_root(sections), 0, len(text), [Node(d, paragraphs[i].start, paragraphs[j].end, paragraphs[i : j + 1]) for d, i, j in sections])


@dataclass
class Print:
    """A fingerprint: its string, and the tree as far as whole paragraphs: sections, and each paragraph's digest with its pieces' digests."""

    text: str
    sections: list[tuple[bytes, int, int]]
    paragraphs: list[tuple[bytes, bytes]]


def fingerprint(text: str | None, known: dict[str, tuple[bytes, bytes]] | None = None) -> Print:
    """The root's digest, and a byte from each of SLOTS sets that the leaves are dealt to.

    The root alone tests equality. The slots hold the least leaf digest of each set, so that two strings without their trees agree
    in about the share of leaves in common (see estimate). ``known`` keeps paragraphs between versions of a text."""
    known = {} if known is None else known
    paragraphs = []
    for line in (text or "").split("\n"):
        if line not in known:
            known[line] = _paragraph(line)
        paragraphs.append(known[line])
    slots = np.full(SLOTS, _EMPTY)
    digests = b"".join(p[1] for p in paragraphs)
    if digests:
        h = np.sort(np.frombuffer(digests, "<u8")[::2])
        first = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        times = np.arange(len(h)) - np.repeat(first, np.diff(first, append=len(h)))
        h = (h ^ times.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)  # the second of equal leaves is another leaf
        h ^= h >> np.uint64(32)
        np.minimum.at(slots, (h & np.uint64(SLOTS - 1)).astype(np.int64), h >> np.uint64(7))
    shown = "".join("--" if x == 2**64 - 1 else f"{x & 255:02x}" for x in slots.tolist())
    sections = _sections([p[0] for p in paragraphs])
    return Print(f"{_root(sections).hex()}:{shown}", sections, paragraphs)


def _left_over(a: list[bytes], b: list[bytes]) -> tuple[list[int], list[int]]:
    """The places of digests that find no partner on the other side. Each finds one at most, wherever it stands."""
    there, left = Counter(b), []
    for k, x in enumerate(a):
        if there[x] > 0:
            there[x] -= 1
        else:
            left.append(k)
    right = []
    for k in range(len(b) - 1, -1, -1):
        if there[b[k]] > 0:
            there[b[k]] -= 1
            right.append(k)
    return left, right[::-1]


def open_paragraphs(a: Print, b: Print) -> tuple[list[int], list[int]]:
    """The paragraphs of a and of b in branches that differ. Sections in common are not entered, and what has moved is in common."""
    if a.text == b.text:
        return [], []
    sections = _left_over([s[0] for s in a.sections], [s[0] for s in b.sections])
    mine, theirs = ([k for i in left for k in range(p.sections[i][1], p.sections[i][2] + 1)] for left, p in zip(sections, (a, b)))
    left, right = _left_over([a.paragraphs[k][0] for k in mine], [b.paragraphs[k][0] for k in theirs])
    return [mine[k] for k in left], [theirs[k] for k in right]


def _leaves(p: Print, at: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(p.paragraphs[k][1] for k in at), "<u8")[::2]


def likeness(a: Print, b: Print) -> float:
    """0 to 1 by the trees' branches: the share of leaves in common (Dice). 1 if the roots are equal, and only then."""
    if a.text == b.text:
        return 1.0
    mine, theirs = (_leaves(p, at) for p, at in zip((a, b), open_paragraphs(a, b)))
    (x, n), (y, m) = np.unique(mine, return_counts=True), np.unique(theirs, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    total = sum(len(q[1]) for p in (a, b) for q in p.paragraphs) // 16
    apart = len(mine) + len(theirs) - 2 * int(np.minimum(n[i], m[j]).sum())
    return min(0.999999, 1 - apart / total) if total else 0.0


def estimate(a: str, b: str) -> float:
    """likeness from two fingerprints' strings alone, estimated by their slots."""
    if a == b:
        return 1.0
    x, y = (np.array([-1 if s[k : k + 2] == "--" else int(s[k : k + 2], 16) for k in range(0, 2 * SLOTS, 2)]) for s in (a.split(":")[1], b.split(":")[1]))
    either, both = int(((x >= 0) | (y >= 0)).sum()), (x >= 0) & (y >= 0)
    jaccard = max(0.0, (int((x == y)[both].sum()) - int(both.sum()) / 256) / max(either, 1) * 256 / 255)
    return min(0.999, 2 * jaccard / (1 + jaccard))


def differing(a: Print, b: Print, text_a: str) -> list[tuple[int, int]]:
    """The parts [start, end) of a's text whose pieces b's tree doesn't have, in order; parts that meet are one. Only branches whose digests differ are entered."""
    mine, theirs = open_paragraphs(a, b)
    if not mine:
        return []
    there = Counter(_leaves(b, theirs).tolist())
    lines = text_a.split("\n")
    starts = list(accumulate((len(x) + 1 for x in lines), initial=0))
    out: list[tuple[int, int]] = []
    for k in mine:
        at = starts[k]
        for piece, digest in zip(_pieces(lines[k]), _leaves(a, [k]).tolist()):
            if there[digest] > 0:
                there[digest] -= 1
            elif out and out[-1][1] == at:
                out[-1] = out[-1][0], at + len(piece)
            else:
                out.append((at, at + len(piece)))
            at += len(piece)
    return out


def trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per node: doc_id, level (0 root, 1 section, 2 paragraph, 3 piece), start, end (code points), digest (hex).

    Null texts count as empty (a root, a section and a paragraph of length 0). Repeated rows and null ids stay. No shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("level", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("digest", pa.string())])

    def nodes(doc_id, node: Node, level: int) -> Iterator[tuple]:
        yield doc_id, level, node.start, node.end, node.digest.hex()
        for c in node.children:
            yield from nodes(doc_id, c, level + 1)

    def run(batches):
        return batched((n for i, t in rows(batches, "id", "text") for n in nodes(i, tree(t), 0)), schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, level int, start long, end long, digest string")


def edited_by(text: str, next_text: str) -> str:
    """text, with its last quarter replaced by as many code points from the start of next_text, or by all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + next_text[:n]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("first_change", pa.int64()), ("changed_chars", pa.int64())])
_KEY = np.dtype([("id", np.int64), ("tie", np.int64)])
_LEAST = -(2**63)


def _keys(pairs: list[tuple]) -> np.ndarray:
    """Pairs of id and hash of the text as an array in the order of rows: null ids first."""
    return np.array([(_LEAST if i is None else i, t) for i, t in pairs], _KEY)


def _batch_keys(b: pa.RecordBatch) -> np.ndarray:
    out = np.empty(b.num_rows, _KEY)
    out["id"], out["tie"] = pc.fill_null(b.column("id"), _LEAST).to_numpy(), b.column("tie").to_numpy()
    return out


def _places(splits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The bucket of every key: how many splits are at or before it."""
    at = np.searchsorted(splits["id"], keys["id"], "left")
    to = np.searchsorted(splits["id"], keys["id"], "right")
    for k in np.flatnonzero(to > at).tolist():
        at[k] += np.searchsorted(splits["tie"][at[k] : to[k]], keys["tie"][k], "right")
    return at


def _splits(chosen: DataFrame, n: int) -> np.ndarray:
    """Where n buckets of about as many rows begin. An id, or null, that fills several buckets is split there by the hash of its texts."""
    q = chosen.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 20 * n).alias("splits"), F.count("*").alias("rows"), F.count_if(F.col("id").isNull()).alias("nulls")).first()
    shares = Counter(q["splits"] or [])
    if q["rows"]:
        shares[None] += n * q["nulls"] // q["rows"]
    return _keys(sorted(((i, _LEAST + (k * 2**64 // m)) for i, m in shares.items() for k in range(0 if i is not None else 1, m)), key=lambda x: (x[0] is not None, x[0] or 0, x[1])))


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, which takes its end from the next document in id order (after the last: the first).

    One shuffle of texts: rows go to buckets between quantiles of (id, hash of the text), and the first row of a bucket goes to the bucket with rows
    before it as well, so that every row meets its successor. Null texts count as empty. Null ids come first; repeated ids
    stay, ordered by the hash of their texts, and follow one another. A table of one row is its own successor; an empty table gives no rows.
    near_edited and near_next go through the branches of the trees whose roots and slots the fingerprint columns show; ``estimate`` gives about the same from two such columns alone (a test holds
    it near them on the query's rows). first_change and changed_chars say where the text has pieces that
    the edited text's tree lacks, and how many characters they have (null and 0 if there are none)."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    splits = _splits(chosen, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_places(splits, _batch_keys(b)), pa.int32()), b.column("id"), b.column("tie")], names=["bucket", "id", "tie"])

    firsts = chosen.select("id", "tie").mapInArrow(buckets, "bucket int, id long, tie long").groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull(), "id", "tie")).alias("first")).orderBy("bucket").collect()
    heads = _keys([(r["first"]["id"], r["first"]["tie"]) for r in firsts])
    before = np.array([r["bucket"] for r in firsts[-1:] + firsts[:-1]], np.int64)  # the bucket with rows before each head, and the last one before the first
    dealt = pa.schema([("bucket", pa.int32()), ("ahead", pa.int32()), ("id", pa.int64()), ("tie", pa.int64()), ("text", pa.string())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = _batch_keys(b)
            at = np.minimum(_places(heads, keys) - 1, len(heads) - 1)
            again = np.flatnonzero(heads[at] == keys)
            for take, to, ahead in ((np.arange(len(keys)), _places(splits, keys), 0), (again, before[at[again]], 1)):
                if len(take):
                    part = b.take(pa.array(take))
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(np.full(len(take), ahead), pa.int32()), part.column("id"), part.column("tie"), part.column("text").cast(pa.string())], schema=dealt)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        waiting = None  # bucket, id, text, fingerprint, its paragraphs
        for bucket, ahead, doc_id, text in rows(batches, "bucket", "ahead", "id", "text"):
            text, known, own = text or "", {}, None
            if waiting and waiting[0] == bucket:
                own = fingerprint(text, known)
                _, i, t, f, there = waiting
                e = edited_by(t, text)
                fe = f if e == t else fingerprint(e, there)
                parts = differing(f, fe, t)
                yield i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), f.text, fe.text, likeness(f, fe), likeness(f, own), parts[0][0] if parts else None, sum(y - x for x, y in parts)
            waiting = None if ahead else (bucket, doc_id, text, own or fingerprint(text, known), known)

    moved = chosen.mapInArrow(deal, "bucket int, ahead int, id long, tie long, text string").repartition("bucket").sortWithinPartitions("bucket", "ahead", "id", "tie", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, first_change long, changed_chars long"
    return moved.mapInArrow(lambda batches: batched(results(batches), _OUT), schema)
