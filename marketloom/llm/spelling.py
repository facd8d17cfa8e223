"""Grouping of spelling variants: words one code point apart, found by rolling hashes of what deletions leave."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows, slabs, written

#: Latin-1 bytes that end a run become spaces, A-Z become a-z. Code points beyond Latin-1 are encoded as "?", which ends a run.
RUN_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: An odd 64-bit base of the polynomial hashes; arithmetic is modulo 2**64 and equal hashes are verified on strings.
BASE = 0x9E3779B97F4A7C15
#: Different words that a task counts before it passes them on.
MOST_WORDS = 200_000


def runs(text: str | None) -> list[bytes]:
    """The maximal runs [A-Za-z\\u00C0-\\u00FF]+ of a text, A-Z in lower case, as Latin-1."""
    return (text or "").encode("latin-1", "replace").translate(RUN_BYTES).split()


def changed(doc_id, held: Counter, every: int) -> Iterator[tuple[bytes, int]]:
    """The runs of one document with their counts; a run whose h is divisible by ``every`` loses the code point h % length.

    h: crc32 of the UTF-8 of "<doc_id>:<run>"."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in held.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, least_letters: int = 6, least_count: int = 5) -> DataFrame:
    """word, n of the words of at least so many code points that occur so often in the whole texts, after their planned deletions.

    Null and empty texts have none; repeated rows count each; a null id stands as an empty text before the colon."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return b

        for slab in slabs(rows(batches, "id", "text"), 1):
            for doc_id, text in slab:
                for run, n in changed(doc_id, Counter(r for r in runs(text) if len(r) >= least_letters), every):
                    if len(run) >= least_letters:
                        total[run] += n
            if len(total) >= MOST_WORDS:
                yield out()
        yield out()

    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word's number, place, cut, key) of each word whole (place -1), of what is left without each code point (place -2, the code point at cut goes), and of the same with the place in the key (place = cut).

    Two words differ by one replaced code point if they leave the same at the same place, by an inserted one if one whole word is what the other leaves.
    A word's hash is the sum of code point * BASE**place. Running sums with the code points at their own places and at places one lower give, as differences, the
    prefix before place i and the suffix behind it as it stands once i is gone. Equal neighbours leave the same, so one of them does for place -2."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    word, starts = np.repeat(np.arange(len(words)), lengths), np.cumsum(lengths) - lengths
    place = np.arange(len(points)) - starts[word]
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(lengths.max(initial=1)), BASE, np.uint64)]))
    own, lower = np.cumsum(points * powers[place]), np.cumsum(points * powers[np.maximum(place - 1, 0)])
    before, ends = own - points * powers[place], starts + lengths - 1
    whole = own[ends] - before[starts]
    without = (before - before[starts][word]) + (lower[ends][word] - lower)
    first = np.concatenate([[True], (points[1:] != points[:-1]) | (word[1:] != word[:-1])])
    size = lengths.astype(np.uint64)

    def key(h: np.ndarray, kind: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29)) ^ kind) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    at_place = (place.astype(np.uint64) + np.uint64(1)) << np.uint64(32)
    keys = np.concatenate([key(whole, size), key(without[first], (size - np.uint64(1))[word[first]]), key(without, (size - np.uint64(1))[word] | at_place)])
    number = np.concatenate([np.arange(len(words)), word[first], word])
    return number, np.concatenate([np.full(len(words), -1), np.full(first.sum(), -2), place]), np.concatenate([np.zeros(len(words), np.int64), place[first], place]), keys


KEYED = pa.schema([("key", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("place", pa.int32()), ("cut", pa.int32())])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for slab in slabs(rows(batches, "word", "n"), 0, 100_000):
        words, counts = pa.array([w for w, _ in slab], pa.string()), np.array([n for _, n in slab])
        number, place, cut, key = deletion_keys([w for w, _ in slab])
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), words.take(pa.array(number)), pa.array(counts[number]), pa.array(place.astype(np.int32)), pa.array(cut.astype(np.int32))], schema=KEYED)


def _best(members: list[tuple[str, int]]) -> list[tuple[str, int] | None]:
    """For each of the members, the other one of largest n, ties to the smallest word."""
    order = sorted(members, key=lambda m: (-m[1], m[0]))
    return [order[1] if m == order[0] else order[0] for m in members]


def _group(group: list[tuple]) -> Iterator[tuple]:
    """(word, near words in this group, n and word of the best of them) of rows of one key; strings decide, so words that share a key by chance are told apart."""
    left: dict[tuple[int, str], list] = {}
    for _, word, n, place, cut in group:
        kind, rest = (-1, word) if place == -1 else (-1, word[:cut] + word[cut + 1 :]) if place == -2 else (place, word[:place] + word[place + 1 :])
        left.setdefault((kind, rest), []).append((word, n, place))
    for (kind, rest), held in left.items():
        if len(held) < 2:
            continue
        if kind >= 0:  # one code point replaced: all of them are near each other
            members = [(w, n) for w, n, _ in held]
            for (w, _), (b, bn) in zip(members, _best(members)):
                yield w, len(members) - 1, bn, b
        elif whole := next(((w, n) for w, n, p in held if p == -1), None):  # one inserted: the whole word and each of the others
            longer = [(w, n) for w, n, p in held if p == -2]
            b, bn = min(longer, key=lambda m: (-m[1], m[0]))
            yield whole[0], len(longer), bn, b
            yield from ((w, 1, whole[1], whole[0]) for w, _ in longer)


NEAR = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in sorted rows. Rows alone with their key are passed over in vectors."""
    held: list[tuple] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("key").to_numpy()
        same = np.concatenate([[False], key[1:] == key[:-1]])
        busy = same | np.concatenate([same[1:], [False]])
        busy[[0, -1]] = True  # what goes before and comes next isn't known
        part = b.filter(pa.array(busy))
        out: list[tuple] = []
        for r in zip(*(part.column(c).to_pylist() for c in KEYED.names)):
            if held and held[0][0] != r[0]:
                out.extend(_group(held) if len(held) > 1 else ())
                held = []
            held.append(r)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), NEAR)], schema=NEAR)
    if out := list(_group(held)) if len(held) > 1 else []:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), NEAR)], schema=NEAR)


def near_words(words: DataFrame, parts: int | None = None) -> DataFrame:
    """word, n_near, best, best_n for the words (word, n; each once) that have near words: of how many they differ by one inserted, deleted or replaced code point, and the one of largest n.

    The keys' high bits deal them to parts (a radix partition), where they are sorted; an equal key is a run of rows. No pairs are listed:
    words that share what is left at one place are all near, so a word counts the others and takes the first or second by n. A run holds at most a word for each letter
    of the alphabet, or for each letter and place, whatever the table's size; every pair of words meets in one run only, so counts add up."""
    spark = words.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = words.select("word", "n").mapInArrow(_keyed, "key long, word string, n long, place int, cut int")
    radix = F.shiftrightunsigned("key", 40).cast("int")
    sorted_keys = keyed.repartition(parts, radix).sortWithinPartitions("key")
    found = sorted_keys.mapInArrow(_near, "word string, near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("first")).select("word", "n_near", F.col("first.best").alias("best"), (-F.col("first.minus")).alias("best_n"))


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table (word, n) with each word once.

    form: the near word of largest n (ties: smallest in code point order) if that n is at least ``times`` the word's, else null; root: the last of the forms.
    Along forms n grows ``times``-fold, so chains are as long as its logarithm and are followed by doubling: each round is a join of the words whose form has a form."""
    words = written(words)
    near = near_words(words)
    formed = F.col("best_n") >= F.lit(times) * F.col("n")
    with_form = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    with_form = written(with_form)
    links = with_form.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = written(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not links.where("moved").limit(1).count():
            break
        links = links.drop("moved")
    roots = links.select("word", "root")
    return with_form.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
held AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS times, hex(encode(doc_id || ':' || run)) AS x FROM held WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x)::BIGINT, 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM runs, crc),
counted AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(times)::BIGINT AS n FROM hashed GROUP BY word),
words AS (SELECT word, n FROM counted WHERE length(word) >= 6 AND n >= 5),
cuts AS (SELECT word, n, unnest(range(1, length(word)::BIGINT + 1)) AS i, length(word) AS len FROM words),
left_over AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM cuts),
inserted AS (SELECT DISTINCT l.word AS a, l.n AS an, w.word AS b, w.n AS bn FROM left_over l JOIN words w ON l.rest = w.word),
pairs AS (SELECT a AS word, b AS other, bn AS other_n FROM inserted UNION ALL SELECT b, a, an FROM inserted
  UNION ALL SELECT x.word, y.word, y.n FROM left_over x JOIN left_over y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word),
near AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS best, max(other_n) AS best_n FROM pairs GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN near USING (word)),
chain AS (SELECT word, word AS at, form AS next FROM formed UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
