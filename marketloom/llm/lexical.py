"""Ranked lexical search: postings in term buckets, integer scores, the best documents of each item."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows, shared_folder, slabs, written

#: Bytes of UTF-8 that end a term become spaces, A-Z become a-z; digits, letters and all that is not ASCII stay.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
POSTING = pa.schema([("term", pa.string()), ("row", pa.int64()), ("tf", pa.int64()), ("n", pa.int64())])
#: Postings of no term stand for their documents; their tf is the document's id, which no other posting has to carry.
DOCUMENTS = -1


def terms(text: str | None) -> list[bytes]:
    """The maximal runs [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+ of a text, A-Z in lower case, as UTF-8."""
    return (text or "").encode().translate(TERM_BYTES).split()


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A posting for each document and term, and one without a term for each document that has terms."""
    for slab in slabs(rows(batches, "row", "doc_id", "text"), 2, 500_000):
        found, times, per, lengths = [], [], [], []
        for _, doc_id, text in slab:
            held = Counter(terms(text))
            n = sum(held.values())
            found.extend(held)
            times.extend(held.values())
            if n:
                found.append(None)
                times.append(doc_id)
            per.append(len(held) + (n > 0))
            lengths.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(np.repeat(np.array([r for r, _, _ in slab]), per)), pa.array(times, pa.int64()), pa.array(np.repeat(np.array(lengths), per))], schema=POSTING)


@dataclass(frozen=True)
class Index:
    """postings: bucket, term, row (of the table, unique), tf, n (the document's terms), in a folder per bucket and sorted by term there; in the bucket DOCUMENTS, without a term, tf is the document's id.
    documents: those that have terms. length: all their terms with repeats."""

    postings: DataFrame
    buckets: int
    documents: int
    length: int


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 64, salts: int = 16) -> Index:
    """Postings of all terms of all rows, written in the shared folder.

    A term's postings are dealt over ``salts`` parts by their rows, so that a term of every document is no task of its own. Each row is a document, repeated rows and rows
    without an id too. Null and empty texts have no terms and don't count as documents. Texts are whole; one document and its terms have to fit in a worker."""
    chosen = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = chosen.mapInArrow(_postings, "term string, row long, tf long, n long")
    bucket = F.when(F.col("term").isNull(), DOCUMENTS).otherwise(bucket_of(F.col("term"), buckets))
    path = shared_folder(docs.sparkSession)
    dealt = found.repartition(bucket, F.pmod(F.hash("row"), F.lit(salts))).withColumn("bucket", bucket)
    dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
    postings = docs.sparkSession.read.schema("term string, row long, tf long, n long, bucket int").parquet(path)
    total = postings.where(F.col("bucket") == DOCUMENTS).agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    return Index(postings, buckets, total.n, total.l)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for item, text in rows(batches, "item_id", "text"):
        held = Counter(terms(text))
        yield pa.RecordBatch.from_arrays([pa.array([item] * len(held), pa.int64()), pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["item_id", "term", "times"])


def weighed(of: Index, items: DataFrame) -> DataFrame:
    """item_id, bucket, term, w (its weight times its repeats in the item) for the terms that some document holds.

    w = floor(1000 * ln((2N + 2) / (2df + 1))), at least 0."""
    wanted = items.groupBy("term").agg(F.first(bucket_of(F.col("term"), of.buckets)).alias("bucket"))
    df = of.postings.join(wanted, ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.count("*").alias("df"))
    w = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * of.documents + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0))))
    return items.join(df, "term").select("item_id", "bucket", "term", (w.cast("long") * F.col("times")).alias("w"))


def search(of: Index, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text", most_broadcast: int = 200_000) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each item (fewer where there are not so many), equal scores by ascending doc_id, nulls last.

    A document's m is 75 + (25 n N) div L; a term adds w * ((10**9 tf) div (1000 tf + 12 m)), all in 64-bit integers (25 n N has to stay below 2**63).
    Postings of the items' terms are dealt by row, meet the items there, and a document's sum is whole in its task; only the k best of an item and task move on.
    Documents' ids meet their rows there too, so postings don't carry them.
    So the items' terms are broadcast; beyond ``most_broadcast`` of them (or 32 MB of terms) they are joined by term and salt instead, and the sums shuffled.
    Repeated item rows count once; different texts of one item_id are one item. Items without terms, or whose terms no document has, have no rows."""
    chosen = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct()
    counted = chosen.mapInArrow(_item_terms, "item_id long, term string, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))
    wanted = written(weighed(of, written(counted)))
    size = wanted.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length("term") + 64), F.lit(0)).alias("bytes")).first()
    small = size.rows <= most_broadcast and size.bytes <= 32 << 20
    m = F.expr(f"75 + (25L * n * {of.documents}L) div {max(1, of.length)}L")
    hit = of.postings.where(F.col("bucket") != DOCUMENTS).withColumn("m", m)
    keys = wanted.select("bucket", "term").distinct()
    if small:
        hit = hit.join(F.broadcast(keys), ["bucket", "term"], "left_semi").select("term", "row", "tf", "m").repartition("row")
        met = hit.join(F.broadcast(wanted.drop("bucket")), "term")
    else:
        salts = 32
        salted = wanted.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        met = hit.withColumn("salt", F.pmod(F.hash("row"), F.lit(salts))).join(salted, ["bucket", "term", "salt"])
    score = F.sum(F.expr("w * ((1000000000L * tf) div (1000L * tf + 12L * m))"))
    scored = met.groupBy("item_id", "row").agg(score.alias("score")).where("score > 0")
    ids = of.postings.where(F.col("bucket") == DOCUMENTS).select("row", F.col("tf").alias("doc_id")).hint("shuffle_hash")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    return scored.join(ids, "row").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
held AS (SELECT row, doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS term FROM docs WHERE len(ts) > 0),
postings AS (SELECT row, doc_id, n, term, count(*) AS tf FROM held GROUP BY ALL),
total AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(ts)) AS BIGINT) AS big_l FROM docs WHERE len(ts) > 0),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
wanted AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (SELECT item_id, term, count(*) * CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM wanted JOIN dfs USING (term), total GROUP BY item_id, term, big_n, df),
scored AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score FROM postings JOIN weights USING (term), total GROUP BY item_id, row, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, row) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
