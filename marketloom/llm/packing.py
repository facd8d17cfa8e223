"""Order-preserving packing of documents into token sequences by dynamic programming."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import in_order, rows, slabs
from .tokens import word_encoder

#: What a cut costs, in units of one padded token.
SENTENCE_CUT, INNER_CUT, PER_WINDOW = 6, 40, 2
#: Besides every sentence end, every so many ids may be a cut.
INNER_EVERY = 64
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def best_cuts(places: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """The cuts, as indices into ``places``, that cover [places[0], places[-1]) in order with the least cost.

    A window between two neighbouring cuts is at most ``window`` long. It costs its padding to ``window``, none if its
    length is a power of two, plus PER_WINDOW and its right cut's penalty. Neighbouring places are at most ``window`` apart.
    For a right end j the padded cost is window - places[j] + min(cost[i] + places[i]) over the i in reach; the
    reach only moves right, so a monotone queue has the minimum at its head. Lengths of 1, 2, 4 ... are tried besides."""
    m = len(places)
    exact: dict[int, list[int]] = {}
    for k in range(window.bit_length()):
        if (1 << k) < window:
            at = np.searchsorted(places, places - (1 << k))
            for j in np.flatnonzero(places[np.minimum(at, m - 1)] == places - (1 << k)).tolist():
                exact.setdefault(j, []).append(int(at[j]))
    pos, pen = places.tolist(), (penalty + PER_WINDOW).tolist()
    cost, source = [0] * m, [0] * m
    values, queue, head = [pos[0]], [0], 0  # cost[i] + places[i] and i, rising in both from head on
    for j in range(1, m):
        p = pos[j]
        while pos[queue[head]] < p - window:
            head += 1
        best, i = values[head] + window - p, queue[head]
        if j in exact:
            for x in exact[j]:
                if cost[x] < best:
                    best, i = cost[x], x
        cost[j] = best = best + pen[j]
        source[j] = i
        best += p
        while len(values) > head and values[-1] >= best:
            values.pop()
            queue.pop()
        values.append(best)
        queue.append(j)
    cuts = [m - 1]
    while cuts[-1]:
        cuts.append(source[cuts[-1]])
    return cuts[::-1]


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream of ids may be cut, and the penalty there: none at a document's end, little at every sentence's."""
    total = len(ids)
    penalty = np.full(total + 1, -1, np.int64)
    penalty[np.arange(0, total, min(INNER_EVERY, window))] = INNER_CUT
    penalty[np.flatnonzero(ends_sentence.take(ids, mode="clip")) + 1] = SENTENCE_CUT
    penalty[doc_ends] = 0
    penalty[[0, total]] = 0
    places = np.flatnonzero(penalty >= 0)
    return places, penalty[places]


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", run_ids: int = 1 << 19, with_ids: bool = True) -> DataFrame:
    """Pack every document's ids, with ``end_id`` behind them, into sequences of at most ``window`` ids.

    Documents follow one another in ascending ``id_col`` order, also across sequences. Windows are chosen by best_cuts
    over runs of about ``run_ids`` ids, so that memory is bounded by a run or the largest document, whichever is larger.
    Returns one row per piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id
    (rising with the order), offset in the sequence, and ids (little-endian uint32) if asked for.
    Null texts count as empty and give the end id alone. Rows with a null id come first, rows of one id follow by a hash of their texts; repeated rows are packed
    one by one. An empty table gives no rows. Other columns are ignored."""

    def run(encoder, part: int) -> callable:
        names = encoder.library.get_vocab()
        ends = np.zeros(max(max(names.values()), end_id) + 1, bool)
        ends[[i for t, i in names.items() if t.endswith("</w>") and t[:-4] and t[:-4][-1] in ".!?"]] = True
        ends[end_id] = False
        done = [0]

        def packed(doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
            doc_ends = np.cumsum(lengths)
            places, penalty = cut_places(ids, doc_ends, ends, window)
            cuts = places[best_cuts(places, penalty, window)]
            edges = np.union1d(cuts, doc_ends)
            edges = np.union1d(edges, [0])
            begin, end = edges[:-1], edges[1:]
            doc = np.searchsorted(doc_ends, begin, "right")
            seq = np.searchsorted(cuts, begin, "right") - 1
            raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
            pieces = [raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), end.tolist())]
            columns = [doc_ids[i] for i in doc.tolist()], begin - (doc_ends - lengths)[doc], end - begin, [zlib.crc32(p) for p in pieces], lengths[doc], (part << 33) + done[0] + seq, begin - cuts[seq], [bytes(p) if with_ids else None for p in pieces]
            done[0] += len(cuts) - 1
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _OUT)], schema=_OUT)

        return packed

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        packed = run(encoder, TaskContext.get().partitionId())
        doc_ids, ids, lengths = [], np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for slab in slabs(rows(batches, "id", "text"), 1, 4_000_000):
            got, n = encoder.encode([t for _, t in slab], end=end_id)
            doc_ids += [i for i, _ in slab]
            ids, lengths = np.concatenate([ids, got]), np.concatenate([lengths, n])
            del got
            while len(ids) >= run_ids:
                docs_in = int(np.searchsorted(ends := np.cumsum(lengths), run_ids)) + 1
                yield packed(doc_ids[:docs_in], ids[: ends[docs_in - 1]], lengths[:docs_in])
                doc_ids, ids, lengths = doc_ids[docs_in:], ids[ends[docs_in - 1] :], lengths[docs_in:]
        if doc_ids:
            yield packed(doc_ids, ids, lengths)

    out = in_order(docs, id_col, text_col).mapInArrow(partition, SCHEMA)
    return out if with_ids else out.drop("ids")
