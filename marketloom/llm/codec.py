"""A range coder for blocks of token ids whose mixed order-0, order-1 and order-2 model adapts.

Each block starts from the same empty model and carries a checksum, so that blocks are written, read, lost
and repeated one by one. A block's ids are cut into lanes of equal length. All lanes move one id at a time and
share one model, so that a step is a few vector operations over the lanes and not a loop over ids.

The model says P(id) = w2 [id = a] + w3 [id = c] + w1 [id = b] + w0 P0(id). a and c are the ids that most lately
followed the last two ids, b the one that followed the last id, P0 the frequencies in the block so far. The weights w depend on
how often a and b came true lately and on whether they agree; they are counted in the block too. Everything
is in whole numbers, so a decoder on another machine gets the same model."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC, HEAD = b"MLTB", struct.Struct("<4sBxHIIII")
LANES, VOCAB = 8192, 1 << 16
_U = np.uint64
_TOP, _LEAST, _DIGIT = _U(1 << 48), _U(1 << 40), _U(16)
_WEIGHT_BITS, _ID_BITS = _U(16), _U(20)
_HASH_BITS, _CUM_BITS, _FREQ = 18, _U(21), _U((1 << 21) - 1)


def _confidence_steps() -> np.ndarray:
    """What an event does to the guesses, by its place, as one number: bits 0 and 1 say that the first guess of order 2, that of order 1
    is replaced, bits 2 to 5 and 6 to 9 have 8 plus what is added to id * 8 + confidence.

    A place is kind * 128 + confidence of order 2 * 16 + confidence of order 1 * 2 + whether they agree; kind 0 says that the first guess of order 2
    was right, 1 its second, 2 order 1, 3 none. A right guess gains confidence, a wrong one loses half, and one of at most 2 is replaced."""
    place = np.arange(512)
    kind, agree = place >> 7, place & 1
    out = np.zeros(512, np.int32)
    for order, (sure, right) in enumerate(((place >> 4 & 7, kind == 0), (place >> 1 & 7, (kind == 2) | (kind == 0) & (agree == 1)))):
        replaced = ~right & (sure <= 2)
        add = np.where(right, sure < 7, np.where(replaced, sure >> 1, (sure >> 1) - sure))
        out += replaced << order | add + 8 << 2 + 4 * order
    return out


_STEPS = _confidence_steps()


class _Model:
    """The statistics of one block. predict() and learn() are called in turn, alike by the encoder and the decoder.

    Guesses are kept as id * 8 + confidence, by the last id and by a hash of the last two, and there a second id besides."""

    def __init__(self, vocab: int, lanes: int, inverse: bool):
        self.vocab, self.inverse = vocab, inverse
        self.after1, self.after2 = np.zeros(vocab, np.int32), np.zeros(1 << _HASH_BITS, np.int64)  # after2: a row is two int32, the guess and the second id, read and written at once
        self.seen, self.counts = np.zeros(vocab, np.int64), np.zeros(512, np.int64)
        self.last, self.hashed, self.mixed = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.zeros(lanes, np.uint32)
        self.step, self.due, self.ids, self.places = 0, 1, [], []
        self._refresh()

    def _refresh(self) -> None:
        if self.ids:
            self.seen += np.bincount(np.concatenate(self.ids), minlength=self.vocab)
            self.counts += np.bincount(np.concatenate(self.places), minlength=512)
            self.ids, self.places = [], []
        by_kind = self.counts.reshape(4, 128)
        n = by_kind.sum(0) + 8
        weights = 1 + by_kind[:3] * 60000 // n
        upto = np.cumsum(weights, 0)
        # By place, where its share of the range begins and how large it is, in one number; by confidences, where the second, third and fourth share begin.
        self.shares = np.concatenate([weights[0], *(upto[k] << 21 | weights[k + 1] for k in (0, 1)), upto[2] << 21 | (1 << 16) - upto[2]]).astype(_U)
        self.bounds = (upto[0] << 42 | upto[1] << 21 | upto[2]).astype(_U)
        room, total = (1 << 20) - self.vocab, int(self.seen.sum())
        f = 1 + (self.seen * room // total if total else np.full(self.vocab, room // self.vocab))
        f[int(f.argmax())] += (1 << 20) - int(f.sum())
        # Frequency and the sum of those before, in one number. The row behind the last id is the whole range, for ids that a guess has named.
        self.slots = np.append((np.cumsum(f) - f << 21) + f, 1 << 20).astype(_U)
        if self.inverse:
            self.owner = np.repeat(np.arange(self.vocab, dtype=np.uint16), f)

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The two guesses of order 2, that of order 1, and the place of their confidences in the tables of weights."""
        self.v1, (self.v2, self.c) = self.after1.take(self.last, mode="clip"), self.after2.take(self.hashed, mode="clip").view(np.int32).reshape(-1, 2).T
        self.a, b = self.v2 >> 3, self.v1 >> 3
        return self.a, self.c, b, ((self.v2 & 7) << 4) + ((self.v1 & 7) << 1) + (self.a == b)

    def learn(self, ids: np.ndarray, place: np.ndarray) -> None:
        """ids (int32) came true at these places."""
        self.ids.append(ids)
        self.places.append(place)
        fresh = ids << 3
        steps = _STEPS.take(place, mode="clip")
        newer = ids + ((self.a - ids) & -(steps & 1))  # a first guess that is replaced becomes the second, else the id that came instead of it does
        after = np.empty((len(ids), 2), np.int32)
        after[:, 0] = self.v2 + ((fresh - self.v2) & -(steps & 1)) + ((steps >> 2 & 15) - 8)
        after[:, 1] = self.c + ((newer - self.c) & -(ids != self.a).view(np.int8).astype(np.int32))
        self.after2[self.hashed] = after.view(np.int64)[:, 0]
        self.after1[self.last] = self.v1 + ((fresh - self.v1) & -(steps >> 1 & 1)) + ((steps >> 6) - 8)
        mixed = ids.astype(np.uint32) * np.uint32(0x9E3779B1)
        self.hashed = ((self.mixed + mixed) * np.uint32(0x85EBCA6B) >> np.uint32(32 - _HASH_BITS)).astype(np.int64)
        self.mixed, self.last = mixed * np.uint32(0x2545F491), ids.astype(np.int64)
        self.step += 1
        if self.step >= self.due:
            self.due = self.step + min(32, self.step)
            self._refresh()


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // 256))
    return lanes, -(-n // lanes)


def _kinds(second: np.ndarray, third: np.ndarray, fourth: np.ndarray) -> np.ndarray:
    """The kind times 128, from whether the first guess was wrong, the first two were, and all three."""
    return (second.view(np.int8) + third.view(np.int8) + fourth.view(np.int8)).astype(np.int32) << 7


def _ready(low: np.ndarray, width: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lanes whose upper digit is settled, with their low and width before it is shifted out; again while there are some.

    A range that has become too narrow around a change of the upper digit is cut there."""
    same = (low ^ (low + width)) < _TOP
    go = (same | (width < _LEAST)).nonzero()[0]
    lo, wi, same = low.take(go), width.take(go), same.take(go)
    while len(go):
        if not same.all():
            wi = np.where(same, wi, (_U(0) - lo) & (_LEAST - _U(1)))
        yield go, lo, wi
        lo, wi = lo << _DIGIT, wi << _DIGIT
        low[go], width[go] = lo, wi
        same = (lo ^ (lo + wi)) < _TOP
        more = (same | (wi < _LEAST)).nonzero()[0]
        go, lo, wi, same = go.take(more), lo.take(more), wi.take(more), same.take(more)


def encode_block(ids: np.ndarray, vocab: int = VOCAB) -> bytes:
    """The bytes of one block. Every id must be below ``vocab``, which is at most 65536."""
    n = len(ids)
    if n and int(ids.max()) >= vocab or not 1 <= vocab <= VOCAB:
        raise ValueError("an id is not below vocab, or vocab is not in 1..65536")
    crc = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
    if not n:
        return HEAD.pack(MAGIC, 2, 0, vocab, 0, 0, crc)
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Model(vocab, lanes, inverse=False)
    low, width = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    said: list[tuple[np.ndarray, np.ndarray]] = []  # lanes and the digits they put out, in order
    with np.errstate(over="ignore"):
        for x in grid:
            a, c, b, at = model.predict()
            second = x != a
            third = second & (x != c)
            fourth = third & (x != b)
            place = at + _kinds(second, third, fourth)
            part = width >> _WEIGHT_BITS
            share = model.shares.take(place, mode="clip")
            low += part * (share >> _CUM_BITS)
            part *= share & _FREQ
            part >>= _ID_BITS
            slot = model.slots.take(vocab + ((x - vocab) & -fourth.view(np.int8).astype(np.int32)), mode="clip")
            low += part * (slot >> _CUM_BITS)
            width = part * (slot & _FREQ)
            model.learn(x, place)
            for go, lo, wi in _ready(low, width):
                said.append((go.astype(np.int16), (lo >> _U(48)).astype(np.uint16)))
    end = (low + _U((1 << 32) - 1)) >> _U(32)  # whatever follows these two digits, the code stays in the range
    every = np.arange(lanes, dtype=np.int16)
    said += [(every, (end >> _U(16)).astype(np.uint16)), (every, (end & _U(0xFFFF)).astype(np.uint16))]
    lane = np.concatenate([x for x, _ in said])
    words = np.concatenate([x for _, x in said]).astype("<u2")[np.argsort(lane, kind="stable")]
    used = np.bincount(lane, minlength=lanes)
    return HEAD.pack(MAGIC, 2, 0, vocab, n, lanes, crc) + used.astype("<u4").tobytes() + words.tobytes()


def decode_block(block: bytes) -> np.ndarray:
    """The ids (uint32) of one block; ValueError if the block is damaged."""
    magic, version, _, vocab, n, lanes, crc = HEAD.unpack_from(block)
    if magic != MAGIC or version != 2:
        raise ValueError("not a token block")
    if not n:
        return np.zeros(0, np.uint32)
    if not 1 <= lanes <= LANES or _shape(n)[0] != lanes or not 1 <= vocab <= VOCAB or len(block) < HEAD.size + 4 * lanes:
        raise ValueError("damaged token block")
    steps = _shape(n)[1]
    used = np.frombuffer(block, "<u4", lanes, HEAD.size).astype(np.int64)
    if len(block) != HEAD.size + 4 * lanes + 2 * int(used.sum()):
        raise ValueError("damaged token block")
    words = np.concatenate([np.frombuffer(block, "<u2", -1, HEAD.size + 4 * lanes).astype(_U), np.zeros(8, _U)])
    at = np.cumsum(used) - used + 4
    code = words.take(at - 4) << _U(48) | words.take(at - 3) << _U(32) | words.take(at - 2) << _U(16) | words.take(at - 1)
    model = _Model(vocab, lanes, inverse=True)
    low, width = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    grid = np.empty((steps, lanes), np.int32)
    with np.errstate(over="ignore", divide="ignore"):
        for i in range(steps):
            a, c, b, at_weights = model.predict()
            part = width >> _WEIGHT_BITS
            ahead = code - low
            bound = model.bounds.take(at_weights, mode="clip")
            second, third, fourth = ahead >= part * (bound >> _U(42)), ahead >= part * (bound >> _CUM_BITS & _FREQ), ahead >= part * (bound & _FREQ)
            place = at_weights + _kinds(second, third, fourth)
            share = model.shares.take(place, mode="clip")
            low += part * (share >> _CUM_BITS)
            part *= share & _FREQ
            part >>= _ID_BITS
            x = np.where(third, b, np.where(second, c, a))
            go = fourth.nonzero()[0]
            width = part << _ID_BITS
            if len(go):
                wi, lo = part.take(go), low.take(go)
                q = np.minimum((code.take(go) - lo) // wi, _U((1 << 20) - 1))
                got = model.owner.take(q.view(np.int64), mode="clip")
                x[go] = got
                slot = model.slots.take(got, mode="clip")
                low[go] = lo + wi * (slot >> _CUM_BITS)
                width[go] = wi * (slot & _FREQ)
            grid[i] = x
            model.learn(x, place)
            for go, _, _ in _ready(low, width):
                to = at.take(go)
                code[go] = code.take(go) << _DIGIT | words.take(to, mode="clip")
                at[go] = to + 1
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n].astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("the checksum of a token block is wrong")
    return ids
