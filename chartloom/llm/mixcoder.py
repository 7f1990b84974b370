"""Adaptive context-mixing arithmetic coder for token ids, many independent blocks at a time.

Every block starts from the same state, so blocks are coded in lockstep: step t codes the t-th id of all blocks with
numpy. Inside a block, ids are numbered by their first occurrence. Orders 2 and 1 predict the next number from the last two or the last
one (tables of contexts with confidences). The chances that order 2, order 1 and order 0 (counts of the block so far) give to the
predicted number are mixed in the logistic domain with weights learned as coding goes on; that one binary
decision is coded. A missed id is coded by the order-0 counts without the prediction; an id new to the block is an escape there, with a
count of its own. The new ids themselves follow behind the numbers, each as its bit length, by adaptive frequencies, and its lower bits.

Order 0 gives a number that occurred c times 2c - 1 parts and the escape as many as there are numbers. New numbers get their part at once;
repeats are added up at steps that grow apart with the block (``_next_sums``), so that no step sums over the counts.
The coder has 64-bit bounds and 32-bit words. All model arithmetic is in integers, so any machine decodes alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_IDS = 4096
MOST_IDS = 1 << 16  # a block's parts must stay far below 2**20
_BITS2 = 12  # table size of order 2
_CLASSES = 33  # bit lengths of id + 1
_RATE = 5
_HASH = [np.array(x, np.uint32) for x in (0x9E3779B1, 0x85EBCA6B, 32 - _BITS2)]

# Logistic squash (-2047..2047 in 1/256 to a 12-bit chance), as integers.
SQUASH = np.round(4096 / (1 + np.exp(-(np.arange(4095) - 2047) / 256))).clip(1, 4095).astype(np.int32)
# The distribution that a seen class pulls towards: all classes keep a floor.
_TARGET = np.zeros((_CLASSES, _CLASSES), np.int32)
for _c in range(_CLASSES):
    _TARGET[_c, :] = np.arange(_CLASSES) * 32
    _TARGET[_c, _c + 1 :] += 65536 - _CLASSES * 32
_START = (np.arange(_CLASSES) * (65536 // _CLASSES)).astype(np.int32)


def _next_sums(t: int) -> int:
    """The step after t at which repeats are added up."""
    return t + max(4, t >> 3)


class _Counts:
    """Order 0 of n blocks. The parts of a number lie in a row; the next new number stands for the escape.

    Tables by number have a row for each number and a column for each block (``place``): frequent numbers lie close together.
    """

    def __init__(self, n: int, size: int, search: bool):
        small = size < 8191  # no sum exceeds 3 * size + 1
        self.stride, self.search = n // 32 * 32 + 48, search  # no power of two, which would crowd the cache
        self.kind, self.bits, packed = (np.uint16, 16, np.int32) if small else (np.uint32, 32, np.int64)
        self.count = np.zeros((size + 3, self.stride), np.int16 if small else np.int32)
        self.parts = np.zeros((size + 3) * self.stride, packed)  # first part << bits | how many: one memory access for both
        self.mask = np.array((1 << self.bits) - 1, packed)
        self.lanes = np.arange(n)
        self.fresh = np.ones(n, self.kind)  # the next new number
        self.seen = np.zeros(n, np.int32)  # parts of all numbers
        self.total = np.ones(n, np.int32)  # with those of the escape
        self.parts[self.stride + self.lanes] = 1
        self.summed, self.next = 0, _next_sums(0)
        if search:
            self._hold(n, np.zeros((1, n), np.int16))

    def place(self, numbers: np.ndarray) -> np.ndarray:
        """Where tables by number hold a number of each of the first blocks."""
        place = numbers.astype(np.int64)
        place *= self.stride
        place += self.lanes[: len(numbers)]
        return place

    def of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First part and how many."""
        held = self.parts.take(place)
        return held >> self.bits, held & self.mask

    def _hold(self, m: int, width: np.ndarray) -> None:
        """Write down the number that holds each part, for the first m blocks."""
        self.room = int(self.seen[:m].max(initial=0)) + self.next - self.summed + 1
        each = np.empty((m, len(width) + 1), np.int64)
        each[:, :-1] = width.T
        each[:, -1] = self.room - self.seen[:m]
        number = np.arange(len(width) + 1, dtype=self.kind)
        number[-1] = np.iinfo(self.kind).max  # no number yet
        self.holder = np.repeat(np.tile(number, m), each.ravel())
        self.places = self.lanes[:m] * self.room

    def holders(self, part: np.ndarray) -> np.ndarray:
        """The number that holds a part in each of the first blocks."""
        m = len(part)
        at = np.minimum(part, self.room - 1)
        at += self.places[:m]
        return np.minimum(self.holder.take(at), self.fresh[:m])

    def add_up(self, t: int, numbers: np.ndarray) -> None:
        """Add the steps before t that are not yet in the counts; ``numbers``: a row for each step."""
        m = numbers.shape[1]
        wide = int(self.fresh[:m].max(initial=1))
        at = numbers[self.summed : t].astype(np.int64)
        at *= m
        at += self.lanes[:m]
        count = self.count[:wide, :m]
        count += np.bincount(at.ravel(), minlength=m * wide).reshape(wide, m).astype(count.dtype)
        width = count + count
        width -= 1
        np.maximum(width, 0, out=width)
        ends = np.cumsum(width, axis=0, dtype=width.dtype)
        packed = (ends - width).astype(self.parts.dtype)
        packed <<= self.bits
        packed |= width
        self.parts.reshape(-1, self.stride)[:wide, :m] = packed
        self.seen[:m] = ends[-1]
        self.summed, self.next = t, _next_sums(t)
        known = self.fresh[:m] - 1
        self.parts[self.place(self.fresh[:m])] = self.seen[:m].astype(self.parts.dtype) << self.bits | known
        self.total[:m] = self.seen[:m] + known
        if self.search:
            self._hold(m, width)

    def append(self, numbers: np.ndarray, place: np.ndarray) -> None:
        """Where the number of the first blocks, which has this place, is the next new one, it has occurred now."""
        m = len(numbers)
        fresh = numbers == self.fresh[:m]
        who = fresh.nonzero()[0]
        if not len(who):
            return
        at, seen, number = place.take(who), self.seen.take(who), numbers.take(who)
        if self.search:
            self.holder[self.places.take(who) + seen] = number
        held = seen.astype(self.parts.dtype)
        held <<= self.bits
        held += 1
        self.parts[at] = held  # where the escape began
        at += self.stride
        held += self.mask  # the next part
        held += number
        self.parts[at] = held
        self.fresh[:m] += fresh
        self.seen[:m] += fresh
        self.total[:m] += fresh.view(np.uint8) << 1


class _Model:
    """State of n blocks of at most ``size`` ids."""

    def __init__(self, n: int, size: int, search: bool):
        self.counts = order0 = _Counts(n, size, search)
        self.kind = order0.kind
        # number << 3 | confidence, order 1 by number and then order 2 by hash: one memory access for both
        first = (size + 1) * order0.stride
        self.table = np.zeros(first + (n << _BITS2), self.kind)
        self.hashed = first + (order0.lanes << _BITS2)
        # What a confidence of order 1 (the same again if it agrees with the prediction) or 2 adds to the stretched chance, in 1/4096.
        self.trust = np.zeros(32 * n, np.int32)
        self.trust[: 16 * n] = 2047 << 4  # the middle of SQUASH
        self.trusts = np.stack([order0.lanes * 16, (n + order0.lanes) * 16])
        self.weight = np.full(n, 256, np.int32)  # of order 0, in 1/256
        self.log = np.round(np.log(np.maximum(np.arange(3 * size + 4), 1)) * 256).astype(np.int32)
        self.last, self.before = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        self.place = order0.lanes
        self.m = -1

    def _focus(self, m: int) -> None:
        """From now on the first m blocks."""
        self.m, self.at, self.r = m, np.empty((2, m), np.int64), np.empty((2, m), np.int64)
        self.last, self.before, self.weight, self.hashed, self.trusts = self.last[:m], self.before[:m], self.weight[:m], self.hashed[:m], self.trusts[:, :m]

    def predict(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """For the first m blocks: the number predicted (0: none, which never occurs) and its chance in 1/4096."""
        if m != self.m:
            self._focus(m)
        order0, at = self.counts, self.at
        at[0] = self.place[:m]
        h = self.before * _HASH[0]
        h += self.last * _HASH[1]
        h >>= _HASH[2]
        np.add(self.hashed, h, out=at[1])
        self.held = self.table.take(at)
        self.p, self.c = p, c = self.held >> 3, self.held & 7
        guess = p[1] - p[0]
        guess *= c[1] > 0
        guess += p[0]
        np.add(self.trusts, c, out=self.r)
        agrees = (p[0] == guess).view(np.uint8)
        agrees <<= 3
        self.r[0] += agrees
        self.q = self.trust.take(self.r)
        self.first, self.share = order0.of(order0.place(guess))
        self.rest = order0.total[:m] - self.share
        self.s = self.log.take(self.share)
        self.s -= self.log.take(self.rest)
        mixed = self.weight * self.s
        mixed >>= 8
        trust = self.q[0] + self.q[1]
        trust >>= 4
        mixed += trust
        self.chance = SQUASH.take(mixed, mode="clip")
        return guess, self.chance

    def cut(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First part and how many, without those of the prediction."""
        self.place = self.counts.place(numbers)
        first, count = self.counts.of(self.place)
        first -= self.share * (first > self.first)
        return first.astype(np.uint64), count.astype(np.uint64)

    def holders(self, part: np.ndarray) -> np.ndarray:
        """The number that holds a part, counted without those of the prediction."""
        part += self.share * (part >= self.first)
        return self.counts.holders(part)

    def update(self, t: int, numbers: np.ndarray, hit: np.ndarray, history: np.ndarray) -> None:
        """``history``: a row of numbers for each step so far, this one included."""
        m, held, order0 = self.m, self.held, self.counts
        error = hit.astype(np.int32)
        error *= 4095
        error -= self.chance
        self.s *= error
        self.s >>= 17
        self.weight += self.s
        error >>= 5
        self.q += error
        self.trust[self.r] = self.q
        # Right: one surer, up to 7. Wrong: half as sure; if hardly sure, the new number takes the place.
        # By sums of products, as masks that nobody can guess would slow the machine down.
        c = self.c
        right, less = self.p == numbers, c >> 1
        weak = less == 0
        entry = held - c
        entry |= less
        change = numbers << 3
        change |= 1
        change = change - entry
        change *= weak
        entry += change
        np.subtract(held, entry, out=change)
        change += c < 7
        change *= right
        entry += change
        self.table[self.at] = entry
        order0.append(numbers, self.place)
        self.before, self.last = self.last, numbers.astype(np.uint32)
        if t + 1 == order0.next:
            order0.add_up(t + 1, history[:, :m])
            self.weight[:] = self.weight.clip(-2048, 2048)


_NONE, _ONE, _TWELVE, _W, _MASK, _SMALL = (np.array(x, np.uint64) for x in (0, 1, 12, 32, 0xFFFFFFFF, 1 << 32))


class _Writer:
    """Bounds of n blocks and their words, which may hold a carry."""

    def __init__(self, n: int, size: int):
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, 2**64 - 1, np.uint64)
        self.words, self.count, self.most = np.zeros((n, size), np.uint64), np.zeros(n, np.int64), 0

    def take(self, rows: np.ndarray) -> None:
        """Put the blocks into another order."""
        self.low, self.range, self.words, self.count = self.low[rows], self.range[rows], self.words[rows], self.count[rows]

    def narrow(self, m: int, up: np.ndarray, width: np.ndarray) -> None:
        """Keep ``width`` from ``up`` above the lower bound on, in the first m blocks."""
        low = self.low[:m]
        low += up
        over = low < up
        if over.any():
            who = over.nonzero()[0]
            self.words[who, self.count[who] - 1] += np.uint64(1)
        who = (width < _SMALL).nonzero()[0]
        if len(who):
            self.most += 1
            if self.most + 3 >= self.words.shape[1]:
                self.most = int(self.count.max()) + 1
                if self.most * 9 >= self.words.shape[1] * 8 - 40:
                    self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
            at, some = self.count.take(who), low.take(who)
            self.words.ravel()[who * self.words.shape[1] + at] = some >> _W
            at += 1
            some <<= _W
            self.count[who], low[who] = at, some
            width[who] = width.take(who) << _W
        self.range[:m] = width

    def close(self) -> np.ndarray:
        """All words, carries added; the last one ends inside the bounds."""
        lanes, up = np.arange(len(self.low)), self.low + _MASK
        over = np.flatnonzero(up < self.low)
        self.words[over, self.count[over] - 1] += np.uint64(1)
        self.words[lanes, self.count] = up >> _W
        self.count += 1
        for k in range(self.words.shape[1] - 1, 0, -1):
            carry = self.words[:, k] >> _W
            if carry.any():
                self.words[:, k - 1] += carry
        return self.words.astype(np.uint32)


class _Reader:
    """The same for reading: ``code`` lies that far above the lower bound."""

    def __init__(self, words: np.ndarray):
        n, row = words.shape
        self.words, self.at = words.ravel(), np.arange(n) * row + 2
        self.code, self.range = (words[:, 0].astype(np.uint64) << _W) | words[:, 1], np.full(n, 2**64 - 1, np.uint64)
        self.ends = (np.arange(n) + 1) * row - 1  # a zero

    def take(self, rows: np.ndarray) -> None:
        """Put the blocks into another order."""
        self.code, self.range, self.at, self.ends = self.code[rows], self.range[rows], self.at[rows], self.ends[rows]

    def narrow(self, m: int, up: np.ndarray, width: np.ndarray) -> None:
        """Keep ``width`` from ``up`` above the lower bound on, in the first m blocks."""
        code = self.code[:m]
        code -= up
        who = (width < _SMALL).nonzero()[0]
        if len(who):
            at = self.at.take(who)
            code[who] = (code.take(who) << _W) | self.words.take(np.minimum(at, self.ends.take(who)))
            width[who] = width.take(who) << _W
            at += 1
            self.at[who] = at
        self.range[:m] = width


def _kinds(ids: np.ndarray) -> np.ndarray:
    """Bit length of id + 1, less one."""
    return np.frexp((ids + 1).astype(np.float64))[1].astype(np.int64) - 1


def _halves(kind: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Shift and width of the lower bits, upper half first: a step takes at most 16 bits."""
    low = np.minimum(kind, 16)
    return [(low, kind - low), (np.zeros_like(kind), low)] if (kind > 16).any() else [(np.zeros_like(kind), low)]


def _ends(cdf: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = np.arange(len(kind))
    first = cdf[rows, kind]
    last = np.where(kind + 1 < _CLASSES, cdf[rows, np.minimum(kind + 1, _CLASSES - 1)], 65536)
    return first.astype(np.uint64), (last - first).astype(np.uint64)


def _put_new(cdf: np.ndarray, out: _Writer, ids: np.ndarray) -> None:
    """The next new id of the first blocks."""
    m, kind = len(ids), _kinds(ids)
    first, count = _ends(cdf, kind)
    width = out.range[:m] >> np.uint64(16)
    out.narrow(m, width * first, width * count)
    for shift, bits in _halves(kind):
        width = out.range[:m] >> bits.astype(np.uint64)
        out.narrow(m, width * (((ids + 1 - (1 << kind)) >> shift) & ((1 << bits) - 1)).astype(np.uint64), width)
    cdf += (_TARGET[kind] - cdf) >> _RATE


def _get_new(cdf: np.ndarray, source: _Reader) -> np.ndarray:
    m = len(cdf)
    width = source.range[:m] >> np.uint64(16)
    part = np.minimum(source.code[:m] // width, np.uint64(65535)).astype(np.int32)
    kind = (cdf <= part[:, None]).sum(axis=1) - 1
    first, count = _ends(cdf, kind)
    source.narrow(m, width * first, width * count)
    ids = (1 << kind) - 1
    for shift, bits in _halves(kind):
        width = source.range[:m] >> bits.astype(np.uint64)
        value = np.minimum(source.code[:m] // width, ((1 << bits) - 1).astype(np.uint64))
        source.narrow(m, width * value, width)
        ids = ids + (value.astype(np.int64) << shift)
    cdf += (_TARGET[kind] - cdf) >> _RATE
    return ids


def _active(sizes: np.ndarray) -> np.ndarray:
    """How many blocks, longest first, reach each step."""
    return len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0] if len(sizes) else 0), side="right")


def _numbered(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids as numbers from 1 by first occurrence, and the ids by number."""
    coded = pc.dictionary_encode(pa.array(block, pa.uint32()))
    return np.asarray(coded.indices) + 1, np.asarray(coded.dictionary)


def _longest(sizes: np.ndarray) -> int:
    if (most := int(sizes.max(initial=1))) > MOST_IDS:
        raise ValueError(f"a block of {most} ids: at most {MOST_IDS} can be coded")
    return most


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Code every block of unsigned 32-bit ids on its own."""
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    sizes = np.array([len(blocks[k]) for k in order], dtype=np.int64)
    n, longest = len(order), _longest(sizes)
    model, out = _Model(n, longest, False), _Writer(n, 1032)
    rows, new = np.zeros((n, longest), model.kind), []
    for lane, k in enumerate(order):
        rows[lane, : sizes[lane]], ids = _numbered(blocks[k])
        new.append(ids)
    numbers = np.ascontiguousarray(rows.T)
    del rows
    for t, m in enumerate(_active(sizes).tolist()):
        x = numbers[t, :m]
        guess, chance = model.predict(m)
        hit = x == guess
        whole = out.range[:m]
        cut = (whole >> _TWELVE) * chance.astype(np.uint64)
        first, count = model.cut(x)
        width = whole - cut
        width //= model.rest.astype(np.uint64)
        first *= width
        first += cut
        np.copyto(first, _NONE, where=hit)
        width *= count
        np.copyto(width, cut, where=hit)
        out.narrow(m, first, width)
        model.update(t, x, hit, numbers)
    # The new ids, blocks with most of them first.
    distinct = np.array([len(ids) for ids in new], dtype=np.int64)
    turn = np.argsort(-distinct, kind="stable")
    out.take(turn)
    ids = np.zeros((int(distinct.max(initial=0)), n), np.int64)
    for lane, k in enumerate(turn):
        ids[: distinct[k], lane] = new[k]
    cdf = np.tile(_START, (n, 1))
    for t, m in enumerate(_active(distinct[turn]).tolist()):
        _put_new(cdf[:m], out, ids[t, :m])
    words = out.close()
    coded: list[bytes] = [b""] * n
    for lane, k in enumerate(turn):
        if sizes[k]:
            coded[order[k]] = words[lane, : out.count[lane]].astype("<u4").tobytes()
    return coded


def decode_blocks(coded: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """The ids of every block, given how many there are."""
    order = sorted(range(len(coded)), key=lambda k: -counts[k])
    sizes = np.array([counts[k] for k in order], dtype=np.int64)
    n, longest = len(order), _longest(sizes)
    words = np.zeros((n, max([0, *(len(c) // 4 for c in coded)]) + 3), np.uint32)
    for lane, k in enumerate(order):
        w = np.frombuffer(coded[k], "<u4")
        words[lane, : len(w)] = w
    model, source = _Model(n, longest, True), _Reader(words)
    numbers = np.zeros((longest, n), model.kind)
    for t, m in enumerate(_active(sizes).tolist()):
        guess, chance = model.predict(m)
        whole, code = source.range[:m], source.code[:m]
        cut = (whole >> _TWELVE) * chance.astype(np.uint64)
        hit = code < cut
        rest = model.rest.astype(np.uint64)
        width = whole - cut
        width //= rest
        part = code - cut  # of no use after a hit
        part //= width
        x = model.holders(np.minimum(part, rest - _ONE).astype(np.int64))
        np.copyto(x, guess, where=hit)
        numbers[t, :m] = x
        first, count = model.cut(x)
        first *= width
        first += cut
        np.copyto(first, _NONE, where=hit)
        width *= count
        np.copyto(width, cut, where=hit)
        source.narrow(m, first, width)
        model.update(t, x, hit, numbers)
    distinct = numbers.max(axis=0, initial=0).astype(np.int64)
    turn = np.argsort(-distinct, kind="stable")
    source.take(turn)
    known = np.zeros((n, int(distinct.max(initial=0)) + 1), np.uint32)  # ids by number
    cdf = np.tile(_START, (n, 1))
    for t, m in enumerate(_active(distinct[turn]).tolist()):
        known[turn[:m], t + 1] = _get_new(cdf[:m], source)
    rows = np.ascontiguousarray(numbers.T)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
    for lane, k in enumerate(order):
        out[k] = known[lane].take(rows[lane, : sizes[lane]])
    return out
