"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks; each block is coded on its own (all statistics reset) and carries a checksum, so a
damaged block is found and costs only itself. In a block, an id is predicted by order 2 (the id that last
followed the two ids before it) and by order 1 (that followed the last one), both hashed, and by order 0
(adaptive frequencies of the block's ids, with an escape to ids not seen yet). The predictions are mixed into one
distribution: weights of orders 2 and 1 are learned for each confidence of their slot, order 0 has the rest. The
mixture drives a 64-bit range coder with carry: one coding step an id, and one more after an escape.

A block is divided into lanes of consecutive ids that share the block's statistics and have a code stream
each; lanes of many blocks are coded in lockstep, so that numpy does the work. Statistics are brought up to date
between segments of steps (short ones first, see _bounds) from all ids of the segment, step by step and lane by
lane, in the encoder as in the decoder; the encoder has a segment's intervals in one go, the decoder finds them
step by step. A block's bytes don't depend on other blocks. Layout, little-endian: "VCM3", bits of an id, lanes
(u16 each), number of ids, crc32 of the ids as u32 (u32 each), words of each lane (u32 each), then the lanes'
32-bit words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"VCM3"
_HEAD = struct.Struct("<4sHHII")
BLOCK_IDS = 1 << 18
#: Ids in a lane at least, lanes of a block and of a lockstep group at most; statistics take about 1 MB a block.
_LANE_IDS, _LANES, GROUP = 256, 512, 4096
#: Slots of orders 1 and 2, as bits.
_H1, _H2 = 14, 16
#: Bits of the mixture's weights and of the shares of order 0; a coding step divides the span by both.
_MIX, _ZERO = 12, 16
_ONE, _FULL = 1 << _MIX, 1 << _ZERO
_STEP, _32 = np.uint64(_MIX + _ZERO), np.uint64(32)
_LOW, _MOST = np.uint64(1 << 32), np.uint64((1 << (_MIX + _ZERO)) - 1)
#: Ids that order 0 tells apart; any further ones of a block stay escapes.
_KNOWN = 1 << 15
#: Ids below this are counted in a table, others by sorting.
_DENSE = 1 << 17


def _bounds(steps: int) -> list[int]:
    """Ends of segments: every power of two up to 32, then every 64 steps."""
    return [b for b in [1, 2, 4, 8, 16, 32, *range(64, steps, 64)] if b < steps] + ([steps] if steps else [])


def _mask(where: np.ndarray) -> np.ndarray:
    """All bits where it is true."""
    return np.negative(where.astype(np.uint32))


def _choose(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a under the mask, else b: no branches, which np.where has."""
    return b ^ ((a ^ b) & mask)


class _Block:
    """Order 0 of a block: ids seen (ascending) with their counts; entry 0 of the tables is the escape."""

    def __init__(self) -> None:
        self.ids, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.start, self.share = np.zeros(1, np.uint32), np.full(1, _FULL, np.uint32)

    def learn(self, ids: np.ndarray) -> None:
        top = int(max(ids.max(), self.ids[-1] if len(self.ids) else 0)) + 1
        if top <= _DENSE:
            n = np.bincount(ids.astype(np.int64), minlength=top)
            escaped = len(ids) - int(n.take(self.ids).sum())
            n[self.ids] += self.counts
            found = np.flatnonzero(n > 0)
            if len(found) > _KNOWN:
                found = self._most(found)
            self.ids, self.counts = found.astype(np.uint32), n.take(found)
        else:
            found, n = np.unique(ids, return_counts=True)
            old = np.isin(found, self.ids)
            escaped = int(n[~old].sum())
            all_ids, where = np.unique(np.r_[self.ids, found], return_inverse=True)
            counts = np.bincount(where, np.r_[self.counts, n]).astype(np.int64)
            kept = np.searchsorted(all_ids, self._most(all_ids))
            self.ids, self.counts = all_ids[kept], counts[kept]
        escape = min(max((escaped + 1) * _FULL // (len(ids) + 2), 1), _FULL // 4)
        share = 1 + self.counts * (_FULL - escape - len(self.ids)) // max(int(self.counts.sum()), 1)
        share = np.r_[_FULL - int(share.sum()), share]
        self.start, self.share = (np.cumsum(share) - share).astype(np.uint32), share.astype(np.uint32)

    def _most(self, found: np.ndarray) -> np.ndarray:
        """Ids found (ascending, with all that were known): the known ones, and the first new ones that there is room for."""
        new = ~np.isin(found, self.ids)
        return found[~new | (np.cumsum(new) <= _KNOWN - len(self.ids))]

    def ranks(self, ids: np.ndarray) -> np.ndarray:
        """Entries of ids; 0 for those not seen."""
        if not len(self.ids):
            return np.zeros(len(ids), np.int64)
        top = int(max(ids.max(), self.ids[-1])) + 1
        if top <= _DENSE:
            of = np.zeros(top, np.int64)
            of[self.ids] = np.arange(1, len(self.ids) + 1)
            return of.take(ids)
        at = np.searchsorted(self.ids, ids)
        return np.where(self.ids.take(at, mode="clip") == ids, at + 1, 0)


class _Contexts:
    """Orders 1 and 2 of a number of blocks: slots hold an id and a confidence of 0 to 3 (the lowest two bits)."""

    def __init__(self, blocks: int) -> None:
        self.slots = [np.zeros(blocks << h, np.uint32) for h in (_H1, _H2)]
        self.right = [np.tile(np.array([1, 8, 16, 24], np.int64), blocks) for _ in range(2)]
        self.seen = [np.full(4 * blocks, 32, np.int64) for _ in range(2)]
        self.weight = [np.zeros(4 * blocks, np.uint32) for _ in range(2)]
        for j in range(2):
            self._weigh(j, slice(None))

    def _weigh(self, j: int, own: slice) -> None:
        self.weight[j][own] = np.clip((self.right[j][own] << _MIX) // self.seen[j][own], _ONE // 256, _ONE - _ONE // 64)

    @staticmethod
    def at(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of orders 1 and 2 in a block after the ids two, one."""
        h = one * np.uint32(2654435761)
        return tuple(x.astype(np.int64) for x in (h >> np.uint32(32 - _H1), (h ^ (two * np.uint32(2246822519))) >> np.uint32(32 - _H2)))

    def own(self, k: int) -> list[np.ndarray]:
        """Slots of block k."""
        return [x[k << h : (k + 1) << h] for x, h in zip(self.slots, (_H1, _H2), strict=True)]

    def predict(self, at: tuple, block4: np.ndarray | int):
        """Slot contents, guesses and weights (of _ONE) of orders 1 and 2."""
        e1, e2 = self.slots[0].take(at[0]), self.slots[1].take(at[1])
        g1, g2 = e1 >> np.uint32(2), e2 >> np.uint32(2)
        w2 = self.weight[1].take(block4 + (e2 & np.uint32(3)))
        w1 = (self.weight[0].take(block4 + (e1 & np.uint32(3))) * (np.uint32(_ONE) - w2)) >> np.uint32(_MIX)
        w1 *= g1 != g2
        return e1, e2, g1, g2, w1, w2

    def learn(self, k: int, at: tuple, held: tuple, ids: np.ndarray) -> None:
        """ids of block k after its slots at, which held so much; where a slot occurs more than once, its last place stays.
        A right guess gains confidence, a wrong one goes down to 1 from 2 or 3 and gives way to the id from 0 or 1."""
        own = slice(4 * k, 4 * k + 4)
        for j, slots in enumerate(self.own(k)):
            e = held[j]
            sure, right = (e & np.uint32(3)).astype(np.uint8), (e >> np.uint32(2)) == ids
            n = np.bincount((sure << np.uint8(1)) | right, minlength=8).reshape(4, 2)
            self.right[j][own] += n[:, 1]
            self.seen[j][own] += n.sum(axis=1)
            big = self.seen[j][own] > 1 << 14
            self.right[j][own] >>= big
            self.seen[j][own] >>= big
            stays = (sure > 1) & ~right
            slots[at[j]] = _choose(_mask(stays), e & ~np.uint32(3), ids << np.uint32(2)) | (np.minimum(sure + np.uint8(1), np.uint8(3)) * right | stays)
            self._weigh(j, own)


def _lanes_of(ids: int) -> int:
    return min(_LANES, max(1, ids // _LANE_IDS))


def _laid_out(sizes: list[int], lanes: list[int]) -> tuple[np.ndarray, ...]:
    """Lanes of all blocks, longest first: place in block order, block, first id, number of ids, and lanes alive at each step."""
    block = np.repeat(np.arange(len(sizes)), lanes)
    each = np.repeat([-(-n // k) if k else 0 for n, k in zip(sizes, lanes, strict=True)], lanes)
    first = (np.arange(len(block)) - np.repeat(np.cumsum([0, *lanes[:-1]]), lanes)) * each
    count = np.clip(np.repeat(sizes, lanes) - first, 0, each)
    order = np.argsort(-count, kind="stable")
    steps = np.arange(int(count.max(initial=0)))
    return order, block[order], first[order], count[order], np.searchsorted(-count[order], -steps, side="left")


def _groups(lanes: list[int]) -> list[slice]:
    out, at, held = [], 0, 0
    for i, n in enumerate(lanes):
        if held and held + n > GROUP:
            out.append(slice(at, i))
            at, held = i, 0
        held += n
    return [*out, slice(at, len(lanes))] if lanes else []


def _raw(bits: int) -> list[tuple[int, int]]:
    """An escaped id's pieces: shift and bits of each."""
    return [(bits - 15, 15), (0, bits - 15)] if bits > 16 else [(0, bits)]


def encode(blocks: list[np.ndarray], bits: int = 16) -> list[bytes]:
    """Blocks of unsigned ids below 2**bits (30 at most) to bytes."""
    return [x for g in _groups([_lanes_of(len(b)) for b in blocks]) for x in _encode(blocks[g], bits)]


def _intervals(ids: np.ndarray, before: tuple, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's ids by step and lane: lower bounds and sizes (of 2**28) of their intervals, and which are escapes."""
    low, size, escape = np.zeros(ids.shape, np.uint32), np.ones(ids.shape, np.uint32), np.zeros(ids.shape, bool)
    zero, contexts = _Block(), _Contexts(1)
    start = 0
    for end in _bounds(len(ids)):
        part = (slice(start, end), slice(0, int(live[start])))
        alive = slice(None)
        if live[end - 1] < live[start]:
            alive = np.arange(part[1].stop) < live[start:end, None]
        shape = ids[part][alive].shape
        x = ids[part][alive].ravel()
        at = contexts.at(*(b[part][alive].ravel() for b in before))
        e1, e2, g1, g2, w1, w2 = contexts.predict(at, 0)
        is2 = g2 == x
        is1 = (g1 == x) & ~is2
        both = w1 + w2
        rank = zero.ranks(x)
        rank *= ~(is1 | is2)
        rest, shift = np.uint32(_ONE) - both, np.uint32(_ZERO)
        under1, under2 = _mask(is1), _mask(is2)
        low[part][alive] = (_choose(under1, w2 << shift, (both << shift) + rest * zero.start.take(rank)) & ~under2).reshape(shape)
        size[part][alive] = _choose(under2, w2 << shift, _choose(under1, w1 << shift, rest * zero.share.take(rank))).reshape(shape)
        escape[part][alive] = ((rank == 0) & ~is1 & ~is2).reshape(shape)
        contexts.learn(0, at, (e1, e2), x)
        zero.learn(x)
        start = end
    return low, size, escape


def _encode(blocks: list[np.ndarray], bits: int) -> list[bytes]:
    n_lanes = [_lanes_of(len(b)) for b in blocks]
    order, block, first, count, active = _laid_out([len(b) for b in blocks], n_lanes)
    lanes, steps = len(order), len(active)
    ids, escape = np.zeros((steps, lanes), np.uint32), np.zeros((steps, lanes), bool)
    lows, sizes = np.zeros((steps, lanes), np.uint32), np.ones((steps, lanes), np.uint32)
    for k, b in enumerate(blocks):
        own = np.flatnonzero(block == k)
        n = int(count[own[0]])
        whole = np.zeros(n * len(own), np.uint32)
        whole[: len(b)] = b
        x = np.ascontiguousarray(whole.reshape(len(own), n).T)
        one = np.vstack([np.zeros((1, len(own)), np.uint32), x])[:-1]
        two = np.vstack([np.zeros((2, len(own)), np.uint32), x])[:-2]
        live = (count[own] > np.arange(n)[:, None]).sum(axis=1)
        m = int((own == own[0] + np.arange(len(own))).sum())  # lanes side by side, then any shorter ones
        for whole, part in zip((ids, lows, sizes, escape), (x, *_intervals(x, (one, two), live)), strict=True):
            whole[:n, own[0] : own[0] + m] = part[:, :m]
            whole[:n, own[m:]] = part[:, m:]
    low, span, pos = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64), np.zeros(lanes, np.int64)
    words = np.zeros((64, lanes), np.uint64)  # a carry stays in a word's upper half until the end

    def put(who: np.ndarray | slice, shift: np.uint64, cum: np.ndarray, freq: np.ndarray) -> None:
        nonlocal words
        r = span[who] >> shift
        old = low[who]
        lo = old + r * cum
        r *= freq
        over = np.flatnonzero(lo < old)
        if len(over):
            k = over if isinstance(who, slice) else who[over]
            words[pos[k] - 1, k] += np.uint64(1)
        small = np.flatnonzero(r < _LOW)
        if len(small):
            k = small if isinstance(who, slice) else who[small]
            p = pos[k]
            if int(p.max()) + 4 >= len(words):
                words = np.vstack([words, np.zeros_like(words)])
            x = lo[small]
            words[p, k] = x >> _32
            pos[k] = p + 1
            lo[small] = x << _32
            r[small] <<= _32
        low[who], span[who] = lo, r

    for t in range(steps):
        n = int(active[t])
        put(slice(0, n), _STEP, lows[t, :n], sizes[t, :n])
        who = np.flatnonzero(escape[t, :n])
        if len(who):
            for shift, wide in _raw(bits):
                put(who, np.uint64(wide), (ids[t, who] >> np.uint32(shift)) & np.uint32((1 << wide) - 1), np.ones(len(who), np.uint32))
    # a number in the last interval whose lower word is zero, then carries from the end on
    last = low + (_LOW - np.uint64(1))
    words = np.vstack([words, np.zeros((2, lanes), np.uint64)])
    lane = np.arange(lanes)
    over = np.flatnonzero(last < low)
    words[pos[over] - 1, over] += np.uint64(1)
    words[pos, lane] = last >> _32
    pos += 1
    for j in range(int(pos.max(initial=1)) - 1, 0, -1):
        words[j - 1] += words[j] >> _32
    data = np.ascontiguousarray(words.T).astype("<u4")
    streams: list[bytes] = [b""] * lanes
    for j, i in enumerate(order):
        x = data[j, : pos[j]]
        live = np.flatnonzero(x)  # zeros at the end are implied
        streams[i] = x[: live[-1] + 1 if len(live) else 0].tobytes()
    out, at = [], 0
    for b, k in zip(blocks, n_lanes, strict=True):
        own = streams[at : at + k]
        at += k
        out.append(_HEAD.pack(MAGIC, bits, k, len(b), zlib.crc32(b.astype("<u4").tobytes())) + np.array([len(x) // 4 for x in own], "<u4").tobytes() + b"".join(own))
    return out


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """Ids of blocks; raises ValueError on a damaged one."""
    heads = [_HEAD.unpack_from(b) if len(b) >= _HEAD.size else (b"", 0, 0, 0, 0) for b in blocks]
    if any(h[0] != MAGIC or not 0 < h[1] <= 30 or h[2] != _lanes_of(h[3]) for h in heads) or len({h[1] for h in heads}) > 1:
        raise ValueError("not a block of this format")
    return [x for g in _groups([h[2] for h in heads]) for x in _decode(blocks[g], heads[g])]


class _Tables:
    """Order 0 of all blocks for the decoder: entry of each slot, and start, share and id of each entry."""

    def __init__(self, blocks: int) -> None:
        self.entry = np.zeros((blocks, _FULL), np.uint16)
        self.width = 1 << 10
        self.interval, self.id = np.zeros((blocks, self.width), np.uint32), np.zeros((blocks, self.width), np.uint32)
        self.interval[:, 0] = _FULL - 1

    def put(self, k: int, zero: _Block) -> None:
        n = len(zero.share)
        while n > self.width:
            self.interval, self.id = (np.hstack([x, np.zeros_like(x)]) for x in (self.interval, self.id))
            self.width *= 2
        self.entry[k] = np.repeat(np.arange(n, dtype=np.uint16), zero.share)
        self.interval[k, :n] = (zero.start << np.uint32(16)) | (zero.share - np.uint32(1))
        self.id[k, 1:n] = zero.ids


def _decode(blocks: list[bytes], heads: list[tuple]) -> list[np.ndarray]:
    bits = heads[0][1]
    order, block, first, count, active = _laid_out([h[3] for h in heads], [h[2] for h in heads])
    lanes, steps = len(order), len(active)
    streams: list[np.ndarray] = []
    for b, h in zip(blocks, heads, strict=True):
        sizes = np.frombuffer(b, "<u4", h[2], _HEAD.size) if len(b) >= _HEAD.size + 4 * h[2] else np.zeros(h[2], "<u4")
        body = b[_HEAD.size + 4 * h[2] :]
        if 4 * int(sizes.sum()) != len(body):
            raise ValueError("a block is cut off")
        streams += np.split(np.frombuffer(body, "<u4"), np.cumsum(sizes)[:-1])
    width = max(map(len, streams)) + 4
    words = np.zeros((lanes, width), np.uint32)
    for j, i in enumerate(order):
        words[j, : len(streams[i])] = streams[i]
    flat = words.ravel()
    base = np.arange(lanes) * width
    code, span, pos = (words[:, 0].astype(np.uint64) << _32) | words[:, 1], np.full(lanes, (1 << 64) - 1, np.uint64), np.full(lanes, 2)
    contexts, tables, zeros = _Contexts(len(blocks)), _Tables(len(blocks)), [_Block() for _ in blocks]
    own = [np.flatnonzero(block == k) for k in range(len(blocks))]
    # lanes of a block are mostly side by side
    own = [(x, slice(int(x[0]), int(x[-1]) + 1) if len(x) and x[-1] - x[0] == len(x) - 1 else x) for x in own]
    four, slots0, slots1, slots2 = block * 4, block * _FULL, block << _H1, block << _H2
    one, full, zero = np.uint32(_ONE), np.uint32(_FULL - 1), np.uint32(_ZERO)
    ids_at = np.zeros((steps + 2, lanes), np.uint32)  # two rows of zeros before the first step

    def take(who: np.ndarray | slice, c: np.ndarray, r: np.ndarray, cum: np.ndarray, freq: np.ndarray) -> None:
        c = c - r * cum
        r = r * freq
        small = np.flatnonzero(r < _LOW)
        if len(small):
            k = small if isinstance(who, slice) else who[small]
            p = pos[k]
            c[small] = (c[small] << _32) | flat.take(base[k] + np.minimum(p, width - 1))
            pos[k] = p + 1
            r[small] <<= _32
        code[who], span[who] = c, r

    start = 0
    for end in _bounds(steps):
        entries, intervals, known = tables.entry.ravel(), tables.interval.ravel(), tables.id.ravel()
        row0 = block * tables.width
        for t in range(start, end):
            n = int(active[t])
            at1, at2 = contexts.at(ids_at[t + 1, :n], ids_at[t, :n])
            at1 += slots1[:n]
            at2 += slots2[:n]
            _, _, g1, g2, w1, w2 = contexts.predict((at1, at2), four[:n])
            both = w1 + w2
            c = code[:n]
            r = span[:n] >> _STEP
            v = np.minimum(c // r, _MOST).astype(np.uint32)
            mixed = v >> zero
            is2, is0 = mixed < w2, mixed >= both
            rest, both = one - both, both << zero
            at = entries.take(slots0[:n] + (((v - both) // rest) & full)) + row0[:n]
            found = intervals.take(at)
            under0, under2 = _mask(is0), _mask(is2)
            cum = _choose(under0, both + rest * (found >> np.uint32(16)), (w2 << zero) & ~under2)
            freq = _choose(under0, rest * ((found & full) + np.uint32(1)), _choose(under2, w2, w1) << zero)
            ids = _choose(under0, known.take(at), _choose(under2, g2, g1))
            take(slice(0, n), c, r, cum.astype(np.uint64), freq.astype(np.uint64))
            who = np.flatnonzero(is0 & (at == row0[:n]))
            if len(who):
                x = np.zeros(len(who), np.uint32)
                for _, wide in _raw(bits):
                    c = code[who]
                    r = span[who] >> np.uint64(wide)
                    v = np.minimum(c // r, np.uint64((1 << wide) - 1))
                    take(who, c, r, v, np.ones(len(who), np.uint64))
                    x = (x << np.uint32(wide)) | v.astype(np.uint32)
                ids[who] = x
            ids_at[t + 2, :n] = ids
        for k, (cols, side) in enumerate(own):
            if not len(cols) or count[cols[0]] <= start:
                continue
            alive = slice(None) if count[cols[-1]] >= end else np.arange(start, end)[:, None] < count[cols]
            before1, before2, x = (ids_at[start + j : end + j, side][alive].ravel() for j in (1, 0, 2))
            at = contexts.at(before1, before2)
            contexts.learn(k, at, [y.take(a) for y, a in zip(contexts.own(k), at, strict=True)], x)
            zeros[k].learn(x)
            tables.put(k, zeros[k])
        start = end
    # a block's lanes are its ids in a row
    out = [ids_at[2 : 2 + int(count[cols[0]]), side].T.ravel()[: h[3]] if len(cols) else np.zeros(0, np.uint32) for (cols, side), h in zip(own, heads, strict=True)]
    for x, h in zip(out, heads, strict=True):
        if zlib.crc32(x.astype("<u4").tobytes()) != h[4]:
            raise ValueError("a block's checksum is wrong")
    return out
