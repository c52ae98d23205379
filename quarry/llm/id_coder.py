"""Adaptive context-mixing range coder of token ids.

Three predictions of an id are mixed into one distribution, of which a step codes the whole id:

* order 0: the id's share by the counts of a segment, which stand in the header; a code tree
  over them gives each id its place, and the share of the root's two branches adapts within the
  block;
* order 1 and order 2: the id last seen in the block after the last id, after the last two.

An order's guess weighs as much as such guesses were right before, by how often in a row either
order's held and whether the two agree; the weights learn from every id. The rest of the weight
is order 0's. An id's interval is its place by order 0, widened by the weight of the guesses that
name it and moved by that of the guesses before it: what all three say of it is added up. It
narrows a carry-less range coder of 64 bits that emits words of 32.

Blocks are reset, checksummed and independent of one another (with the header). Everything is
integer arithmetic over fixed values, so any machine decodes what another wrote.

Blocks are coded side by side, one array element each, all at the same place: that is what makes
adaptive coding in numpy affordable.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque

import numpy as np

#: Ids in a block.
BLOCK = 1024
#: Remembered contexts of a block for each order; kinds of guesses (how often either held, whether they agree).
CONTEXTS, KINDS = 512, 32
#: Bits of ids' shares in the header, of weights and branches' shares, of places in the mixture.
ID_BITS, UNIT, TOTAL = 18, 15, 30
#: How fast weights follow (a shift) and their bounds; after how many ids the branches' shares follow, how fast, and their bound.
RATE, MOST, OFTEN, SLOW, LEAST = 5, (24_000, 7000), 8, 4, 1024
#: Weights of both guesses at first.
FIRST = [k for k in (0, 750, 5000, 12_000) for _ in range(4)] + [k for k in (500, 3000, 8000, 15_000) for _ in range(4)], [0, 1750, 4000, 5500, 0, 1250, 3000, 4500] * 2 + [0] * 16
WORD, HALF = np.uint64(1 << 32), np.uint64(32)


def shares(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a total of 2**ID_BITS; what occurs has 1 at least."""
    seen, out = np.flatnonzero(counts), np.zeros(len(counts), np.int64)
    if len(seen):
        spare = (1 << ID_BITS) - len(seen)
        share = counts[seen].astype(np.int64) * spare // int(counts[seen].sum()) + 1
        share[np.argmax(share)] += (1 << ID_BITS) - int(share.sum())
        out[seen] = share
    return out


class _Tree:
    """Code tree over the ids that occur.

    Of each decision: children (~id for a leaf), begin and size of what lies below; of the root
    both branches' sizes. Of each id: the path, from its lowest bit on, begin and size.
    """

    def __init__(self, counts: np.ndarray):
        self.size = shares(counts)
        seen = np.flatnonzero(self.size)
        seen = seen[np.argsort(self.size[seen], kind="stable")]
        leaves = [(int(self.size[i]), ~int(i)) for i in seen]
        # an id alone still takes a decision
        leaves = deque(leaves * 2 if len(leaves) == 1 else leaves)
        made: deque[tuple[int, int]] = deque()
        pairs = []
        while len(leaves) + len(made) > 1:
            (a, x), (b, y) = (leaves.popleft() if not made or (leaves and leaves[0][0] <= made[0][0]) else made.popleft() for _ in range(2))
            made.append((a + b, len(pairs)))
            pairs.append((x, y, a, b))
        # the root is 0, heavy decisions have low numbers
        last, table = len(pairs) - 1, np.array(pairs[::-1], np.int64).reshape(-1, 4)
        below, sizes = table[:, :2], table[:, 2:]
        self.child = np.where(below >= 0, last - below, below).astype(np.int32).ravel()
        self.below = sizes.sum(axis=1)
        self.sizes = sizes[0]
        self.path, self.begin, self.start = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64), np.zeros(len(pairs), np.int64)
        at, path, begin, depth = np.zeros(min(1, len(pairs)), np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), 0
        while len(at):
            self.start[at] = begin
            met = np.concatenate((self.child[2 * at], self.child[2 * at + 1])).astype(np.int64)
            path, begin = np.concatenate((path, path | (1 << depth))), np.concatenate((begin, begin + sizes[at, 0]))
            leaf = met < 0
            self.path[~met[leaf]], self.begin[~met[leaf]] = path[leaf], begin[leaf]
            at, path, begin, depth = met[~leaf], path[~leaf], begin[~leaf], depth + 1

    def slots(self) -> np.ndarray:
        """The id of every place."""
        seen = np.flatnonzero(self.size)
        seen = seen[np.argsort(self.begin[seen], kind="stable")]
        return np.repeat(seen, self.size[seen]).astype(np.int32)


class _Model:
    """State of blocks side by side; ids are given as ranks, their order of place."""

    def __init__(self, blocks: int, counts: np.ndarray):
        tree = _Tree(counts)
        seen = np.flatnonzero(tree.size)
        self.ids = seen[np.argsort(tree.begin[seen], kind="stable")].astype(np.int32)
        self.rank = np.zeros(len(counts), np.int32)
        self.rank[self.ids] = np.arange(len(self.ids))
        begin, size = tree.begin[self.ids], tree.size[self.ids]
        # places below the root's branches, and the first rank below the second
        self.places = tree.sizes
        self.half = np.int32(np.count_nonzero(begin < self.places[0]))
        self.slots = self.rank.take(tree.slots())
        # of each rank, begin within its branch and size
        self.spot = (begin - (begin >= self.places[0]) * self.places[0] << 20) + size
        self.share = np.full(blocks, int(self.places[1] << UNIT) // int(self.places.sum()), np.int64)
        self.met = np.zeros(blocks, np.int64)
        self.seen = [np.full(blocks * CONTEXTS, int(np.argmax(size)) << 2, np.int32) for _ in range(2)]
        self.weights = np.tile((np.array(FIRST[0], np.int32) << UNIT) + np.array(FIRST[1], np.int32), blocks)
        self.lane, self.kinds = np.arange(blocks) * CONTEXTS, np.arange(blocks) * KINDS
        self.last, self.before = np.zeros(blocks, np.int32), np.zeros(blocks, np.int32)
        self.step = 0

    def drop(self) -> None:
        """The last block is at its end."""
        for name in ("share", "met", "lane", "kinds", "last", "before"):
            setattr(self, name, getattr(self, name)[:-1])
        self.scale = [s[:-1] for s in self.scale]

    def predict(self) -> None:
        """What each order says of the next id."""
        if self.step % OFTEN == 0:
            if self.step:
                self.share += (self.met * ((1 << UNIT) // OFTEN) - self.share) >> SLOW
                self.met[:] = 0
            np.clip(self.share, LEAST, (1 << UNIT) - LEAST, out=self.share)
            self.scale = [(s << UNIT) // max(1, int(n)) for s, n in zip(((1 << UNIT) - self.share, self.share), self.places, strict=True)]
        self.step += 1
        both = self.before * 30011
        both += self.last * 10007
        both >>= 3
        both &= CONTEXTS - 1
        one = self.last * 25173
        one >>= 2
        one &= CONTEXTS - 1
        self.at = both + self.lane, one + self.lane
        self.held = [s.take(a, mode="clip") for s, a in zip(self.seen, self.at, strict=True)]
        self.guess = [h >> 2 for h in self.held]
        self.same = self.guess[0] == self.guess[1]
        self.often = [h & 3 for h in self.held]
        kind = self.often[0] << 2
        kind += self.often[1]
        kind |= self.same.view(np.int8) << 4
        self.kind = self.kinds + kind
        weights = self.weights.take(self.kind, mode="clip")
        self.weight = [weights >> UNIT, weights & ((1 << UNIT) - 1)]
        left = (1 << UNIT) - self.weight[0]
        left -= self.weight[1]
        self.bonus = [w.astype(np.int64) << (TOTAL - UNIT) for w in self.weight]
        self.unit = [s * left >> UNIT for s in self.scale]
        self.floor = self.unit[0] * self.places[0]

    def alone(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of ids by order 0."""
        upper = rank >= self.half
        unit = np.where(upper, self.unit[1], self.unit[0])
        spot = self.spot.take(rank, mode="clip")
        begin = spot >> 20
        begin *= unit
        begin += self.floor * upper
        spot &= (1 << 20) - 1
        spot *= unit
        return begin, spot

    def mixed(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of ids in the mixture."""
        begin, size = self.alone(rank)
        for g, b in zip(self.guess, self.bonus, strict=True):
            begin += b * (g < rank)
            size += b * (g == rank)
        return begin, size

    def find(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids at these places of the mixture, their begin and size in it."""
        rest, guesses = place, []
        for k, g in enumerate(self.guess):
            begin, size = self.alone(g)
            begin += self.bonus[1 - k] * (self.guess[1 - k] < g)
            size += self.bonus[k]
            if k:
                size += self.bonus[0] * self.same
            past = place - begin
            guesses.append((past.view(np.uint64) < size.view(np.uint64), g, begin, size))
            rest = rest - self.bonus[k] * (past >= size)
        upper = rest >= self.floor
        floor = self.floor * upper
        unit = np.where(upper, self.unit[1], self.unit[0])
        slot = ((rest - floor).view(np.uint64) // unit.view(np.uint64)).view(np.int64)
        slot += upper * self.places[0]
        rank = self.slots.take(slot, mode="clip")
        size = self.spot.take(rank, mode="clip")
        begin = size >> 20
        begin *= unit
        begin += floor
        # with the weight of the guesses before
        begin += place - rest
        size &= (1 << 20) - 1
        size *= unit
        for held, *found in guesses:
            for to, what in zip((rank, begin, size), found, strict=True):
                np.copyto(to, what, where=held)
        return rank, begin, size

    def learn(self, rank: np.ndarray) -> None:
        """The ids found: contexts remember them, weights follow what held."""
        fresh = rank << 2
        fresh += 1
        for k in range(2):
            held = self.guess[k] == rank
            self.seen[k][self.at[k]] = np.where(held, self.held[k] + (self.often[k] < 3), fresh)
            if k:
                # the second guess has no weight beside the same first one
                held = held > self.same
            step = held.astype(np.int32)
            step <<= UNIT
            w = self.weight[k]
            step -= w
            step >>= RATE
            w += step
            np.minimum(w, MOST[k], out=w)
        self.weight[0] <<= UNIT
        self.weight[0] += self.weight[1]
        self.weights[self.kind] = self.weight[0]
        self.met += rank >= self.half
        self.before, self.last = self.last, rank


class _Coder:
    """Ranges of all blocks. An interval that has become narrow is cut to one leading word, which goes out."""

    def __init__(self, blocks: int):
        self.low = np.zeros(blocks, np.uint64)
        self.range = np.full(blocks, 2**64 - 1, np.uint64)

    def drop(self) -> None:
        self.low, self.range = self.low[:-1], self.range[:-1]

    def unit(self) -> np.ndarray:
        return self.range >> np.uint64(TOTAL)

    def narrow(self, unit: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take ``size`` units from ``begin`` on. Which blocks give out a word, and the words."""
        self.low += unit * begin.view(np.uint64)
        self.range = unit * size.view(np.uint64)
        out = np.flatnonzero(self.range < WORD)
        low, size = self.low[out], self.range[out]
        cut = (low >> HALF) != ((low + size - np.uint64(1)) >> HALF)
        size = np.where(cut, WORD - (low & (WORD - np.uint64(1))), size)
        self.low[out], self.range[out] = low << HALF, size << HALF
        return out, low >> HALF


def encode(ids: np.ndarray) -> bytes:
    """The ids' counts, block table (words, checksum) and words."""
    # in pieces, as counting copies them
    top = int(ids.max()) + 1
    counts = sum(np.bincount(ids[i : i + 256 * BLOCK], minlength=top) for i in range(0, len(ids), 256 * BLOCK))
    blocks, over = -(-len(ids) // BLOCK), len(ids) % BLOCK
    model, coder = _Model(blocks, counts), _Coder(blocks)
    ranks = np.zeros(blocks * BLOCK, np.int32)
    ranks[: len(ids)] = model.rank.take(ids)
    ranks = np.ascontiguousarray(ranks.reshape(blocks, BLOCK).T)
    lanes = np.arange(blocks).astype(np.uint16 if blocks <= 1 << 16 else np.uint32)
    out_block, out_word = [], []

    def put(at: np.ndarray, words: np.ndarray) -> None:
        out_block.append(lanes[at])
        out_word.append(words.astype("<u4"))

    def end(at: np.ndarray) -> None:
        for shift in (32, 0):
            # the middle of what is left, so that what follows may be anything
            put(at, (coder.low[at] + (coder.range[at] >> np.uint64(1))) >> np.uint64(shift))

    for i in range(BLOCK):
        if over and i == over:
            end(np.array([blocks - 1]))
            model.drop()
            coder.drop()
        now = ranks[i, : len(coder.low)]
        model.predict()
        put(*coder.narrow(coder.unit(), *model.mixed(now)))
        model.learn(now)
    end(np.arange(len(coder.low)))
    block, words = np.concatenate(out_block), np.concatenate(out_word)
    words = words[np.argsort(block, kind="stable")]
    sums = [zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4")) for b in range(blocks)]
    seen = np.flatnonzero(counts)
    told = zlib.compress(np.diff(seen, prepend=0).astype("<u4").tobytes() + counts[seen].astype("<u8").tobytes())
    head = struct.pack("<III", len(seen), len(told), blocks)
    return b"".join([head, told, np.bincount(block, minlength=blocks).astype("<u4").tobytes(), np.array(sums, "<u4").tobytes(), words.tobytes()])


def decode(raw: bytes, n_ids: int) -> np.ndarray:
    """The ids; a damaged table or block is an error."""
    n_seen, n_told, blocks = struct.unpack_from("<III", raw)
    try:
        told = zlib.decompress(raw[12 : 12 + n_told])
    except zlib.error as e:
        raise ValueError("the table of counts is damaged") from e
    seen = np.cumsum(np.frombuffer(told, "<u4", n_seen).astype(np.int64))
    counts = np.zeros(int(seen[-1]) + 1, np.int64)
    counts[seen] = np.frombuffer(told, "<u8", n_seen, offset=4 * n_seen)
    sizes, sums, words = np.split(np.frombuffer(raw[12 + n_told :], "<u4"), [blocks, 2 * blocks])
    # words beyond a damaged block's end are noughts; its checksum tells
    words = np.concatenate([words, np.zeros(4, "<u4")]).astype(np.uint64)
    model, coder = _Model(blocks, counts), _Coder(blocks)
    take = np.cumsum(sizes.astype(np.int64)) - sizes
    code = (words.take(take, mode="clip") << HALF) | words.take(take + 1, mode="clip")
    take += 2
    over, ranks = n_ids % BLOCK, np.zeros((BLOCK, blocks), np.int32)
    for i in range(BLOCK):
        if over and i == over:
            model.drop()
            coder.drop()
            code, take = code[:-1], take[:-1]
        model.predict()
        unit = coder.unit()
        place = np.minimum((code - coder.low) // unit, np.uint64((1 << TOTAL) - 1))
        rank, begin, size = model.find(place.view(np.int64))
        out, _ = coder.narrow(unit, begin, size)
        code[out] = (code[out] << HALF) | words.take(take[out], mode="clip")
        take[out] += 1
        model.learn(rank)
        ranks[i, : len(rank)] = rank
    ids = model.ids.take(ranks.T.ravel()[:n_ids])
    plain = ids.astype("<u4")
    for b in range(blocks):
        if zlib.crc32(plain[b * BLOCK : (b + 1) * BLOCK]) != sums[b]:
            raise ValueError(f"block {b} does not match its checksum")
    return ids
