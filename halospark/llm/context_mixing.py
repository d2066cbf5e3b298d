"""Logistic mixing of hashed-context bit predictors, on arrays: codes, tables of bit counts, mixers and their refinement.

An event is a bit to predict, with a slot in each predictor's table and its place (the bits of the token so far, at most
PLACES - 1). A slot holds how often a zero and a one came; a predictor's input is the log odds of both, 0 where nothing was
seen. The mixer adds the inputs with weights picked by a gate, the predictors that have seen their context together with the
place. What it says is refined by how often a one came at such a probability and place."""

from __future__ import annotations

import re

import numpy as np

PRIOR, RATE, LIMIT = 0.4, 0.3, 14.0
PLACES, BINS = 12, 28
#: Slots that are counted, summed and sent together; inputs are kept as bytes, in eighths.
BLOCK, SCALE = 4096, 8
#: Bits of a mixer's step when it learns; bytes whose events are made together.
STEP, CHUNK = 4096, 16_384
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]


class Code:
    """A prefix code of ordered symbols, halving the weight at each bit. path[first[k]:][:size[k]]: 2 * node + bit of symbol k."""

    def __init__(self, weights: np.ndarray):
        n, total = len(weights), np.concatenate([[0.0], np.cumsum(weights, dtype=float)])
        lo, hi, self.nodes, leaves, steps = np.zeros(1, np.int64), np.full(1, n), 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(lo := lo[(wide := hi - lo > 1)]):
            hi = hi[wide]
            half = (total[lo] + total[hi]) / 2
            at = np.searchsorted(total, half)
            at -= half - total[np.maximum(at - 1, 0)] <= total[np.minimum(at, n)] - half
            at, sizes = np.clip(at, lo + 1, hi - 1), hi - lo
            leaf = np.repeat(lo, sizes) + ranges(sizes)
            leaves.append(leaf)
            steps.append(2 * np.repeat(np.arange(self.nodes, self.nodes + len(lo)), sizes) + (leaf >= np.repeat(at, sizes)))
            self.nodes += len(lo)
            lo, hi = np.stack([lo, at], axis=1).ravel(), np.stack([at, hi], axis=1).ravel()
        leaves = np.concatenate(leaves)
        self.path = np.concatenate(steps)[np.argsort(leaves, kind="stable")].astype(np.int32)
        self.size = np.bincount(leaves, minlength=n).astype(np.int32)
        self.first = (np.cumsum(self.size) - self.size).astype(np.int32)


def ranges(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... below each of the sizes, one after the other."""
    return np.arange(sizes.sum(), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)


class Events:
    """slots: predictors x bits, in one table of all predictors; bits; place; first: where each token's bits begin."""

    __slots__ = ("slots", "bits", "place", "first")

    def __init__(self, slots, bits, place, first):
        self.slots, self.bits, self.place, self.first = slots, bits, place, first


WINDOW = 1 << 18
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_ODD = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words between ASCII white space in bytes: where they start and end, and 64-bit hashes, by which they are told apart."""

    up, down = _powers(_ODD, 1 << 16), _powers(pow(_ODD, -1, 1 << 64), 1 << 16)

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        word = ~_IS_SPACE[self.data]
        edges = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.starts, self.ends = edges[::2], edges[1::2]
        while len(Words.up) <= len(data):
            n = 2 * len(Words.up)
            Words.up, Words.down = _powers(_ODD, n), _powers(pow(_ODD, -1, 1 << 64), n)
        if not len(self.starts):
            self.hashes = np.zeros(0, np.uint64)
            return
        value = (self.data + np.uint64(1)) * Words.up[: len(data)]
        value *= word
        h = np.add.reduceat(value, self.starts) * Words.down[self.starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        self.hashes = np.maximum(h ^ h >> np.uint64(29), np.uint64(1))

    def endings(self) -> np.ndarray:
        """Hashes of the words' last two bytes."""
        last = self.data[self.ends - 1].astype(np.uint32) + np.uint32(1)
        return (last + (self.data[self.ends - 2].astype(np.uint32) << np.uint32(9)) * (self.ends - self.starts > 1)).astype(np.uint32) * _MIX[1]

    def take(self, at: np.ndarray) -> list[bytes]:
        return [self.data[s:e].tobytes() for s, e in zip(self.starts[at].tolist(), self.ends[at].tolist())]


class _Table:
    """Numbers of hashes, by open addressing."""

    def __init__(self, hashes: np.ndarray):
        self.bits = max(4, (4 * len(hashes)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        left, at = np.arange(len(hashes)), self._place(hashes)
        while len(left):
            free = self.keys[at] == 0
            _, one = np.unique(at[free], return_index=True)
            one = np.flatnonzero(free)[one]
            self.keys[at[one]], self.values[at[one]] = hashes[left[one]], left[one]
            left, at = np.delete(left, one), np.delete(at, one)
            at = (at + 1) & (len(self.keys) - 1)

    def _place(self, hashes):
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        out, at = np.full(len(hashes), -1, np.int64), self._place(hashes)
        key = self.keys[at]
        same = key == hashes
        out[same] = self.values[at[same]]
        left = np.flatnonzero(~same & (key != 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            key = self.keys[at[left]]
            same = key == hashes[left]
            out[left[same]] = self.values[at[left[same]]]
            left = left[~same & (key != 0)]
        return out


def pieces(text: str | None):
    """(bytes, the two words before them, whether they are the last) of a text, A-Z lower-cased, in pieces of about WINDOW bytes."""
    data, at, before = (text or "").encode("utf-8", "surrogatepass").lower(), 0, []
    while gap := _SPACE.search(data, at + WINDOW):
        piece = data[at : gap.start()]
        yield piece, before, False
        before, at = [*before, *piece.rsplit(None, 2)[-2:]][-2:], gap.end()
    yield data[at:] if at else data, before, True


def groups(texts, most: int):
    """The texts' pieces (number of the text, *piece), in lists of about `most` bytes."""
    held, many = [], 0
    for k, t in enumerate(texts):
        for p in pieces(t):
            held.append((k, *p))
            many += len(p[0]) + 1
            if many > most:
                yield held
                held, many = [], 0
    if held:
        yield held


class WordContexts:
    """Words as codes of the frequent ones, an escape and a text's end. Predictors: the code's bits alone, and after the last
    word and the last two words' endings."""

    predictors = 3

    def __init__(self, head: list[bytes], counts: np.ndarray, rest: int, ends: int, bits: int):
        self.order = np.array(sorted(range(len(head)), key=lambda k: head[k][::-1]), np.int64)  # words of one ending share the code's first bits
        self.codes = _Table(Words(b" ".join(head[k] for k in self.order)).hashes)
        self.escape, self.end, self.width = len(head), len(head) + 1, bits
        self.code = Code(np.concatenate([np.asarray(counts, float)[self.order], [max(rest, 1), max(ends, 1)]]))
        self.offsets = np.array([0, *(-(-self.code.nodes // BLOCK) * BLOCK + k * (1 << bits) for k in range(self.predictors))])

    def gather(self, held: list[tuple]):
        """(codes, contexts, pieces' sizes, escaped words, the pieces that they are in) of pieces, one after the other."""
        words = Words(b" ".join(p[1] for p in held))
        bounds = np.cumsum([len(p[1]) + 1 for p in held])
        piece = np.searchsorted(bounds, words.starts, side="right")
        ids = self.codes.find(words.hashes)
        missed = np.flatnonzero(ids < 0)
        ids[missed] = self.escape
        many, last_one = np.bincount(piece, minlength=len(held)), np.array([p[3] for p in held])
        at = np.cumsum(many)[last_one]
        whole, ending = (words.hashes >> np.uint64(32)).astype(np.uint32), words.endings()
        ids, whole, ending = np.insert(ids, at, self.end), np.insert(whole, at, 0), np.insert(ending, at, 0)
        sizes = many + last_one
        last, last_ending, older = np.zeros((3, len(ids)), np.uint32)
        last[1:], last_ending[1:], older[2:] = whole[:-1], ending[:-1], ending[:-2]
        starts = np.cumsum(sizes) - sizes
        for x in (last, last_ending, older):
            x[starts[sizes > 0]] = 0
        older[starts[sizes > 1] + 1] = 0
        for k, p in enumerate(held):
            if p[2] and sizes[k]:
                s, two = int(starts[k]), Words(b" ".join(p[2]))
                last[s], last_ending[s] = two.hashes[-1] >> np.uint64(32), two.endings()[-1]
                older[s : s + 2] = [two.endings()[0] if len(p[2]) > 1 else 0, last_ending[s]][: int(sizes[k])]
        mixed = [(last + np.uint32(1)) * _MIX[0], (last_ending * _MIX[3] + older + np.uint32(13)) * _MIX[1]]
        return ids, np.stack([h ^ h >> np.uint32(15) for h in mixed]), sizes, words.take(missed), piece[missed]

    def events(self, ids: np.ndarray, contexts: np.ndarray) -> Events:
        sizes = self.code.size[ids]
        place = ranges(sizes)
        step = self.code.path.take(np.repeat(self.code.first[ids], sizes) + place)
        node = step >> 1
        slots, spread, shift = np.empty((self.predictors, len(step)), np.int32), node.view(np.uint32) * _MIX[3], np.uint32(32 - self.width)
        slots[0] = node
        for k in range(1, self.predictors):
            h = np.repeat(contexts[k - 1], sizes)
            h ^= spread
            h *= _MIX[0]
            h >>= shift
            np.add(h.view(np.int32), np.int32(self.offsets[k]), out=slots[k])
        return Events(slots, (step & 1).astype(np.uint8), np.minimum(place, PLACES - 1).astype(np.uint8), np.cumsum(sizes) - sizes)

    def stream(self, texts, most: int = CHUNK):
        """Events of texts, in parts of about `most` bytes."""
        for held in groups(texts, most):
            ids, contexts, *_ = self.gather(held)
            yield self.events(ids, contexts)


class SpellingContexts:
    """Words as their bytes and a space. Predictors: the last 1, 2, 3 and 5 bytes of the word so far."""

    orders, predictors = (1, 2, 3, 5), 4

    def __init__(self, bits: int):
        self.widths = (16, *(max(12, bits - d) for d in (2, 1, 0)))
        self.offsets = np.concatenate([[0], np.cumsum([1 << w for w in self.widths])])

    def events(self, words: list[bytes]) -> Events:
        data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        at, wide, past = ranges(sizes), data.astype(np.uint64), np.zeros(len(data), np.uint64)
        for k in range(1, 6):  # the k-th last byte of the word, 0 before its start
            back = np.zeros(len(data), np.uint64)
            back[k:] = wide[:-k]
            past |= np.where(at >= k, back, np.uint64(0)) << np.uint64(8 * (k - 1))
        value = data.astype(np.int32)
        partial = np.stack([(1 << j) | (value >> (8 - j)) for j in range(8)], axis=1).ravel()  # 1 and the byte's bits before
        slots = np.empty((4, 8 * len(data)), np.int32)
        slots[0] = np.repeat((past & np.uint64(255)).astype(np.int32) << 8, 8) | partial
        for k, order in enumerate(self.orders[1:], 1):
            h = ((past & np.uint64((1 << 8 * order) - 1)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.widths[k])
            slots[k] = (np.repeat(h.astype(np.int32), 8) ^ partial * np.int32(0x1E3779)) & np.int32((1 << self.widths[k]) - 1)
            slots[k] += np.int32(self.offsets[k])
        return Events(slots, np.unpackbits(data), np.tile(np.arange(8, dtype=np.uint8), len(data)), 8 * (np.cumsum(sizes) - sizes))

    def stream(self, words, most: int = CHUNK):
        held, size = [], 0
        for w in words:
            held.append(w)
            size += len(w) + 1
            if 4 * size > most:
                yield self.events(held)
                held, size = [], 0
        if held:
            yield self.events(held)


def inputs(zeros, ones) -> np.ndarray:
    """The log odds of counts, as bytes."""
    return np.clip(np.round(np.log((ones + PRIOR) / (zeros + PRIOR)) * SCALE), -127, 127).astype(np.int8)


class Mixer:
    """w: weights by predictor and gate, the last row a bias; ones, all: the refinement's counts by place and probability."""

    def __init__(self, predictors: int):
        self.k, self.gates = predictors, PLACES << predictors - 1
        self.w = np.full((predictors + 1, self.gates), 0.3, np.float32)
        self.w[-1] = 0.0
        self.ones, self.all = np.zeros(PLACES * BINS), np.zeros(PLACES * BINS)

    def look(self, table: np.ndarray, e: Events):
        """(inputs, gate) of events; table: inputs(), by slot. The first predictor has no part in the gate."""
        x, gate = np.empty(e.slots.shape, np.float32), e.place.astype(np.int32)
        for k in range(self.k):
            raw = table.take(e.slots[k])
            np.multiply(raw, np.float32(1 / SCALE), out=x[k])
            if k:
                gate += (raw != 0) * np.int32(PLACES << k - 1)
        return x, gate

    def mixed(self, x, gate, w=None) -> np.ndarray:
        w = self.w if w is None else w
        z = w[-1].take(gate)
        for k in range(self.k):
            z += x[k] * w[k].take(gate)
        return np.clip(z, -LIMIT, LIMIT, out=z)

    @staticmethod
    def bins(z, place):
        return place.astype(np.int32) * BINS + np.minimum((z + np.float32(LIMIT)) * np.float32(BINS / (2 * LIMIT)), BINS - 1).astype(np.int32)

    def settled(self):
        """The refinement as factor and term of a probability, by bin: the mean of it and of what came at such probabilities."""
        return (0.5 + 4 / (self.all + 8)).astype(np.float32), (self.ones / (2 * (self.all + 8))).astype(np.float32)

    @staticmethod
    def odds_to_p(z) -> np.ndarray:
        p = np.exp(-z)
        p += 1
        return np.reciprocal(p, out=p)

    def likelihood(self, z, p, e_bits, place, settled) -> np.ndarray:
        """The refined probability of the bits."""
        k = self.bins(z, place)
        p = p * settled[0].take(k) + settled[1].take(k)
        return np.clip(np.abs(p - (1 - e_bits)), np.float32(1e-6), np.float32(1 - 1e-6))

    def learn(self, x, e: Events, gate) -> None:
        for s in range(0, len(gate), STEP):
            part = slice(s, s + STEP)
            g, bits, xs = gate[part], e.bits[part], x[:, part]
            z = self.mixed(xs, g)
            k, n = self.bins(z, e.place[part]), len(g)
            self.ones += np.bincount(k, bits, len(self.ones))
            self.all += np.bincount(k, minlength=len(self.all))
            err = bits - self.odds_to_p(z)
            step = RATE / (np.bincount(g, minlength=self.gates) + n / self.gates)
            for j in range(self.k):
                self.w[j] += step * np.bincount(g, err * xs[j], self.gates)
            self.w[-1] += step * np.bincount(g, err, self.gates)


def online(mixer: Mixer, settled, x, e: Events, gate, text, ends, rate: float, calm: float) -> np.ndarray:
    """Probabilities of events of several texts, whose weights go on learning within each text. text: each event's text, from 0.
    Events come turn by turn, ending at `ends`; a turn's events are predicted by the weights that the turns before have left."""
    own = np.tile(mixer.w, int(text.max()) + 1 if len(text) else 1)
    cell, out, s = text * np.int32(mixer.gates) + gate, np.empty(len(gate), np.float32), 0
    for end in ends:
        part = slice(s, end)
        c, xs, bits = cell[part], x[:, part], e.bits[part]
        z = mixer.mixed(xs, c, own)
        p = mixer.odds_to_p(z)
        out[part] = mixer.likelihood(z, p, bits, e.place[part], settled)
        if end < len(gate):
            err = bits - p
            step = rate / (np.bincount(c, minlength=own.shape[1]) + calm)
            for j in range(mixer.k):
                own[j] += step * np.bincount(c, err * xs[j], own.shape[1])
            own[-1] += step * np.bincount(c, err, own.shape[1])
        s = end
    return out
