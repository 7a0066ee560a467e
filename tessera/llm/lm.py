"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

Tokens are the words of a text, A to Z lowered, and one end.  Documents whose crc32 of
the doc_id leaves remainder 1 by 5 are held out; everything is learned from the others.

1. Counts of all training tokens, pre-aggregated before the shuffle.  The ``HEAD`` most
   frequent words that occur twice are the head, a bounded number that may be broadcast; all others are the
   tail, and their counts are only ever joined by key.
2. Classes: one for "the previous word again", one for the tail, one for the end, and
   clusters of head words by the words they follow (counted over all training text).
3. The class model is a maximum-entropy model of the next class.  Features of the context:
   previous word, previous two words together, the word before the previous (a skip),
   the one before that (a wider skip), and a constant; rare words, pairs and wider skips are
   hashed to a fixed number of rows.
   Training documents are dealt by their digests to shards of about ``SHARD`` tokens, as many
   as the tokens ask for, and read in the order of their digests; every shard makes
   adaptive gradient updates in batches of fixed size, and the shards' weights are then mixed, each row in
   proportion to how often a shard has seen it, over a tree whose groups hold at most 64.  So
   scores depend on the rows and not on how they lie in files and partitions.
4. Inside a class of head words the word is chosen by softmaxes over the same features along
   a tree of ``WAYS`` branches whose frequent words are near the root (Huffman's), so that its
   chance is normalised over the class's words.  A branch's share of training tokens is the
   softmax's prior; pairs of feature and node are hashed to a fixed number of rows.  In the tail one
   count's discount, ``n1 / (n1 + 2 n2)`` over all training words and kept between 0 and 1 by
   half a word, is kept back for the one unknown word.  A word equal to its predecessor
   sums both ways to say it, head word or not.

Texts are turned into codes once, after the head is known, and written out; all later passes
read codes.  ``score`` is the model's log10 probability of the text, computed in numpy batches; what
tail words add comes from the join.  ``base_score`` is the smoothed unigram score.

Null and empty texts are one end.  Null doc_ids count as training documents.  Rows are
told apart by a number given on the way in, so repeated rows count and score once each.
Columns besides doc_id and text are not read.  Without training tokens every word is
unknown, and an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import batches, encoded
from tessera.plans.lineage import cut, drop

HEAD, CLASSES = 65_536, 32
#: Rows of the weight table: own rows of frequent words, hashed rows of other words, of pairs, of wider skips.
OWN, OTHER, PAIRS, WIDE = 8_192, 4_096, 16_384, 4_096
WORD_ROWS = OWN + OTHER
ROWS = 1 + 2 * WORD_ROWS + PAIRS + WIDE
#: Rows of weights inside classes, the row of all nodes first, and branches of a node.
INNER, WAYS = 65_536, 16
FOLLOWED, BATCH, BLOCK, FAN, DOCUMENTS = 64, 2_048, 512, 64, 1_000
REPEAT, TAIL, END, FIRST = 0, 1, 2, 3
#: Key of the end, which no word has but by chance, code before a text, characters of a piece.
END_KEY, START, PIECE = (1 << 62) + 1, -1 - HEAD, 2_000_000
RATE = 0.5
#: Gradients of a row in a batch that are added one after the other.
FEW = 4
#: Training tokens of a shard, more or less.
SHARD = 4_000_000
#: Words whose digests are computed at once.
AT_ONCE = 300_000
#: Words that a task counts before it gives its counts away.
COUNTED = 600_000


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_BYTE, _HALF = np.uint64(0xFF), np.uint64(0xFFFFFFFF)
#: 1 for what separates words.
_SPACES = bytes(int(b in b"\x20\t\n\x0b\x0c\r") for b in range(256))


def _rotate(x: np.ndarray, bits: int) -> None:
    high = x >> np.uint64(64 - bits)
    x <<= np.uint64(bits)
    x |= high


def _spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words."""
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = np.frombuffer(raw.translate(_SPACES), bool)
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2] - edge[::2]


def _digests(raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64 (seed 42) of words that 16 bytes follow, those of one length together; words beyond 31 bytes, which XXH64 reads in stripes, one by one."""
    lanes = np.frombuffer(raw, "<u8", len(raw) // 8)

    def read(at: np.ndarray) -> np.ndarray:
        place, bits = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
        out = lanes.take(place) >> bits
        high = lanes.take(place + 1) << (np.uint64(63) - bits)
        out |= high << np.uint64(1)
        return out

    kind = np.minimum(sizes, 32).astype(np.uint8)  # short keys are sorted by digits
    order = np.argsort(kind, kind="stable")
    at_all, ends = starts[order], np.bincount(kind, minlength=33).cumsum()
    found = np.empty(len(starts), np.uint64)
    for size in range(1, 32):
        at = at_all[ends[size - 1] : ends[size]]
        if not len(at):
            continue
        h = np.full(len(at), (42 + int(_P5) + size) % 2**64, np.uint64)
        for low in range(0, size - 7, 8):
            x = read(at + low) * _P2
            _rotate(x, 31)
            h ^= x * _P1
            _rotate(h, 27)
            h *= _P1
            h += _P4
        left = size % 8
        if left:
            rest = read(at + (size - left))
        if left >= 4:
            h ^= (rest & _HALF) * _P1
            _rotate(h, 23)
            h *= _P2
            h += _P3
        for k in range(left & 4, left):
            h ^= ((rest >> np.uint64(8 * k)) & _BYTE) * _P5
            _rotate(h, 11)
            h *= _P1
        for bits, factor in ((33, _P2), (29, _P3)):
            h ^= h >> np.uint64(bits)
            h *= factor
        h ^= h >> np.uint64(32)
        found[ends[size - 1] : ends[size]] = h
    long = slice(ends[31], None)
    found[long] = [xxhash.xxh64_intdigest(raw[a : a + n], 42) for a, n in zip(at_all[long].tolist(), sizes[order[long]].tolist(), strict=True)]
    out = np.empty(len(starts), np.uint64)
    out[order] = found
    return out


def _word_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of 63 bits of all words, A to Z lowered, and how many words each text has."""
    raws = [encoded(text) for text in texts]
    raw = b"\n".join([*raws, b" " * 16]).lower()
    starts, sizes = _spans(raw)
    before = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)]))
    keys = np.empty(len(starts), np.int64)
    for at in range(0, len(starts), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        keys[part] = (_digests(raw, starts[part], sizes[part]) >> np.uint64(1)).astype(np.int64)
    return keys, np.diff(before)


def keyed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all tokens, END_KEY after each text's words; where each text starts; words' places in the keys."""
    keys, words = _word_keys(texts)
    place = np.arange(len(keys)) + np.repeat(np.arange(len(texts)), words)
    out = np.full(len(keys) + len(texts), END_KEY, np.int64)
    out[place] = keys
    return out, np.concatenate(([0], np.cumsum(words + 1)[:-1])).astype(np.int64), place


class Places:
    """Keys to ``-1 - place`` in the head, other keys as they are: a few tables by different bits of the key."""

    def __init__(self, head: np.ndarray) -> None:
        self.head, self.tables = head, []
        left = np.arange(len(head))
        for shift in (43, 23, 3, 33, 13, 38, 18, 8, 28):
            if not len(left):
                break
            table = np.full(1 << 20, -1, np.int32)
            slot = self._slots(head[left], shift)
            table[slot[::-1]] = left[::-1]  # the most frequent word of a slot stays
            self.tables.append((shift, table))
            left = left[table[slot] != left]
        self.rest = {int(head[i]): i for i in left}

    @staticmethod
    def _slots(keys: np.ndarray, shift: int) -> np.ndarray:
        return (keys >> shift) & 0xFFFFF

    def codes(self, keys: np.ndarray) -> np.ndarray:
        out = keys.copy()
        if not len(self.head):
            return out
        open_ = np.arange(len(keys))
        for shift, table in self.tables:
            found = table[self._slots(keys[open_], shift)]
            hit = (found >= 0) & (self.head[found] == keys[open_])
            out[open_[hit]] = -1 - found[hit].astype(np.int64)
            open_ = open_[~hit & (found >= 0)]  # an empty slot ends the search: no head word is beyond it
        for i in open_.tolist() if self.rest else ():
            if keys[i] in self.rest:
                out[i] = -1 - self.rest[int(keys[i])]
        return out


def _summed(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, in order, and the sums of their counts."""
    order = np.argsort(words, kind="stable")
    words = words[order]
    first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
    return words[first], np.add.reduceat(counts[order], first)


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the words of all texts, given away whenever a task holds ``COUNTED`` words."""
    held, fresh, waiting = (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0
    for frame in batches(frames, PIECE):
        keys = np.sort(np.append(_word_keys(frame["text"].tolist())[0], np.full(len(frame), END_KEY)))
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        fresh.append((keys[first], np.diff(np.append(first, len(keys)))))
        waiting += len(first)
        if waiting >= COUNTED:
            held, fresh, waiting = _summed(*map(np.concatenate, zip(held, *fresh, strict=True))), [], 0
            if len(held[0]) >= COUNTED:
                yield pd.DataFrame({"word": held[0], "c": held[1]})
                held = (np.empty(0, np.int64), np.empty(0, np.int64))
    if fresh or len(held[0]):
        words, counts = _summed(*map(np.concatenate, zip(held, *fresh, strict=True)))
        yield pd.DataFrame({"word": words, "c": counts})


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _rests(products: np.ndarray, rows: int) -> np.ndarray:
    """Remainders of the upper bits, by a division that numpy does for many at once."""
    x = (products >> np.uint64(33)).astype(np.uint32)
    x -= x // np.uint32(rows) * np.uint32(rows)
    return x.astype(np.int64)


def _hashed(values: np.ndarray, rows: int) -> np.ndarray:
    return _rests(values.astype(np.uint64) * _FACTOR, rows)


def _word_rows(codes: np.ndarray) -> np.ndarray:
    place = -1 - codes
    out = np.where((codes < 0) & (place < OWN), place, 0)
    other = np.flatnonzero((codes >= 0) | (place >= OWN))
    out[other] = OWN + _hashed(codes[other], OTHER)
    return out


def _before(codes: np.ndarray, starts: np.ndarray, back: int) -> np.ndarray:
    """Codes ``back`` tokens earlier, START before a text's first."""
    out = np.full(len(codes), START, np.int64)
    if len(codes) > back:
        out[back:] = codes[:-back]
    for k in range(back):
        place = starts + k
        out[place[place < len(codes)]] = START
    ends = np.append(starts[1:], len(codes))
    for k in range(back):  # short texts: their tokens k < back have no such predecessor
        place = starts + k
        ok = place < ends
        out[place[ok]] = START
    return out


def context_rows(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight rows of every token's context, ``(tokens, 4)``, and the codes of the previous tokens."""
    one, two, three = (_before(codes, starts, k) for k in (1, 2, 3))
    pair = _hashed(one * np.int64(31) + two * np.int64(1_000_003), PAIRS)
    rows = np.empty((4, len(codes)), np.int32)  # a feature's rows lie together
    rows[0] = 1 + _word_rows(one)
    rows[1] = 1 + WORD_ROWS + _word_rows(two)
    rows[2] = 1 + 2 * WORD_ROWS + pair
    rows[3] = 1 + 2 * WORD_ROWS + PAIRS + _hashed(three, WIDE)
    return rows.T, one


def labels(codes: np.ndarray, previous: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    kind = np.where(codes < 0, class_of[np.clip(-1 - codes, 0, len(class_of) - 1)], TAIL) if len(class_of) else np.full(len(codes), TAIL)
    return np.where(codes == previous, REPEAT, kind)


def _logits(weights: np.ndarray, rows: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
    logits = weights.take(rows[:, 0], axis=0)
    logits += weights[0]
    for k in range(1, rows.shape[1]):
        logits += weights.take(rows[:, k], axis=0)
    np.clip(logits, -60, 60, out=logits)  # within what float32 can raise e to
    if prior is not None:
        logits += prior
    return logits


def _sums(values: np.ndarray) -> np.ndarray:
    return values @ np.ones((values.shape[1], 1), np.float32)


def log_softmax(weights: np.ndarray, rows: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
    logits = _logits(weights, rows, prior)
    logits -= np.log(_sums(np.exp(logits)))
    return logits


class Trainer:
    """Gradient updates of one shard, whose steps adapt to each row's gradients so far."""

    def __init__(self, rows: int, width: int) -> None:
        self.weights = np.zeros((rows, width), np.float32)
        self.squares = np.full(rows, 1.0, np.float32)
        self.seen = np.zeros(rows, np.int64)
        self.whole = self.weights.view(f"V{4 * width}").ravel()  # a row as one value, which is written at once

    def update(self, rows: np.ndarray, wanted: np.ndarray, prior: np.ndarray | None = None) -> None:
        """One step on a batch, a feature at a time: what is gathered and summed then stays near the processor."""
        gradient = _logits(self.weights, rows, prior)
        np.exp(gradient, out=gradient)
        gradient /= _sums(gradient)
        gradient[np.arange(len(wanted)), wanted] -= 1
        edge = np.ones(len(wanted) + 1, bool)
        for k in range(rows.shape[1]):
            key = rows[:, k].astype(np.uint16)  # ROWS and INNER fit, and short keys are sorted by digits
            order = key.argsort(kind="stable")
            key = key.take(order)
            np.not_equal(key[1:], key[:-1], out=edge[1:-1])
            first = edge.nonzero()[0]
            size = first[1:] - first[:-1]
            first = first[:-1]
            total = gradient.take(order.take(first), axis=0)  # most rows occur once in a batch
            self._more(total, gradient, order, first, size)
            self._step(key.take(first).astype(np.int64), total, size)
        self._step(np.zeros(1, np.int64), gradient.sum(axis=0, keepdims=True), np.array([len(wanted)]))

    @staticmethod
    def _more(total: np.ndarray, gradient: np.ndarray, order: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """Adds the second to the ``FEW``-th gradient of each row one after the other, and those beyond in runs."""
        many = (size > 1).nonzero()[0]
        for k in range(1, FEW):
            if not len(many):
                return
            sums = total.take(many, axis=0)
            sums += gradient.take(order.take(first.take(many) + k), axis=0)
            total[many] = sums
            many = many[size.take(many) > k + 1]
        if len(many):
            left = size.take(many) - FEW
            runs = left.cumsum() - left
            place = np.arange(runs[-1] + left[-1]) + (first.take(many) + FEW - runs).repeat(left)
            inside = gradient.take(order.take(place), axis=0).view(np.complex64)  # two columns at once
            total[many] += np.add.reduceat(inside, runs, axis=0).view(np.float32)

    def _step(self, own: np.ndarray, total: np.ndarray, size: np.ndarray) -> None:
        squares = self.squares.take(own)
        squares += np.einsum("ij,ij->i", total, total)
        self.squares[own] = squares
        total *= (RATE / np.sqrt(squares))[:, None]
        weights = self.weights.take(own, axis=0)
        weights -= total
        np.put(self.whole, own, weights.view(self.whole.dtype).ravel(), mode="clip")
        self.seen[own] += size


def _code(held):
    """Texts to codes: which tokens are of the head, the places of those, and the keys of the others."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = Places(held.value)
        for frame in batches(frames, PIECE):
            keys, starts, _ = keyed(frame["text"].tolist())
            codes = places.codes(keys)
            parts = np.split(codes, starts[1:])
            heads = [part < 0 for part in parts]
            packed = {"n": list(map(len, parts)), "mask": [np.packbits(h).tobytes() for h in heads], "places": [(-1 - c[h]).astype(np.uint16).tobytes() for c, h in zip(parts, heads, strict=True)], "tail": [c[~h].tobytes() for c, h in zip(parts, heads, strict=True)]}
            yield pd.DataFrame({"rid": frame["rid"], "doc_id": frame["doc_id"].astype("Int64"), "mark": frame["mark"], "held_out": frame["held_out"], **packed})

    return run


_CODES = ("n", "mask", "places", "tail")
_CODED = "rid long, doc_id long, mark long, held_out boolean, n int, mask binary, places binary, tail binary"


def _sequences(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all tokens of a frame's texts, and where each text starts; the key of the word for words beyond the head."""
    sizes = frame["n"].to_numpy(np.int64)
    head = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(frame["mask"], sizes.tolist(), strict=True)]).view(bool)
    codes = np.empty(len(head), np.int64)
    codes[head] = -1 - np.frombuffer(b"".join(frame["places"]), np.uint16).astype(np.int64)
    codes[~head] = np.frombuffer(b"".join(frame["tail"]), np.int64)
    return codes, np.concatenate(([0], sizes.cumsum()[:-1])).astype(np.int64)


def cluster(points: np.ndarray, counts: np.ndarray, groups: int, rounds: int = 12) -> np.ndarray:
    """Groups of like rows of counts by their shares, the frequent ones counting more; the same whenever it runs."""
    if groups < 1 or not len(points):
        return np.zeros(len(points), np.int64)
    points = np.sqrt(points / np.maximum(points.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    weight = np.sqrt(counts.astype(np.float32))
    centres = [points[0]]
    far = np.full(len(points), np.inf, np.float32)
    for _ in range(1, groups):
        far = np.minimum(far, ((points - centres[-1]) ** 2).sum(axis=1))
        centres.append(points[int((far * weight).argmax())])
    centre = np.stack(centres)
    for _ in range(rounds):
        near = ((centre**2).sum(axis=1)[None, :] - 2 * points @ centre.T).argmin(axis=1)
        for g in range(groups):
            own = near == g
            if own.any():
                centre[g] = np.average(points[own], axis=0, weights=weight[own])
    return near


class Trees:
    """For every class a tree of its words: each word's nodes and branches from the root, -1 beyond; each node's log shares."""

    def __init__(self, class_of: np.ndarray, counts: np.ndarray) -> None:
        shares, paths = [], [[] for _ in range(len(class_of))]
        for c in np.unique(class_of):
            members = np.flatnonzero(class_of == c).tolist()
            heap = [(int(counts[i]), -i) for i in members]
            heapq.heapify(heap)
            up: dict[int, tuple[int, int]] = {}  # member, as -i, or node, as 1 + its number, to node and branch
            take = 2 + (len(members) - 2) % (WAYS - 1)
            while len(heap) > 1:
                inside = [heapq.heappop(heap) for _ in range(take)]
                total, node = sum(n for n, _ in inside), len(shares)
                shares.append([np.log(n / total) for n, _ in inside] + [-1e4] * (WAYS - take))
                up.update((item, (node, branch)) for branch, (_, item) in enumerate(inside))
                heapq.heappush(heap, (total, 1 + node))
                take = WAYS
            for i in members:
                at = -i
                while at in up:
                    paths[i].append(up[at])
                    at = 1 + up[at][0]
        self.shares = np.array(shares, np.float32).reshape(-1, WAYS)
        depth = max(map(len, paths), default=0)
        flat = np.array([p + [(-1, -1)] * (depth - len(p)) for p in paths], np.int32).reshape(len(class_of), depth, 2)
        self.node, self.branch = flat[..., 0], flat[..., 1]
        # the same without gaps
        on_way = self.node >= 0
        self.length = on_way.sum(axis=1)
        self.from_, self.nodes, self.branches = self.length.cumsum() - self.length, self.node[on_way], self.branch[on_way]
        self.product = (ROWS * (1 + np.arange(len(self.shares)))).astype(np.uint64) * _FACTOR

    def steps(self, places: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All choices on the ways to head words: whose, their weight rows, branches taken, and priors."""
        length = self.length.take(places)
        ends = length.cumsum()
        whose = np.arange(len(places)).repeat(length)
        at = np.arange(len(whose)) + (self.from_.take(places) + length - ends).repeat(length)
        node = self.nodes.take(at)
        # the hash of row + ROWS * (1 + node), whose two products are added
        products = (rows.T.astype(np.uint64) * _FACTOR).take(whose, axis=1)
        products += self.product.take(node)
        return whose, (1 + _rests(products, INNER - 1)).T, self.branches.take(at), self.shares.take(node, axis=0)

    def logs(self, weights: np.ndarray, places: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Log chance of each head word inside its class after its context."""
        whose, inner, branch, prior = self.steps(places, rows)
        if not len(whose):
            return np.zeros(len(places))
        logits = _logits(weights, inner, prior)
        found = logits[np.arange(len(whose)), branch]
        found -= np.log(_sums(np.exp(logits, out=logits)))[:, 0]
        return np.bincount(whose, found, len(places))


class Model:
    """Head, classes and weights: sizes fixed by the constants above."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, class_of: np.ndarray, total: int, distinct: int) -> None:
        self.head, self.counts, self.class_of = head, counts, class_of
        self.total, self.distinct = total, distinct
        self.trees = Trees(class_of, counts)
        self.base = np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1)))
        self.weights, self.inner = np.zeros((ROWS, CLASSES), np.float32), np.zeros((INNER, WAYS), np.float32)

    def tail_shares(self, words: int, n1: int, n2: int) -> tuple[float, float, float]:
        """The tail's training tokens, the discount kept back from each of its words, and the unknown word's share."""
        mass, discount = float(self.total - self.counts.sum()), (n1 + 0.5) / (n1 + 2 * n2 + 1)
        return mass, discount, discount * words / mass if words else 1.0


def _texts(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 5 == 1, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))


def _followed(train: DataFrame, size: int) -> np.ndarray:
    """How often each of ``size`` head words follows each of the most frequent words (the last column: any other)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(size * FOLLOWED, np.int64)
        for frame in filter(len, frames):
            all_codes, starts = _sequences(frame)
            place = -1 - _before(all_codes, starts, 1)
            column = np.where((place >= 0) & (place < FOLLOWED - 1), place, FOLLOWED - 1)
            own = all_codes < 0
            np.add.at(sums, (-1 - all_codes[own]) * FOLLOWED + column[own], 1)
        cell = np.flatnonzero(sums)
        for at in range(0, len(cell), 100_000):
            part = cell[at : at + 100_000]
            yield pd.DataFrame({"cell": part, "n": sums[part]})

    found = train.select(*_CODES).mapInPandas(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * FOLLOWED, np.float32)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, FOLLOWED)


def _learned(rows: pd.DataFrame, class_of: np.ndarray, trees: Trees) -> tuple[Trainer, Trainer]:
    """Weights of classes and inside them after the documents of one shard."""
    trainer, inside = Trainer(ROWS, CLASSES), Trainer(INNER, WAYS)
    rows = rows.sort_values(["mark", "doc_id"], kind="stable")
    for low in range(0, len(rows), DOCUMENTS):
        all_codes, starts = _sequences(rows.iloc[low : low + DOCUMENTS])
        contexts, previous = context_rows(all_codes, starts)
        wanted = labels(all_codes, previous, class_of)
        for at in range(0, len(wanted), BATCH):
            part = slice(at, at + BATCH)
            trainer.update(contexts[part], wanted[part])
            own = np.flatnonzero((all_codes[part] < 0) & (wanted[part] != REPEAT))
            _, inner, branch, prior = trees.steps(-1 - all_codes[part][own], contexts[part][own])
            if len(branch):
                inside.update(inner, branch, prior)
    return trainer, inside


def _train(spark, train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Weights of classes and inside them after one pass of every shard over its documents and a tree of mixtures."""
    held = spark.sparkContext.broadcast((model.class_of, model.trees))
    inner_from = -(-ROWS // BLOCK)  # blocks of the weights inside classes come after the others
    shards = max(-(-model.total // SHARD), 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(filter(len, frames))
        for shard, rows in pd.concat(parts, ignore_index=True).groupby("shard") if parts else ():
            for which, low in zip(_learned(rows, *held.value), (0, inner_from), strict=True):
                for block in range(-(-len(which.seen) // BLOCK)):
                    part = slice(block * BLOCK, (block + 1) * BLOCK)
                    if which.seen[part].any():
                        yield pd.DataFrame({"shard": [shard], "block": [low + block], "seen": [which.seen[part].tobytes()], "weights": [which.weights[part].tobytes()]})

    def mixed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        seen = [np.frombuffer(x, np.int64) for x in rows["seen"]]
        total = np.sum(seen, axis=0)
        weights = sum(n[:, None] * np.frombuffer(w, np.float32).reshape(len(total), -1).astype(np.float64) for n, w in zip(seen, rows["weights"], strict=True))
        weights = (weights / np.maximum(total, 1)[:, None]).astype(np.float32)
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0]) // FAN], "block": [int(rows["block"].iloc[0])], "seen": [total.tobytes()], "weights": [weights.tobytes()]})

    schema = "shard int, block int, seen binary, weights binary"
    dealt = train.select(F.pmod(F.xxhash64("mark", "doc_id"), F.lit(shards)).cast("int").alias("shard"), "mark", "doc_id", *_CODES)
    parts = dealt.repartitionById(shards, "shard").mapInPandas(run, schema)
    while True:
        parts = parts.withColumn("group", F.floor(F.col("shard") / FAN)).groupBy("block", "group").applyInPandas(lambda rows: mixed(rows.drop(columns="group")), schema)
        shards = -(-shards // FAN)
        if shards <= 1:
            break
    weights, inner = np.zeros((ROWS, CLASSES), np.float32), np.zeros((INNER, WAYS), np.float32)
    for row in parts.select("block", "weights").collect():
        whole, block = (weights, row["block"]) if row["block"] < inner_from else (inner, row["block"] - inner_from)
        found = np.frombuffer(row["weights"], np.float32).reshape(-1, whole.shape[1])
        whole[block * BLOCK : block * BLOCK + len(found)] = found
    return weights, inner


_SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, tail array<long>, times array<int>, again array<long>, again_repeat array<double>, again_tail array<double>"


def _cut_at(starts: np.ndarray, places: np.ndarray, *arrays: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Arrays of values at places, in the parts that lie in each text."""
    cuts = np.append(np.searchsorted(places, starts), len(places)).tolist()
    for values in arrays:
        yield [values[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _score(held):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Model = held.value
        for frame in filter(len, frames):
            all_codes, starts = _sequences(frame)
            rows, previous = context_rows(all_codes, starts)
            wanted = labels(all_codes, previous, model.class_of)
            value, repeat, tail = (np.empty(len(all_codes)) for _ in range(3))
            in_head, place = all_codes < 0, np.maximum(-1 - all_codes, 0)
            for at in range(0, len(value), BATCH):
                part = slice(at, at + BATCH)
                logs = log_softmax(model.weights, rows[part])
                own = logs[np.arange(len(logs)), wanted[part]].astype(np.float64)
                if len(model.head):
                    inside, known = np.zeros(len(own)), np.flatnonzero(in_head[part])
                    inside[known] = model.trees.logs(model.inner, place[part][known], rows[part][known])
                    again = np.flatnonzero(in_head[part] & (wanted[part] == REPEAT))
                    both = np.logaddexp(own[again], logs[again, model.class_of[place[part][again]]] + inside[again])
                    own += inside  # nothing for words beyond the head
                    own[again] = both
                value[part], repeat[part], tail[part] = own, logs[:, REPEAT], logs[:, TAIL]
            base = np.where(in_head, model.base[np.minimum(place, max(len(model.base) - 1, 0))], 0.0) if len(model.base) else np.zeros(len(value))
            sums = lambda x: np.add.reduceat(x, starts)
            ends = np.append(starts[1:], len(all_codes))
            # words beyond the head, whose shares are joined by key; those said again have two ways, which meet there
            twice = np.flatnonzero(~in_head & (wanted == REPEAT))
            value[twice] = 0.0
            once = np.flatnonzero(~in_head & (wanted != REPEAT))
            whose = np.repeat(np.arange(len(starts)), ends - starts)[once]
            order = np.lexsort((all_codes[once], whose))
            whose, words = whose[order], all_codes[once][order]
            first = np.flatnonzero(np.concatenate(([True], (whose[1:] != whose[:-1]) | (words[1:] != words[:-1])))) if len(words) else np.empty(0, np.int64)
            times = np.diff(np.append(first, len(words))).astype(np.int32)
            tails, counts = _cut_at(np.arange(len(starts)), whose[first], words[first], times)
            said, ways, others = _cut_at(starts, twice, all_codes[twice], repeat[twice], tail[twice])
            yield pd.DataFrame({"rid": frame["rid"], "doc_id": frame["doc_id"].astype("Int64"), "held_out": frame["held_out"], "n_tokens": ends - starts, "known": sums(in_head.astype(np.int64)), "base": sums(base), "score": sums(value) / np.log(10), "tail": tails, "times": counts, "again": said, "again_repeat": ways, "again_tail": others})

    return run


def _least_count(counts: DataFrame) -> int:
    """A count that at least ``HEAD`` words reach and not many more, from a histogram of seven leading bits.

    Without it every partition would send its own ``HEAD`` words to the task that merges them.
    """
    bucket = F.expr("case when c < 128 then c else shiftleft(shiftright(c, length(bin(c)) - 7), length(bin(c)) - 7) end")
    seen = 0
    for low, n in sorted(map(tuple, counts.where("c > 1").groupBy(bucket.alias("low")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        seen += n
        if seen >= HEAD:
            return int(low)
    return 2


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark = docs.sparkSession
    texts = _texts(docs)
    train = texts.where(~F.col("held_out"))
    counts = cut(train.select("text").mapInPandas(_counts, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counts.where(F.col("c") >= _least_count(counts)).orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    head, own = top["word"].to_numpy(), top["c"].to_numpy()
    held = spark.sparkContext.broadcast(head)
    numbered = texts.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("mark"), "held_out", "text")
    coded = cut(numbered.mapInPandas(_code(held), _CODED))
    train = coded.where(~F.col("held_out"))
    class_of = FIRST + cluster(_followed(train, len(head)), own, CLASSES - FIRST) if len(head) else np.zeros(0, np.int64)
    class_of[head == END_KEY] = END
    model = Model(head, own, class_of, sums["n"], sums["v"])
    in_tail = F.col("c") < 2
    if len(head) == HEAD:
        in_tail = (F.col("c") < int(own[-1])) | ((F.col("c") == int(own[-1])) & (F.col("word") > int(head[-1])))
    tail = counts.where(in_tail).select("word", "c")
    rare = counts.agg(F.count_if(in_tail).alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    if len(head):
        model.weights, model.inner = _train(spark, train, model)
    held = spark.sparkContext.broadcast(model)
    scored = cut(coded.drop("mark").mapInPandas(_score(held), _SCORED))
    drop(coded)
    # the tail's share of the scores
    mass, discount, unknown = model.tail_shares(rare["v"], rare["n1"], rare["n2"])
    base_norm = sums["n"] + 0.5 * (sums["v"] + 1)
    c, n = F.coalesce("c", F.lit(0)), F.col("n")
    inside = F.when(c > 0, F.ln((c - F.lit(discount)) / F.lit(mass))).otherwise(F.lit(float(np.log(unknown))))
    share = F.when(F.col("repeat").isNull(), n * inside).otherwise(F.greatest("repeat", F.col("other") + inside) + F.log1p(F.exp(-F.abs(F.col("repeat") - F.col("other") - inside))))
    once = scored.select("rid", F.inline(F.arrays_zip(F.col("tail").alias("word"), F.col("times").alias("n")))).select("rid", "word", "n", F.lit(None).cast("double").alias("repeat"), F.lit(None).cast("double").alias("other"))
    again = scored.where(F.size("again") > 0).select("rid", F.inline(F.arrays_zip(F.col("again").alias("word"), F.col("again_repeat").alias("repeat"), F.col("again_tail").alias("other")))).select("rid", "word", F.lit(1).alias("n"), "repeat", "other")
    words = once.unionByName(again).join(tail, "word", "left")
    added = words.groupBy("rid").agg(F.sum(n * F.log10((c + 0.5) / F.lit(float(base_norm)))).alias("more_base"), (F.sum(share) / float(np.log(10))).alias("more"), F.sum(F.when(c > 0, n).otherwise(0)).alias("more_known"))
    joined = scored.drop("tail", "times", "again", "again_repeat", "again_tail").join(added, "rid", "left")
    zero = lambda name: F.coalesce(name, F.lit(0))
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("known") + zero("more_known")).cast("long").alias("n_known"), F.lit(int(sums["n"])).cast("long").alias("train_tokens"), (F.col("base") + zero("more_base")).alias("base_score"), (F.col("score") + zero("more")).alias("score"))
