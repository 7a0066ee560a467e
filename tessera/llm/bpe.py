"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoder.

Encoding.  The text is cut at special tokens and then into pieces by the vocabulary's
word pattern; merges never cross a piece.  ``sufficient_lookahead`` reads off the merge
list how many bytes to the right can still change a token: a merge waits for earlier
merges that would take its right end away, those wait for still earlier ones, and the
longest such chain bounds the lookahead.  The transducer reads a piece byte by byte.  For
every end it finds the one token that can end there, from the rule that a sequence of
tokens is the encoding if and only if each neighbouring pair is the encoding of its own
bytes.  A token that ends at least the lookahead before the last byte read is stable: it
is emitted and forgotten, so that a piece of any length needs the memory of a window.  What
is left when the piece ends is emitted then.  Short pieces come again and again; their
output is remembered in a table of bounded size.

Decoding.  Tokens give bytes; a state machine holds back an unfinished character of at
most three bytes, replaces what can't become a character, and emits text as it goes.

Null texts are empty; both give no tokens.  Every row gives one row, repeated or not;
null doc_ids stay null; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import batches

#: Fixed value: the word pattern of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text whose pieces are held at once, and of a piece that are turned into bytes at once.
SEGMENT, PART = 1 << 16, 1 << 12
#: Entries of a task's caches, and the longest piece that is remembered.
CACHE_ENTRIES, REMEMBERED = 1_000_000, 64


def byte_alphabet() -> dict[str, int]:
    """Character of the vocabulary file to byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file, given as its JSON text."""

    def __init__(self, source: str) -> None:
        model = json.loads(source)
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.ids = {as_bytes(s): i for s, i in model["model"]["vocab"].items() if s not in self.special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.merges = [(as_bytes(a), as_bytes(b)) for a, b in pairs]
        self.ranks = {pair: r for r, pair in enumerate(self.merges)}
        self.longest = max(map(len, self.ids))
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}

    def sufficient_lookahead(self) -> int:
        """Bytes to the right of a token's end that can still change it."""
        made = {a + b: (a, b) for a, b in self.merges}

        def ends(token: bytes) -> Iterator[bytes]:
            while True:
                yield token
                if token not in made:
                    return
                token = made[token][1]

        reach: dict[bytes, int] = {}
        most = self.longest
        for a, b in self.merges:
            chain = len(b) + max((reach.get(e, 0) for e in ends(b)), default=0)
            reach[a] = max(reach.get(a, 0), chain)
            most = max(most, chain)
        return most


class Encoder:
    """The transducer.  ``encode`` gives token ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary, lookahead: int | None = None) -> None:
        self.v = vocabulary
        self.lookahead = vocabulary.sufficient_lookahead() if lookahead is None else lookahead
        self.packed = {token: i.to_bytes(4, "little") for token, i in vocabulary.ids.items()}
        self.pattern = regex.compile(PIECES)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.most_open = 0
        sizes: dict[bytes, set[int]] = {}
        for token in vocabulary.ids:
            sizes.setdefault(token[-2:], set()).add(len(token))
        #: Lengths of tokens by their last two bytes, the longest first.
        self.sizes = {tail: sorted(found, reverse=True) for tail, found in sizes.items()}

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids, a segment of the text at a time."""
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.v.special:
                yield self.v.special[part].to_bytes(4, "little")
            elif part:
                yield from self._plain(part)

    def _plain(self, text: str) -> Iterator[bytes]:
        at, known = 0, self.known
        while at < len(text):
            end = self._safe_cut(text, at + SEGMENT)
            if end - at > 2 * SEGMENT:  # no safe cut nearby: piece by piece
                piece = self.pattern.match(text, at)
                yield from self._long(text, at, piece.end())
                at = piece.end()
                continue
            segment = text if at == 0 and end == len(text) else text[at:end]
            pieces = self.pattern.findall(segment)
            try:
                yield b"".join(map(known.__getitem__, pieces))
            except KeyError:
                yield b"".join([known[p] if p in known else self._piece(p) for p in pieces])
            at = end

    @staticmethod
    def _safe_cut(text: str, at: int) -> int:
        """The next place from ``at`` where a space follows something that isn't white space: no piece spans it."""
        while at < len(text):
            at = text.find(" ", at)
            if at < 0:
                break
            if not text[at - 1].isspace():
                return at
            at += 1
        return len(text)

    def _piece(self, piece: str) -> bytes:
        if len(piece) > REMEMBERED:
            return b"".join(self._long(piece, 0, len(piece)))
        data, last = piece.encode("utf-8", "surrogatepass"), [b""]
        self._read(data, last)
        packed = b"".join([self.packed[last[e]] for e in self._ends(last, len(data))])
        if len(self.known) >= CACHE_ENTRIES:
            self.known.clear()
        self.known[piece] = packed
        return packed

    def _long(self, text: str, start: int, end: int) -> Iterator[bytes]:
        """Packed ids of one piece, a part of it at a time."""
        parts = (text[at : min(at + PART, end)].encode("utf-8", "surrogatepass") for at in range(start, end, PART))
        for stable in self.transduce(parts):
            yield b"".join(map(self.packed.__getitem__, stable))

    def _merged(self, data: bytes) -> list[bytes]:
        """Apply the earliest merge of the list, leftmost first, until none applies."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.v.ranks.get
        never = len(self.v.merges)
        found = [rank(p, never) for p in zip(parts, parts[1:], strict=False)]
        while found:
            low = min(found)
            if low == never:
                break
            i = found.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i:
                found[i - 1] = rank((parts[i - 1], parts[i]), never)
            if i < len(found):
                found[i] = rank((parts[i], parts[i + 1]), never)
        return parts

    def _fits(self, pair: tuple[bytes, bytes]) -> bool:
        """Whether the two tokens are the encoding of their joined bytes; nothing may stand on the left."""
        said = self.pairs.get(pair)
        if said is not None:
            return said
        left, right = pair
        if len(self.pairs) >= CACHE_ENTRIES:
            self.pairs.clear()
        said = self.pairs[pair] = self._merged(left + right) == ([left, right] if left else [right])
        return said

    def _read(self, data: bytes, last: list[bytes]) -> None:
        """Read on to the end of ``data``: for each further byte the last token of the encoding up to there."""
        packed, sizes, said = self.packed, self.sizes, self.pairs.get
        for end in range(len(last), len(data) + 1):
            for size in sizes.get(data[end - 2 : end], ()) if end > 1 else ():
                if size <= end:
                    token = data[end - size : end]
                    if token in packed:
                        pair = (last[end - size], token)
                        fits = said(pair)
                        if self._fits(pair) if fits is None else fits:
                            last.append(token)
                            break
            else:
                token = data[end - 1 : end]
                if token not in packed or not self._fits((last[end - 1], token)):
                    raise ValueError("the vocabulary lacks a byte of the text")
                last.append(token)

    def transduce(self, parts: Iterable[bytes]) -> Iterator[list[bytes]]:
        """Tokens of one piece that comes in parts, as soon as they are stable."""
        window = max(2 * self.lookahead, 256)
        data, last = b"", [b""]  # the bytes that no emitted token holds; last[k]: the last token of the encoding of data[:k]
        for part in parts:
            data += part
            self._read(data, last)
            self.most_open = max(self.most_open, len(data))
            if len(data) >= window:
                stable = [last[e] for e in self._ends(last, len(data)) if e <= len(data) - self.lookahead]
                emitted = sum(map(len, stable))
                data, last = data[emitted:], last[emitted:]
                yield stable
        yield [last[e] for e in self._ends(last, len(data))]

    @staticmethod
    def _ends(last: list[bytes], at: int) -> list[int]:
        """Ends of the tokens of the encoding up to ``at``."""
        out = []
        while at > 0:
            out.append(at)
            at -= len(last[at])
        return out[::-1]


class Decoder:
    """Bytes of tokens to text, piece by piece."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        table = vocabulary.bytes_of
        self.table = [table.get(i, b"") for i in range(max(table) + 1)]
        self.held = b""

    def feed(self, ids: np.ndarray) -> str:
        """Text that is certain once these ids are known; up to three bytes stay in the state."""
        data = self.held + b"".join(map(self.table.__getitem__, ids.tolist()))
        keep = self._unfinished(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Trailing bytes that may be the start of a character."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if back < need else 0
            if byte < 0x80:
                return 0
        return 0


@lru_cache(maxsize=2)
def _machine(source: str) -> tuple[Vocabulary, Encoder]:
    vocabulary = Vocabulary(source)
    return vocabulary, Encoder(vocabulary)


def digests(encoder: Encoder, decoder: Decoder, text: str) -> tuple[int, str, str]:
    """Number of tokens, digest of the ids, digest of the decoded text; nothing else is kept."""
    ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
    for packed in encoder.encode(text):
        ids_hash.update(packed)
        ids = np.frombuffer(packed, "<u4")
        n += len(ids)
        text_hash.update(decoder.feed(ids).encode("utf-8", "surrogatepass"))
    text_hash.update(decoder.finish().encode("utf-8", "surrogatepass"))
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def encode_texts(docs: DataFrame, vocabulary_json: str) -> DataFrame:
    """``(doc_id, ids array<int>)``: the tokens of every text."""
    source = docs.sparkSession.sparkContext.broadcast(vocabulary_json)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, encoder = _machine(source.value)
        for frame in batches(frames):
            ids = [np.frombuffer(b"".join(encoder.encode(x or "")), "<u4").astype(np.int32) for x in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "ids": ids})

    return _texts(docs).mapInPandas(run, "doc_id long, ids array<int>")


def decode_ids(tokens: DataFrame, vocabulary_json: str) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)`` rows; a null list is an empty text."""
    source = tokens.sparkSession.sparkContext.broadcast(vocabulary_json)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(_machine(source.value)[0])
        for frame in frames:
            texts = ["" if x is None else decoder.feed(np.asarray(x, np.int64)) + decoder.finish() for x in frame["ids"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "text": texts})

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInPandas(run, "doc_id long, text string")


def encode_digests(docs: DataFrame, vocabulary_json: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every text, encoded and decoded again."""
    source = docs.sparkSession.sparkContext.broadcast(vocabulary_json)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, encoder = _machine(source.value)
        decoder = Decoder(vocabulary)
        for frame in batches(frames):
            rows = [digests(encoder, decoder, x or "") for x in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "n_tokens": [r[0] for r in rows], "ids_sha256": [r[1] for r in rows], "decoded_sha256": [r[2] for r in rows]})

    return _texts(docs).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def read_vocabulary(path: str) -> str:
    """The tokenizer file's text; a fixed size, read on the driver and broadcast."""
    with open(path, encoding="utf-8") as file:
        return file.read()
