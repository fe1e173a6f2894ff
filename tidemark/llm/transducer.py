"""Byte-pair encoding as a streaming transducer, and decoding as a state machine.

Encoding reads a text piece by piece and emits a token as soon as no later byte can change it.

* Pre-tokens are found with a window of text that ends at a safe boundary (``tokens.windows``); in a
  piece without one they are found and encoded one after the other.
* A token sequence is an encoding if and only if each neighbouring pair is one (``fits``), so the last
  token of the encoding of every prefix follows from the last tokens of shorter prefixes alone. A
  later prefix ends in a token of at most ``lookahead`` bytes, the longest product of the merge list;
  tokens on which the chains from the last ``lookahead`` prefixes agree are stable and leave the
  state. The state is the bytes and last tokens of the prefixes they don't agree on yet.
* Every pre-token, short or long, goes this way. Those seen before come from bounded tables.

Decoding maps ids to bytes and bytes to text with an incremental UTF-8 machine: an incomplete
character waits for the next id, a broken one becomes U+FFFD.

Defined results: a null text is empty (0 tokens, the digests of nothing). A null ``doc_id`` stays
null, repeated rows are encoded one by one, no rows give no rows; other columns play no part.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import tokens
from .common import by_bytes, documents, read, worker_cache
from .registry import query

#: Entries of a worker's tables (each is kept twice, a newer and an older one) and characters of the longest piece kept.
PAIRS, PRETOKENS, SEGMENTS, LONGEST = 1 << 19, 200_000, 400_000, 64
#: Ids that a piece without a safe boundary gives at a time.
PART = 1 << 16
#: The pre-token pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Transducer:
    """The vocabulary of one file, its encoder and its decoder."""

    def __init__(self, path: str):
        import regex

        if not tokens.byte_level(path):
            raise ValueError(f"{path} has no byte-level vocabulary")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in enumerate(tokens.byte_letters())}
        vocabulary = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.byte_ids = [self.id_of[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}  # pair: rank, product
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocabulary[a], vocabulary[b]] = rank, vocabulary[a + b]
        self.rank = dict.fromkeys(self.byte_ids, -1) | {product: rank for rank, product in self.merges.values()}
        self.parts = {product: pair for pair, (_, product) in self.merges.items()}
        #: Whether every product comes from one pair only, and after both of its parts.
        self.ordered = len(self.parts) == len(self.merges) and all(max(self.rank[a], self.rank[b]) < rank for (a, b), (rank, _) in self.merges.items())
        #: No token is longer, so no byte further on can change a token that ends here.
        self.lookahead = max(len(self.bytes_of[i]) for i in self.rank)
        #: Tokens by their bytes; the mere ends of tokens are -1.
        self.ends: dict[bytes, int] = {}
        for i in sorted(self.rank, key=lambda i: len(self.bytes_of[i])):
            data = self.bytes_of[i]
            for n in range(1, len(data)):
                if data[n:] in self.ends:
                    break
                self.ends[data[n:]] = -1
            self.ends[data] = i
        self.whole: dict[int, bool] = {}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text_of = self.bytes_of | {i: s.encode() for s, i in self.special.items()}
        self.decimals = {i: str(i) for i in self.text_of}
        self.kind = "<u2" if max(self.text_of) < 1 << 16 else "<u4"
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        #: Whether no special string can lie in a piece of letters.
        self.letters = not any(tokens.WORD.fullmatch(x) for x in self.special)
        self.pairs: dict[int, bool] = {}
        self.pretokens: list[dict[str, bytes]] = [{}, {}]
        self.segments: list[dict[str, bytes]] = [{}, {}]

    def merge(self, data: bytes) -> list[int]:
        """The encoding of a short piece: the pair of least rank first, the leftmost of equal ones."""
        ids = [self.byte_ids[b] for b in data]
        merges = self.merges
        while len(ids) > 1:
            found = [(m[0], i, m[1]) for i, pair in enumerate(zip(ids, ids[1:])) if (m := merges.get(pair))]
            if not found:
                break
            _, at, product = min(found)
            ids[at : at + 2] = [product]
        return ids

    def apart(self, a: int, b: int) -> bool:
        """``fits`` by undoing the merges at the end of ``a`` and the beginning of ``b``, the latest first.

        The two stay apart if the pieces that meet at the boundary never have a merge that comes before the
        next one of either. Of merges of one rank the left one comes first.
        """
        merges, rank, parts = self.merges, self.rank, self.parts
        limit = len(merges)
        while True:
            found = merges.get((a, b))
            if found is not None and found[0] < limit:
                return False
            of_a, of_b = rank[a], rank[b]
            if of_a > of_b:
                limit, a = of_a, parts[a][1]
            elif of_b >= 0:
                limit, b = of_b + 1, parts[b][0]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` is the encoding of their bytes, both being encodings of theirs."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.apart(a, b) if self.ordered else self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            self.pairs[key] = known
        return known

    def is_whole(self, token: int) -> bool:
        """Whether the bytes of ``token`` are encoded as itself."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def last_token(self, held: bytes, end: int, last: dict[int, int]) -> int:
        """The last token of the encoding up to byte ``end`` of ``held``; ``last`` gets it and those it follows from."""
        ends, pairs = self.ends, self.pairs
        found = []
        for start in range(end - 1, -1, -1):
            token = ends.get(held[start:end])
            if token is None:
                break
            if token >= 0:
                found.append((start, token))
        for start, token in reversed(found):  # exactly one is right, mostly a long one
            before = last.get(start)
            if before is None:
                before = self.last_token(held, start, last)
            if before >= 0:
                fit = pairs.get(before << 32 | token)
                if not (self.fits(before, token) if fit is None else fit):
                    continue
            if self.whole.get(token) or self.is_whole(token):
                last[end] = token
                return token
        raise AssertionError("every prefix has an encoding")

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of a piece of any length, given as bytes, each as soon as it is stable."""
        k = self.lookahead
        source = iter(data)
        held = b""  # bytes behind the last stable token
        last = {0: -1}  # place in them: last token of the encoding up to there; the stable one, or -1, is at 0
        while len(more := bytes(islice(source, k))) == k:
            held += more
            # a token that ends further on starts less than ``k`` bytes before this end: what all chains from there share is stable
            common: list[int] | None = None
            for at in range(max(0, len(held) - k + 1), len(held) + 1):
                chain = []
                while at > 0:
                    chain.append(at)
                    token = last.get(at)
                    at -= len(self.bytes_of[self.last_token(held, at, last) if token is None else token])
                chain.reverse()
                common = chain if common is None else [p for p, q in zip(common, chain) if p == q]
                if not common:
                    break
            if common:
                yield from [last[x] for x in common]
                stable = common[-1]
                held, last = held[stable:], {x - stable: t for x, t in last.items() if x >= stable}
        held += more
        out, at = [], len(held)
        while at > 0:
            token = last.get(at)
            if token is None:
                token = self.last_token(held, at, last)
            out.append(token)
            at -= len(self.bytes_of[token])
        out.reverse()
        yield from out

    def piece(self, pretoken: str) -> bytes:
        """The ids of a pre-token as an array's bytes."""
        newer, older = self.pretokens
        found = newer.get(pretoken)
        if found is None:
            found = older.get(pretoken)
            if found is None:
                found = np.array([*self.stream(pretoken.encode())], self.kind).tobytes()
            if len(pretoken) <= LONGEST:
                if len(newer) >= PRETOKENS:
                    newer, older = {}, newer
                    self.pretokens = [newer, older]
                newer[pretoken] = found
        return found

    def parts_of(self, text: str) -> Iterator[str | int]:
        """The pre-tokens of a piece, and the ids of special strings, in order."""
        at = 0
        for match in self.split.finditer(text) if self.split else ():
            yield from self.found(text[at : match.start()])
            yield self.special[match.group()]
            at = match.end()
        yield from self.found(text[at:] if at else text)

    def found(self, text: str) -> Iterator[str]:
        for match in self.pattern.finditer(text):
            yield match.group()

    def segment(self, text: str) -> bytes:
        """The ids of a piece between safe boundaries, special strings included, as an array's bytes."""
        if self.letters:
            if tokens.WORD.fullmatch(text):
                return self.piece(text)
            if text[-1:] in tokens.STOPS and tokens.WORD.fullmatch(text, 0, len(text) - 1):
                return self.piece(text[:-1]) + self.piece(text[-1])
        return b"".join([self.piece(x) if isinstance(x, str) else np.array([x], self.kind).tobytes() for x in self.parts_of(text)])

    def long(self, text: str) -> Iterator[list[int]]:
        """The ids of a piece of any length, ``PART`` at a time: state doesn't grow with the piece."""
        out: list[int] = []
        for x in self.parts_of(text):
            for token in (x,) if isinstance(x, int) else self.stream(x.encode()):
                out.append(token)
                if len(out) >= PART:
                    yield out
                    out = []
        yield out

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids of ``text`` in parts, at least one."""
        for window in tokens.windows(text, True, 1 << 18):
            if len(window) > 1 << 19:  # hardly a safe boundary in it
                for x in tokens.pieces(window, True):
                    yield from self.long(x)
                continue
            pieces = tokens.pieces(window, True)
            newer, older = self.segments
            if len(newer) >= SEGMENTS:
                self.segments = [newer, older] = [{}, newer]
            seldom = []
            for x in set(pieces).difference(newer):
                known = older.get(x)
                newer[x] = self.segment(x) if known is None else known
                if len(x) > LONGEST:
                    seldom.append(x)
            ids = b"".join(itemgetter(*pieces)(newer)) if len(pieces) > 1 else newer[pieces[0]]
            for x in seldom:
                del newer[x]
            yield np.frombuffer(ids, self.kind).tolist()

    def decode(self, parts: Iterable[list[int]]) -> Iterator[str]:
        """The text of ids that come in parts."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in parts:
            yield machine.decode(b"".join(map(self.text_of.__getitem__, ids)))
        yield machine.decode(b"", final=True)


def transducer(path: str) -> Transducer:
    return worker_cache(f"transducer {path}", lambda: Transducer(path))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas), ``decoded_sha256`` of each row."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in by_bytes(batches, "text"):
            out: list[list] = [[], [], []]
            for text in batch.column("text").to_pylist():
                n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()

                def watched(text: str = text, of_ids=of_ids) -> Iterator[list[int]]:
                    nonlocal n
                    for ids in machine.encode(text):
                        if ids:
                            of_ids.update(("," * bool(n) + ",".join(map(machine.decimals.__getitem__, ids))).encode())
                            n += len(ids)
                        yield ids

                for part in machine.decode(watched()):
                    of_text.update(part.encode())
                for column, value in zip(out, (n, of_ids.hexdigest(), of_text.hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return documents(docs).mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and the ``ids`` of each row's text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in by_bytes(batches, "text"):
            ids = [np.concatenate([np.array(x, np.int64) for x in machine.encode(t)]) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return documents(docs).mapInArrow(encode, "doc_id long, ids array<long>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and the ``text`` that the ``ids`` of each row stand for."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            texts = ["".join(machine.decode([x or []])) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


@query("op7_bpe_transducer")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
