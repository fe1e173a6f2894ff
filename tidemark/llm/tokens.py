"""Token ids by the tokenizers library, with repeated segments encoded once per worker.

A text is cut at *safe boundaries*, where the ids of the whole text are the ids of the pieces side
by side; a piece that was seen before comes from a bounded table in the Python worker. Of the others,
those of letters, or of letters with ASCII signs behind and letters again, are cut at the ends of the
letters, where a pre-token ends too; new words go to the library's model many in a call, told apart by
the tokens that begin (byte-level) or end a word, and what is left to the library in batches of about
equal bytes.

Safe boundaries
  Byte-level vocabulary (``leading_space``): a single space between two characters that are not
  white space. Its pre-tokenizer lets a token start with one space, and no token goes from a
  character that is not white space into a space. The piece keeps its leading space.
  Word vocabulary: any space. Its pre-tokenizer drops white space, and no normal form joins
  characters across a space.
Special strings of a vocabulary must hold no space and take none up; both are checked.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator

import numpy as np

from .common import worker_cache

#: Pieces kept in each of a worker's two tables, the newer and the older one, and the longest piece that is kept (characters).
TABLE, LONGEST = 500_000, 64
#: Letters whose runs are one pre-token in either kind of vocabulary, normal forms included, and ASCII signs that neither join
#: them nor begin a contraction.
_LETTER, _SIGN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]", "[!-&(-@\\[-`{-~]"
#: A word, signs with at most one line end behind them, letters, a stop: pre-tokens end between them, whatever follows.
WORD, CUT = re.compile(f"[ ]?{_LETTER}+"), re.compile(f"([ ]?{_LETTER}++)({_SIGN}*+\n?)({_LETTER}*+)([.,]?)")
#: Signs that are a pre-token of their own.
STOPS = (".", ",")
#: Any string inside one that ``CUT`` takes.
WITHIN = re.compile(f"[ ]?{_LETTER}*{_SIGN}*\n?{_LETTER}*[.,]?")
#: New words in one string for the library's model.
STRING_WORDS = 300


def byte_letters() -> list[str]:
    """The letter a byte-level vocabulary writes for each byte: printable Latin-1 for itself, others from U+0100 on."""
    plain = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 for b in range(256)]
    return [chr(b) if plain[b] else chr(256 + b - sum(plain[:b])) for b in range(256)]


LETTERS = dict(enumerate(byte_letters()))
JOINT_LETTERS = {b: x for b, x in LETTERS.items() if b != 32}
#: White space, and each with a space before and behind it.
BESIDE = [(c, " " + c, c + " ") for c in map(chr, range(0x3001)) if c.isspace()]
#: Bytes of new pieces in one call of the library.
CALL_BYTES = 1 << 20
#: Characters of a text that are looked at together; a longer text is streamed in such windows.
WINDOW = 1 << 20


def pieces(text: str, leading_space: bool) -> list[str]:
    """``text`` cut at its safe boundaries, spaces kept where ``leading_space``."""
    if not leading_space:
        return text.split(" ")
    beside = any(c in text and (x in text or y in text) for c, x, y in BESIDE)
    if "\0" not in text and not beside and not (text[:1].isspace() or text[-1:].isspace()):
        return text.replace(" ", "\0 ").split("\0")  # no white space beside a space: all spaces are safe
    parts = text.split(" ")
    out = [parts[0]]
    # a boundary is safe where the characters on both sides of the space are not white space
    open_end = not parts[0] or parts[0][-1].isspace()
    for part in parts[1:]:
        if open_end or not part or part[0].isspace():
            out[-1] += " " + part
            open_end = not part or part[-1].isspace()
        else:
            out.append(" " + part)
            open_end = part[-1].isspace()
    return out


def windows(text: str, leading_space: bool, size: int = WINDOW) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut at safe boundaries only."""
    start = 0
    while len(text) - start > size:
        cut = start + size
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= len(text):
                cut = -1
                break
            if not leading_space or not (text[cut - 1].isspace() or text[cut + 1].isspace()):
                break
            cut += 1
        if cut < 0:
            break
        yield text[start:cut]
        start = cut if leading_space else cut + 1
    yield text[start:]


def byte_level(path: str) -> bool:
    """Whether the file's pre-tokenizer is the byte-level one; raises on files whose cuts aren't known to be safe."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for added in spec["added_tokens"]:
        if added["lstrip"] or added["rstrip"] or added["single_word"] or any(c.isspace() for c in added["content"]):
            raise ValueError(f"special string {added['content']!r} may reach over a boundary")
        if WITHIN.fullmatch(added["content"]):
            raise ValueError(f"special string {added['content']!r} may lie in a piece that is cut")
    first = spec["pre_tokenizer"]
    if first["type"] == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"] and spec["normalizer"] is None:
        return True
    steps = [x["type"] for x in first.get("pretokenizers", [])]
    if steps == ["Split", "ByteLevel"] and first["pretokenizers"][0]["behavior"] == "Removed":
        return False
    raise ValueError(f"no safe boundaries are known for {path}")


class Encoder:
    """Ids or lengths of whole texts. The table holds a piece's ids as bytes, or its length where ``count``."""

    def __init__(self, path: str, count: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.leading_space = byte_level(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.count = count
        self.nothing: object = 0 if count else b""
        self.table: dict[str, object] = {"": self.nothing}
        self.older: dict[str, object] = {}
        self.long: list[str] = []
        # the library's model on words that are written in its letters already
        self.words = Tokenizer(self.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        suffix = None if self.leading_space else self.model.end_of_word_suffix
        self.marks = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.marks[[i for x, i in vocab.items() if (x.startswith(LETTERS[32]) if suffix is None else x.endswith(suffix))]] = True
        self.marked = self.leading_space or bool(suffix)

    def _keep(self, ids: list[int]) -> object:
        return len(ids) if self.count else np.array(ids, self.kind).tobytes()

    def _word(self, piece: str) -> object:
        """A piece of letters is one pre-token: the library's model takes it as it is."""
        piece = piece if self.leading_space else piece.lower()
        return self._keep([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(LETTERS))])

    def _learn_words(self, words: list[str]) -> None:
        """Puts new words into the table, many in a call; those that can't be told apart by their tokens go one by one."""
        alone = words if not self.marked else [x for x in words if x[0] != " "] if self.leading_space else []
        joint = [x for x in words if x[0] == " "] if self.leading_space else words if self.marked else []
        table = self.table
        for x in alone:
            table[x] = self._word(x)
        groups = [joint[i : i + STRING_WORDS] for i in range(0, len(joint), STRING_WORDS)]
        strings = []
        for group in groups:
            string = "".join(group)[1:] if self.leading_space else " ".join(group).lower()
            if not string.isascii():
                string = string.encode().decode("latin-1").translate(JOINT_LETTERS)
            strings.append(LETTERS[32] + string.replace(" ", " " + LETTERS[32]) if self.leading_space else string)
        for group, encoded in zip(groups, self.words.encode_batch_fast(strings, add_special_tokens=False) if strings else (), strict=True):
            ids = np.array(encoded.ids, dtype=np.int64)
            at = np.flatnonzero(self.marks[ids])
            edges = np.append(at, len(ids)) if self.leading_space else np.append(0, at + 1)
            if len(edges) != len(group) + 1 or edges[0] != 0 or edges[-1] != len(ids):
                table.update((x, self._word(x)) for x in group)
            elif self.count:
                table.update(zip(group, np.diff(edges).tolist(), strict=True))
            else:
                packed = ids.astype(self.kind)
                data, ends = packed.tobytes(), (edges * packed.itemsize).tolist()
                table.update((x, data[a:b]) for x, a, b in zip(group, ends, ends[1:], strict=False))

    def learn(self, wanted: set[str]) -> dict[str, object]:
        """The table, with every piece of ``wanted`` in it until the next call."""
        if len(self.table) > TABLE:
            self.table, self.older = {"": self.nothing}, self.table
        table, older = self.table, self.older

        def fresh(found: set[str]) -> set[str]:
            """What neither table holds; what the older one holds moves to the newer one."""
            found = found.difference(table)
            known = older.keys() & found
            table.update((x, older[x]) for x in known)
            return found - known

        new = list(fresh(wanted))
        cuts = list(map(CUT.fullmatch, new))
        made = [cut.groups() for cut in cuts if cut is not None]
        words = fresh({x[0] for x in made}.union([x[2] for x in made]))
        rest = fresh({x[1] for x in made}.union([x[3] for x in made])).union([x for x, cut in zip(new, cuts, strict=True) if cut is None])
        self._learn_words(list(words))
        rest = sorted(rest, key=len)
        start, total = 0, 0
        for i, piece in enumerate(rest):
            total += len(piece)
            if total > CALL_BYTES or i + 1 == len(rest):
                call = rest[start : i + 1]
                for x, e in zip(call, self.tokenizer.encode_batch_fast(call, add_special_tokens=False), strict=True):
                    table[x] = len(e) if self.count else self._keep(e.ids)
                start, total = i + 1, 0
        table.update((a + b + c + d, table[a] + table[b] + table[c] + table[d]) for a, b, c, d in made if b)
        long = [x for x in new if len(x) > LONGEST]
        self.long = long + [x for piece in long if (cut := CUT.fullmatch(piece)) for x in cut.groups() if len(x) > LONGEST]
        return table

    def find(self, cut: list[list[str]]) -> list[list]:
        """What the table holds of all pieces; new ones are learnt first."""
        collects = gc.isenabled()
        gc.disable()  # no cycles here, and collections set off by so many short-lived tuples walk over all lists of pieces
        try:
            get = self.table.get
            found = [list(map(get, ps)) for ps in cut]
            gaps = [[k for k, x in enumerate(f) if x is None] for f in found]
            table = self.learn({ps[k] for ps, g in zip(cut, gaps, strict=True) for k in g})
            for ps, f, g in zip(cut, found, gaps, strict=True):
                for k in g:
                    f[k] = table[ps[k]]
            self.forget()
            return found
        finally:
            if collects:
                gc.enable()

    def forget(self) -> None:
        """Drops the long pieces, which seldom come again."""
        for x in self.long:
            self.table.pop(x, None)


def encoder(path: str, count: bool = False) -> Encoder:
    """The worker's encoder for ``path``."""
    return worker_cache(f"encoder {count} {path}", lambda: Encoder(path, count))


def counts(enc: Encoder, texts: list[str]) -> list[int]:
    """Tokens of each text."""
    out = [0] * len(texts)
    for group in _groups(enc, texts):
        for (i, _), found in zip(group, enc.find([pieces(x, enc.leading_space) for _, x in group]), strict=True):
            out[i] += sum(found)
    return out


def ids(enc: Encoder, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, ids) in order; a long text comes in several parts, every text at least once."""
    for group in _groups(enc, texts):
        for (i, _), found in zip(group, enc.find([pieces(x, enc.leading_space) for _, x in group]), strict=True):
            yield i, np.frombuffer(b"".join(found), dtype=enc.kind).astype(np.uint32)


def _groups(enc: Encoder, texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """The texts' windows, together about ``WINDOW`` characters a group."""
    group, total = [], 0
    for i, text in enumerate(texts):
        for window in windows(text or "", enc.leading_space):
            group.append((i, window))
            total += len(window)
            if total >= WINDOW:
                yield group
                group, total = [], 0
    if group:
        yield group
