"""Token counts, token files and their pieces against the library on whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import binary, counting, tokens

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = [
    "", " ", "  ", "\n", "a  b", " a", "a ", "a\n b", "a \n b", "it's  the\tend. ", "x<|endoftext|>y <|endoftext|> z", "é ́a", "naïve  Straße  ΑΣ ΑΣ. İ",
    "1 234  5", "Word. Wörter, ÀÉ. x., a.. ß. ×. ÷ ª. b.c, .", ". , .", "  a b", "日本 語 テスト", "a\x1c b\x85 c", "'s 's't  're", "..  ..\r\n ..", "word " * 50, "z" * 300, "\x00 \x00",
]


def mixed(n, seed=1):
    rng = random.Random(seed)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "1", "23", ".", "'s", "ß", "́", "日", " ", "<|endoftext|>", "<|", "|>", "\U0001f600", "\x1d"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("file", FILES)
@pytest.mark.parametrize("window", [1, 7, 1 << 20])
def test_pieces_give_the_ids_of_the_whole_text(file, window, monkeypatch):
    path = public_tokenizers.path(file)
    monkeypatch.setattr(tokens.windows, "__defaults__", (window,))
    whole = Tokenizer.from_file(path)
    enc = tokens.Encoder(path)
    texts = ODD + mixed(400)
    want = [whole.encode(x, add_special_tokens=False).ids for x in texts]
    got = [[] for _ in texts]
    for i, part in tokens.ids(enc, texts):
        got[i] += part.tolist()
    assert got == want
    assert tokens.counts(tokens.Encoder(path, count=True), texts) == [len(x) for x in want]


def test_a_full_table_changes_nothing(monkeypatch):
    path = public_tokenizers.path(FILES[0])
    monkeypatch.setattr(tokens, "TABLE", 3)
    whole = Tokenizer.from_file(path)
    texts = mixed(50, 2)
    assert tokens.counts(tokens.Encoder(path, count=True), texts) == [len(whole.encode(x, add_special_tokens=False)) for x in texts]


@pytest.mark.parametrize("file", FILES)
def test_words_behind_signs_are_cut_off_and_go_to_the_model_many_in_a_call(file):
    path = public_tokenizers.path(file)
    whole, enc = Tokenizer.from_file(path), tokens.Encoder(path)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcehnorstéüßÉ") for _ in range(rng.randrange(1, 9)))
    signs = ["", ".", ",", "!!", "$$$", ".\n", "\n", "12", "-", "(", "|>", ".\n\n", "'", "'s", ";\t", "٣", "<|"]
    texts = [" ".join(word() + rng.choice(signs) + rng.choice(["", word(), "THE", "s,", "x."]) for _ in range(50)) for _ in range(60)]
    assert [x.tolist() for _, x in tokens.ids(enc, texts)] == [whole.encode(x, add_special_tokens=False).ids for x in texts]

    class Seen:
        def __init__(self, inner):
            self.inner, self.calls = inner, []

        def encode_batch_fast(self, call, **more):
            self.calls.append(list(call))
            return self.inner.encode_batch_fast(call, **more)

    enc = tokens.Encoder(path)
    enc.tokenizer, enc.words = Seen(enc.tokenizer), Seen(enc.words)
    text = " ".join(f"{word()}thn{rng.choice(['', '.', '###', '.' + chr(10) + 'Then'])}" for _ in range(500))
    (_, got), = tokens.ids(enc, [text])
    assert got.tolist() == whole.encode(text, add_special_tokens=False).ids
    assert {x for call in enc.tokenizer.calls for x in call} <= {".", "###", ".\n"}
    assert len(enc.words.calls) == 1 and len(enc.words.calls[0]) <= 2


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 7, "s") for i, x in rows], "doc_id long, text string, n_tokens int, start string")


ROWS = [(5, "a b"), (5, "a b"), (2, None), (None, "null id"), (9, ""), (7, "long word " * 3000), (1, ODD[10])]


def test_counts_of_odd_rows(spark):
    path = public_tokenizers.path(FILES[0])
    whole = Tokenizer.from_file(path)
    got = sorted(map(tuple, counting.token_counts(frame(spark, ROWS), path, limit=10).collect()), key=str)
    want = [(i, len((x or "").encode()), n := len(whole.encode(x or "", add_special_tokens=False)), n > 10) for i, x in ROWS]
    assert got == sorted(want, key=str)
    assert counting.token_counts(frame(spark, []), path).collect() == []


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_files_give_back_every_id(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(binary, "BLOCK_BYTES", block)
    path = public_tokenizers.path(FILES[1])
    whole = Tokenizer.from_file(path)
    folder = str(tmp_path / "set")
    binary.write(frame(spark, ROWS + [(100 + i, x) for i, x in enumerate(mixed(300, 3))]), folder, path, 1)
    rows = sorted(binary.read_back(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x))
    texts = {}
    for i, x in ROWS + [(100 + i, x) for i, x in enumerate(mixed(300, 3))]:
        texts.setdefault(i, []).append(whole.encode(x or "", add_special_tokens=False).ids + [1])
    at = 0
    for r in rows:
        assert r.ids in texts[r.doc_id] and r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert len(rows) == 307
    one = binary.read_back(spark, folder, only=7).collect()
    assert [r.ids for r in one] == texts[7]


def test_no_documents_give_an_empty_set(spark, tmp_path):
    binary.write(frame(spark, []), str(tmp_path / "none"), public_tokenizers.path(FILES[1]), 1)
    assert binary.read_back(spark, str(tmp_path / "none")).collect() == []
