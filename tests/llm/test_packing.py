"""Sequences hold every id once, without gaps, and little padding."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from test_tokens import ODD, ROWS, frame, mixed
from tidemark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_level(counts, size, length):
    """The level with the least sum of squares after placing; of equal ones the fullest."""
    best = None
    for h in range(length - size + 1):
        if h and not counts[h]:
            continue
        after = counts.copy()
        if h:
            after[h] -= 1
        if h + size < length:
            after[h + size] += 1
        key = (int((after[1:length] ** 2).sum()), -h)
        best = min(best or (key, h), (key, h))
    return best[1]


@pytest.mark.parametrize("length", [8, 64])
def test_each_piece_goes_where_the_sum_of_squares_is_least(length):
    rng = np.random.default_rng(1)
    packer = packing.Packer(length)
    for n in range(800):
        size = int(rng.integers(1, length + 1))
        before = packer.counts.copy()
        packer.place((n, 0, np.zeros(size, np.uint32), n))
        if size < length:
            level = brute_level(before, size, length)
            if level:
                before[level] -= 1
            if level + size < length:
                before[level + size] += 1
        assert (packer.counts == before).all()


def verify(rows, texts, length):
    whole = Tokenizer.from_file(PATH)
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.length == len(r.ids) > 0
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    padding = 0
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    wanted = defaultdict(list)
    for i, x in texts:
        wanted[i].append(whole.encode(x or "", add_special_tokens=False).ids + [0])
    assert set(by_doc) == set(wanted)
    for i, expected in wanted.items():
        if len(expected) == 1:
            found = sorted(by_doc[i], key=lambda r: r.start)
            assert [x for r in found for x in r.ids] == expected[0]
            assert [r.start for r in found] == np.concatenate([[0], np.cumsum([r.length for r in found])[:-1]]).tolist()
            assert {r.doc_tokens for r in found} == {len(expected[0])}
        else:
            assert sum(r.length for r in by_doc[i]) == sum(map(len, expected))
    return padding


@pytest.mark.parametrize("length, most_open", [(16, 4096), (1024, 4096), (16, 2)])
def test_packed(spark, length, most_open, monkeypatch):
    monkeypatch.setattr(packing.Packer.__init__, "__defaults__", (length, most_open))
    texts = ROWS + [(100 + i, x) for i, x in enumerate(ODD + mixed(300, 6))]
    rows = packing.packed(frame(spark, texts).repartition(3), PATH, length=length).collect()
    assert verify(rows, texts, length) == 0


def test_nothing_to_pack(spark):
    assert packing.packed(frame(spark, []), PATH).collect() == []
