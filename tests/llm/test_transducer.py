"""The streaming encoder and decoder against the library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from test_tokens import ODD, ROWS, frame, mixed
from tidemark.llm import transducer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def machine():
    return transducer.Transducer(PATH)


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def test_texts(machine, whole):
    for text in ODD + mixed(500, 5) + ["z" * 5000, "ab" * 3000]:
        want = whole.encode(text, add_special_tokens=False).ids
        got = [x for part in machine.encode(text) for x in part]
        assert got == want
        assert "".join(machine.decode([x] for x in want)) == whole.decode(want, skip_special_tokens=False)


def test_streaming_equals_merging_and_keeps_little(machine):
    rng = random.Random(3)
    for alphabet in ("ab", "thenia", "aeiouäß", " -=_*", "01"):
        for n in (1, 2, 63, 200, 700):
            data = "".join(rng.choice(alphabet) for _ in range(n)).encode()
            assert list(machine.stream(data)) == machine.merge(data)
    read = 0

    def endless():
        nonlocal read
        while True:
            read += 1
            yield b"sentences"[read % 9]

    found, out = machine.stream(endless()), 0
    for _ in range(500):
        out += len(machine.bytes_of[next(found)])
    assert read - out <= 4 * machine.lookahead  # tokens come while the input goes on


def test_pairs_that_stay_apart(machine):
    assert machine.ordered
    rng = random.Random(6)
    ids = sorted(machine.rank)
    near = [machine.parts[x] for x in rng.sample(sorted(machine.parts), 1000)]  # pairs that merge, and parts of tokens beside them
    pairs = near + [(a, machine.parts.get(b, (b,))[0]) for a, b in near] + [(rng.choice(ids), rng.choice(ids)) for _ in range(1000)]
    for a, b in pairs:
        assert machine.apart(a, b) == (machine.merge(machine.bytes_of[a] + machine.bytes_of[b]) == [a, b])


def test_every_pretoken_goes_through_the_transducer(whole, monkeypatch):
    own = transducer.Transducer(PATH)
    seen = []
    plain = own.stream
    monkeypatch.setattr(own, "stream", lambda data: seen.append(bytes(data)) or plain(data))
    text = "the quick browner fox's 12 words, thenianess " + "x" * 300
    got = [x for part in own.encode(text) for x in part]
    assert got == whole.encode(text, add_special_tokens=False).ids
    assert {*seen} == {x.encode() for x in own.pattern.findall(text)}


def test_small_tables_and_pieces_without_boundary(whole, monkeypatch):
    for name, value in (("PAIRS", 3), ("PRETOKENS", 2), ("SEGMENTS", 2), ("PART", 5)):
        monkeypatch.setattr(transducer, name, value)
    own = transducer.Transducer(PATH)
    for text in mixed(60, 8):
        assert [x for part in own.encode(text) for x in part] == whole.encode(text, add_special_tokens=False).ids
        parts = [*own.long(text)]
        assert [x for part in parts for x in part] == whole.encode(text, add_special_tokens=False).ids and max(map(len, parts)) <= 5
    text = "ab1," * 150_000
    assert [x for part in own.encode(text) for x in part] == whole.encode(text, add_special_tokens=False).ids


def test_broken_bytes_decode_as_the_library_does(machine, whole):
    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.choice(machine.byte_ids) for _ in range(rng.randrange(1, 12))]
        assert "".join(machine.decode([x] for x in ids)) == whole.decode(ids, skip_special_tokens=False)


def test_rows(spark, whole):
    got = sorted(map(tuple, transducer.round_trip(frame(spark, ROWS), PATH).collect()), key=str)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, x in ROWS:
        ids = whole.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(whole.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    assert transducer.round_trip(frame(spark, []), PATH).collect() == []
    back = transducer.decoded(transducer.encoded(frame(spark, ROWS), PATH), PATH).collect()
    assert sorted((r.doc_id, r.text) for r in back if r.doc_id) == sorted((i, x or "") for i, x in ROWS if i)
