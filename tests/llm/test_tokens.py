import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from meridian.llm import packing, token_files, tokens
from meridian.llm.tokens import TextEncoder, encoder, public_path

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


def library(name, text):
    return encoder(public_path(name)).tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", [WORDS, BYTES])
def test_pieces_give_what_the_library_gives(name):
    enc, r = encoder(public_path(name)), random.Random(1)
    assert enc.kind
    parts = list(" \n\t\r\x0b\x1c\x85\u00a0\u2003ab'sT1!?中\u0301") + ["\n\n", "  ", "É", "é", "ΑΣ", "ẞ", "İ", "<|endoftext|>", "don't", "thing", " and", "\u00c5", "e\u0301"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 10)))
        assert enc.ids(text).tolist() == library(name, text), repr(text)


def test_values_round_trip():
    r = np.random.default_rng(2)
    for bits, most in ((1, 1 << 16), (2, 1 << 32)):
        for n in (0, 1, 3, 4, 7, 8, 9, 1000):
            v = (r.integers(0, most, n) >> r.integers(0, 30, n)).astype(np.uint32)
            control, data = token_files.encode_values(v, bits)
            assert (token_files.decode_values(control, data, n, bits) == v).all()
            assert len(control) == -(-n * bits // 8)


def test_common_ids_take_one_byte():
    control, data = token_files.encode_values(np.arange(256, dtype=np.uint32), 1)
    assert len(data) == 256 and set(control) == {0}


def test_block_round_trip_and_damage():
    ids_of = np.arange(100, dtype=np.uint32)[::-1].copy()
    rank = np.argsort(ids_of).astype(np.uint32)
    docs = [(None, [5, 6]), (-3, []), (4, [99, 0, 99])]
    blob = token_files.MAGIC + token_files.encode_block([d for d, _ in docs], [np.array(x, np.uint16) for _, x in docs], rank, 1)
    assert [(d, x.tolist()) for d, x in token_files.decode_blocks(memoryview(blob), ids_of)] == docs
    with pytest.raises(ValueError):
        list(token_files.decode_blocks(memoryview(blob[:-1]), ids_of))


def test_files_in_order(spark, messy, messy_rows):
    manifest, ids_of = token_files.write_files(messy, public_path(WORDS), 2, file_tokens=20_000)
    assert manifest.count() > 1
    got = sorted((x["start"], x["doc_id"], x["n_tokens"], zlib.crc32(x["ids"])) for x in token_files.read_files(manifest, ids_of).collect())
    docs = [(d, library(WORDS, t or "") + [2]) for d, t in messy_rows]
    docs.sort(key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes()))
    want, at = [], 0
    for d, ids in docs:
        want.append((at, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_a_hot_doc_id_is_dealt(spark):
    """Rows without a doc_id and rows of one doc_id, most of all, lie in several files, and none is lost."""
    texts = [f"text number {i} of many" for i in range(400)]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t) for i, t in enumerate(texts)]
    manifest, ids_of = token_files.write_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), public_path(WORDS), 2)
    parts = [(r["part"], r["n_docs"]) for r in manifest.collect()]
    assert len(parts) >= 6 and max(n for _, n in parts) < 120
    got = sorted((x["start"], x["doc_id"], x["n_tokens"], x["ids"]) for x in token_files.read_files(manifest, ids_of).collect())
    keys = [(d is not None, d or 0) for _, d, _, _ in got]
    assert keys == sorted(keys) and [a + n for a, _, n, _ in got[:-1]] == [a for a, _, _, _ in got[1:]] and got[0][0] == 0
    want = sorted((str(d), np.array(library(WORDS, t) + [2], "<u4").tobytes()) for d, t in rows)
    assert sorted((str(d), bytes(x)) for _, d, _, x in got) == want


def test_ranges_ascend_and_share_hot_keys():
    cuts = np.array([3, 5, 5, 5, 9], np.int64)
    keys = np.array([1, 3, 4, 5, 5, 5, 5, 6, 9, 10], np.int64)
    hashes = np.array([0, 0, 0, 0, 1 << 62, 1 << 63, (1 << 64) - 1, 0, 0, 0], np.uint64)
    assert token_files.range_of(keys, hashes, cuts).tolist() == [0, 0, 1, 1, 2, 3, 4, 4, 4, 5]


def test_long_pieces_are_not_kept():
    enc = TextEncoder(public_path(WORDS))
    assert enc.ids("x" * 300 + " short").tolist() == library(WORDS, "x" * 300 + " short")
    assert max(map(len, enc.pieces)) <= 64


@pytest.mark.parametrize("name", [WORDS, BYTES])
def test_a_small_cache_gives_the_same_ids(name, monkeypatch):
    """Turnover, marks that are cleared, and pieces that are met once, twice and often."""
    monkeypatch.setattr(tokens, "SEEN_MARKS", 64)
    r = random.Random(8)
    enc = TextEncoder(public_path(name), cache=40)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 9))) + r.choice(["", "", ",", ".\n", "!?"]) for _ in range(300)]
    for _ in range(60):
        text = " ".join(r.choice(words[: r.choice([10, 300])]) for _ in range(40))
        assert enc.ids(text).tolist() == library(name, text)
        assert len(enc.pieces) <= 20 and len(enc.pieces.old) <= 20 and enc.pieces.marked <= 32


def test_files_of_no_rows(empty):
    manifest, ids_of = token_files.write_files(empty, public_path(WORDS), 2)
    assert token_files.read_files(manifest, ids_of).count() == 0


def test_packing(messy, messy_rows):
    rows = packing.pack(messy, public_path(BYTES), 1, block_tokens=8192).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        assert len(r["ids"]) == 4 * r["length"] > 0
    want = defaultdict(list)
    for d, t in messy_rows:
        want[d].append(library(BYTES, t or "") + [1])
    for d, docs in want.items():
        pieces = sorted((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]) for r in by_doc[d])
        assert sum(len(p[1]) for p in pieces) == sum(map(len, docs))
        for p in pieces:
            assert any(x[p[0] : p[0] + len(p[1])] == p[1] and len(x) == p[2] for x in docs)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(by_seq) <= -(-total // 2048) + 3  # a short one for each partition


def test_packing_balances_cost():
    r = random.Random(4)
    lengths = [r.randint(1, 2048) for _ in range(300)]
    n = sum(lengths) // 2048
    placed, left = packing.assign(lengths, n, 2048)
    assert sum(p[2] for p in placed) == n * 2048 and sum(x[2] for x in left) == sum(lengths) - n * 2048
    assert len(placed) < 1.6 * len(lengths)


@pytest.mark.parametrize("seed", range(8))
def test_packing_against_brute_force(seed):
    """Each piece, longest first, goes to the cheapest sequence with room, or fills the one with the most room."""
    r = random.Random(seed)
    size, linear, quadratic = 64, 1.0, r.choice([0.0, 1 / 12288, 0.5])
    lengths = [r.choice([r.randint(1, size), 7, 64]) for _ in range(r.randint(1, 60))]
    n = max(1, sum(lengths) // size - r.choice([0, 2]))
    sequences: list[list[int]] = [[] for _ in range(n)]
    want, over = [], []

    def cost(s):
        return sum(linear * x + quadratic * x * x for x in s)

    for i in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        at = 0
        while at < lengths[i]:
            need, rooms = lengths[i] - at, [size - sum(s) for s in sequences]
            if max(rooms) == 0:
                over.append((i, at, need))
                break
            fits = [s for s in range(n) if rooms[s] >= need]
            to = min(fits, key=lambda s: (cost(sequences[s]), s)) if fits else rooms.index(max(rooms))
            take = min(need, rooms[to])
            want.append((i, at, take, to, size - rooms[to]))
            sequences[to].append(take)
            at += take
    assert packing.assign(lengths, n, size, linear, quadratic) == (want, over)


def test_packing_no_rows(empty):
    assert packing.pack(empty, public_path(BYTES)).count() == 0
