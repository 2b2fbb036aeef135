import zlib

import numpy as np
import pytest
from tests.llm.cases import awkward, frame
from tokenizers import Tokenizer

from tideline.llm import packing, queries
from tideline.llm.queries import token_files

HARD = ["a  b", " lead", "trail ", "a\n b", "a \n\n b\t c", "it's  'll x", "<|endoftext|> a b", "é ü  x y z", "\x1c a \x85 b",
        "12 345,678 !!! ... ###x", "a" * 300 + " b", "🙂 👍🏽 x", "", " ", "  "]


@pytest.mark.parametrize("ranks", [True, False])
def test_ids_equal_the_tokenizers(ranks):
    files = token_files()
    full = Tokenizer.from_file(files["vocab"])
    ours = packing.TokenIds(files["vocab"], files["ranks"] if ranks else None, memo_limit=50)
    for text in HARD + [r[1] or "" for r in awkward()]:
        assert np.frombuffer(ours.ids(text), "<u4").tolist() == full.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("clashes", [False, True])
def test_pieces_hold_every_id_once_without_padding(spark, clashes):
    rows = awkward()
    full = Tokenizer.from_file(token_files()["vocab"])
    got = packing.pack(frame(spark, rows, clashes).coalesce(2), **token_files(), max_segments=8).collect()
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(full.encode(r[1] or "", add_special_tokens=False).ids + [1])
    for doc_id, texts in want.items():
        pieces = [p for p in got if p["doc_id"] == doc_id]
        ids = np.array(texts[0], dtype="<u4")
        assert sum(p["length"] for p in pieces) == len(ids) * len(texts)
        covered = np.zeros(len(ids), dtype=int)
        for p in pieces:
            covered[p["start"]:p["start"] + p["length"]] += 1
            assert p["doc_tokens"] == len(ids) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"]:p["start"] + p["length"]].tobytes())
        assert (covered == len(texts)).all()
    by_sequence = {}
    for p in got:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and at & (at - 1) == 0 and len(pieces) <= 8
        assert all(p["sequence_length"] == at for p in pieces)


def test_dot_product_bins_respect_every_limit():
    rng = np.random.default_rng(4)
    items = [(int(t), int(s), int(x)) for t, s, x in zip(rng.integers(1, 900, 300), rng.integers(1, 7, 300), rng.integers(0, 500, 300))]
    limits = (2048, 16, 1024)
    bins = packing.dot_product_bins(items, limits)
    assert sorted(k for b in bins for k, _, _ in b) == list(range(300))
    for b in bins:
        assert all(sum(items[k][d] for k, _, _ in b) <= limits[d] for d in range(3))
    least = max(-(-sum(i[d] for i in items) // limits[d]) for d in range(3))
    assert len(bins) <= 1.25 * least
    with pytest.raises(ValueError):
        packing.dot_product_bins([(5000, 1, 1)], limits)


def test_conversations_are_never_cut(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(1, 900)), int(rng.integers(1, 6)), int(rng.integers(0, 300))) for i in range(400)]
    rows += [(900, 5000, 1, 1), (901, None, 1, 1)]
    got = packing.pack_conversations(spark.createDataFrame(rows, "item_id long, tokens long, segments long, loss_tokens long"), group=64)
    placed = {r[0]: r[1] for r in got.collect()}
    assert len(placed) == len(rows) and placed[900] is None and placed[901] is None
    load = {}
    for i, *v in rows[:400]:
        load[placed[i]] = load.get(placed[i], np.zeros(3)) + v
    assert all((v <= (2048, 16, 1024)).all() for v in load.values())


def test_empty_table(spark):
    assert packing.pack(frame(spark, []), **token_files()).count() == 0


def test_conversation_query_matches_a_plain_count(spark, tmp_path):
    rng = np.random.default_rng(6)
    turns = []
    for c in range(120):
        for t in range(6 if c % 3 == 0 else 2):
            text = "word " * int(rng.integers(0, 8 if c % 3 == 0 else 400 if (c + t) % 2 else 700))
            turns.append((c, t, "assistant" if t % 2 else "user", text if rng.random() < 0.9 else None))
    turns += [(None, 0, "user", "lost"), (500, 0, "assistant", "word " * 5000), (501, 0, None, "x"), turns[0]]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    full = Tokenizer.from_file(token_files()["vocab"])
    want = {}
    for c, _, role, text in turns:
        if c is not None:
            n = len(full.encode(text or "", add_special_tokens=False).ids) + 1
            want[c] = want.get(c, np.zeros(3, dtype=int)) + (n, 1, n * (role == "assistant"))
    got = queries.packing_conversations(spark, str(tmp_path)).collect()
    assert {r["item_id"]: (r["tokens"], r["segments"], r["loss_tokens"]) for r in got} == {c: tuple(v) for c, v in want.items()}
    bins = {}
    for r in got:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(want[r["item_id"]])
    loads = np.array([sum(v) for v in bins.values()])
    assert (loads <= (2048, 16, 1024)).all() and [r["item_id"] for r in got if r["bin_id"] is None] == [500]
    assert all((loads[:, i] >= 0.85 * limit).any() for i, limit in enumerate((2048, 16, 1024))), loads.max(axis=0)  # each limit binds somewhere
