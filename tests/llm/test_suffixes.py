import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.cases import awkward, frame, words

from tideline.llm import suffixes


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(seq):
    assert suffixes.suffix_array(seq) == sorted(range(len(seq)), key=lambda i: seq[i:])


@pytest.mark.parametrize("seq", [[0] * 50, list(range(50)), list(range(50, 0, -1)), [1, 2] * 40, [2, 1] * 40, [1, 1, 2] * 30])
def test_suffix_array_of_regular_sequences(seq):
    assert suffixes.suffix_array(seq) == sorted(range(len(seq)), key=lambda i: seq[i:])


def plain(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def shared_passages(seed):
    rng = random.Random(seed)
    passages = [words(rng, n) for n in (10, 20, 24, 30, 60, 150)]
    rows = []
    for i in range(70):
        parts = [words(rng, rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 40)
            parts += [p[cut:] if rng.random() < 0.5 else p, words(rng, rng.randrange(1, 30))]
        rows.append((100 + i, " ".join(parts), "en", "s", 1))
    near = words(rng, 200)
    for i in range(40):
        w = near.split()
        w[rng.randrange(200)] = f"edit{i % 5}"
        rows.append((300 + i, " ".join(w), "en", "s", 1))
    rows += [(400, "ab" * 700, None, None, None), (401, "ab" * 300 + "é", None, None, None), (402, ("line of text\n" * 90), None, None, None)]
    return rows


@pytest.mark.parametrize(("length", "seed", "clashes"), [(400, 1, True), (64, 2, False), (160, 3, False)])
def test_removed_bytes_match_brute_force(spark, length, seed, clashes):
    rows = [r if r[0] != 50 else (50, r[1][:9000], *r[2:]) for r in awkward()] + shared_passages(seed)
    got = suffixes.remove_repeats(frame(spark, rows, clashes), length).collect()
    want = plain([r[1] for r in rows], length)
    ours = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
    assert ours == sorted((str(r[0]), *w) for r, w in zip(rows, want))


def test_empty_table(spark):
    assert suffixes.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("chunk", [7, 500, 4096])
def test_chunks_do_not_change_anchors(monkeypatch, chunk):
    raw = random.Random(chunk).randbytes(9000)
    whole = [x.tolist() for x in suffixes.anchors(raw, 400)]
    monkeypatch.setattr(suffixes, "_CHUNK", chunk)
    assert [x.tolist() for x in suffixes.anchors(raw, 400)] == whole


def test_anchors_of_unique_text_stay_unique_across_chunks(monkeypatch):
    monkeypatch.setattr(suffixes, "_CHUNK", 500)
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(9000))
    hashes = suffixes.anchors(text.encode(), 400)[3].tolist()
    assert len(set(hashes)) == len(hashes)


@pytest.mark.parametrize("seed", range(30))
def test_windows_of_groups_match_brute_force(seed):
    """Pieces of one anchor, some windows of which have too few owners at some offsets."""
    rng = random.Random(seed)
    length = 64
    pieces = []
    for _ in range(rng.randrange(1, 9)):
        raw = bytearray(rng.choice((b"ab", b"abc")) * 50)
        for _ in range(rng.randrange(3)):
            raw[rng.randrange(len(raw))] = 120
        first = rng.randrange(0, 20)
        pieces.append((bytes(raw), 32, first, rng.randrange(first, 33)))
    seen, aligned = {}, {}
    for k, (raw, _, first, last) in enumerate(pieces):
        for i in range(first, last + 1):
            seen.setdefault(raw[i:i + length], []).append((k, i))
            aligned.setdefault((i, raw[i:i + length]), []).append((k, i))
    twice = lambda found: {x for where in found.values() if len(where) > 1 for x in where}
    got = {(k, i) for k, a, b in zip(*(x.tolist() for x in suffixes.repeated_windows(pieces, length))) for i in range(a, b + 1)}
    # anchors of equal windows are equally far off, so that nothing else is needed
    assert twice(aligned) <= got <= twice(seen)
