"""Very long texts: a few MB in one row, whole."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tests.llm.cases import frame
from tests.llm.test_simhash import plain_fingerprint
from tokenizers import Tokenizer

from tideline.llm import media, nearcopies, packing, secrets, simhash, suffixes
from tideline.llm.queries import token_files


def unique(rng, n):
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=n))


@pytest.fixture(scope="module")
def long():
    rng = random.Random(4)
    text = unique(rng, 2_000_000)
    near = text[:900_000] + "changed" + text[900_000:]
    return [(1, text, "en", "s", 1), (2, near, "en", "s", 1), (3, "short text", "en", "s", 1), (4, "x" * 1_500_000, "en", "s", 1), (5, None, None, None, None)]


def test_fingerprints_and_near_copies(spark, long):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, long)).collect()}
    for i, text, *_ in long:
        assert got[i]["fingerprint"] == f"{plain_fingerprint(text):016x}"
    assert got[2]["component_id"] == 1 and got[4]["component_id"] == 4
    assert sorted(r["doc_id"] for r in nearcopies.keep_first(frame(spark, long)).collect()) == [1, 3, 4, 5]


def test_media_and_packing(spark, long):
    got = {r["doc_id"]: r for r in media.media_columns(frame(spark, long)).collect()}
    full = Tokenizer.from_file(token_files()["vocab"])
    pieces = packing.pack(frame(spark, long), **token_files()).collect()
    for i, text, *_ in long:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert got[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        if i == 4:
            continue  # minutes of work for the tokenizer itself
        ids = np.array(full.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        mine = sorted((p["start"], p["length"], p["ids_crc32"]) for p in pieces if p["doc_id"] == i)
        assert [s for s, _, _ in mine] == np.cumsum([0] + [n for _, n, _ in mine])[:-1].tolist() and sum(n for _, n, _ in mine) == len(ids)
        assert all(c == zlib.crc32(ids[s:s + n].tobytes()) for s, n, c in mine)


def test_secrets(spark):
    rng = random.Random(6)
    keys = ["%032x" % rng.getrandbits(128) for _ in range(3000)]
    text = " ".join(f"{unique(rng, 300)} {k}" for k in keys)
    got = secrets.scan(frame(spark, [(1, text, "en", "s", 1)])).first()
    assert got["n_hex"] == 3000
    clean = secrets.redact(frame(spark, [(1, text, "en", "s", 1)])).first()["text"]
    assert clean.count("[SECRET]") >= 3000 and not any(k in clean for k in keys)


def test_repeats_beyond_a_chunk(spark):
    rng = random.Random(8)
    text = unique(rng, suffixes._CHUNK + 30_000)
    passage = text[suffixes._CHUNK - 700:suffixes._CHUNK + 800]
    rows = [(1, text, "en", "s", 1), (2, f"{unique(rng, 5000)}#{passage}#{unique(rng, 5000)}", "en", "s", 1), (3, unique(rng, 2000), "en", "s", 1)]
    alone = suffixes.remove_repeats(frame(spark, rows[:1])).first()
    assert (alone["n_bytes"], alone["n_removed"]) == (len(text), 0)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in suffixes.remove_repeats(frame(spark, rows)).collect()}
    assert got[1] == [(suffixes._CHUNK - 700, suffixes._CHUNK + 800)] and got[2] == [(5001, 6501)] and got[3] == []
