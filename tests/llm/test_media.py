import hashlib
import zlib

import pytest
from tests.llm.cases import awkward, frame

from tideline.llm import media
from tideline.llm._shared import scratch_path


def payload(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))


@pytest.mark.parametrize("clashes", [False, True])
def test_round_trip_of_whole_texts(spark, clashes):
    rows = awkward()
    got = media.media_columns(frame(spark, rows, clashes)).collect()
    want = {r[0]: payload(r[1]) for r in rows}
    assert len(got) == len(rows)
    features = {}
    for r in got:
        p = want[r["doc_id"]]
        assert r["payload_bytes"] == len(p) == r["width"] * r["height"]
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(p[-32:])
        stored = media.encode(p)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert features.setdefault(r["payload_sha256"], r["feature"]) == r["feature"]
        assert media.decode(stored) == p


def test_shards_are_tar_files_with_each_image_once(spark, tmp_path):
    docs = frame(spark).coalesce(1)
    root = f"file://{tmp_path}/shards"
    manifest = media.write_shards(docs, root, shard_bytes=20_000).cache()
    rows = manifest.collect()
    strays = [tmp_path / "shards" / rows[0]["shard"][:2] / "stray.tar", tmp_path / "shards" / "0f" / "stray.tar"]
    for stray in strays:
        stray.parent.mkdir(exist_ok=True)
        stray.write_bytes(b"left by a lost attempt")
    assert media.sweep(root, manifest) == 2 and not any(stray.exists() for stray in strays)
    shards = {r["shard"] for r in rows}
    assert len(shards) > 1
    for name in shards:
        data = (tmp_path / "shards" / name).read_bytes()
        entries = media.unpack(data)
        here = [r for r in rows if r["shard"] == name]
        assert set(entries) == {f"{r['digest']}.png" for r in here}
        for r in here:
            assert data[r["offset"]:r["offset"] + r["length"]] == entries[f"{r['digest']}.png"]


def test_damage_is_found():
    stored = media.encode(payload("some text"))
    assert media.header(stored[:33]) == {"width": 576, "height": 1, "bits": 8, "channels": 1}
    for at in (3, 20, len(stored) - 20):
        bad = stored[:at] + bytes([stored[at] ^ 1]) + stored[at + 1:]
        with pytest.raises((ValueError, zlib.error)):
            media.decode(bad)


def test_empty_table(spark):
    assert media.media_columns(frame(spark, [])).count() == 0
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
