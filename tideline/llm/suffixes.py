"""Repeated substrings: linear grouping suffix arrays over blocks of candidate text, merged across the corpus."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm._shared import durable, release, small

GRAM = 32  # bytes of an anchor
STEP = 16  # bytes of a block
_PLACE = np.uint64((1 << 24) - 1)
_CHUNK = 1 << 23


def suffix_array(symbols) -> list[int]:
    """Suffix array of a sequence of integers, by grouping suffixes under their Lyndon prefixes.

    First, groups are taken in descending order.  A suffix of the current group points at the nearest suffix before
    it that lies in a lower group (its previous smaller one); the suffixes pointed at form new groups right after
    their old ones, those pointed at more often further up.  A suffix's group then stands for its longest Lyndon
    prefix.  Second, suffixes are emitted in ascending order: behind the suffix at place s belong those whose Lyndon
    prefix ends at s, each at the front of what is left of its group.  Nothing is renamed or sorted again.
    """
    n = len(symbols)
    if not n:
        return []
    members: list[list[int]] = []
    below: list[int] = []  # neighbour groups, -1 at the ends
    above: list[int] = []
    size: list[int] = []  # length of the group's Lyndon prefix
    by_symbol = defaultdict(list)
    for i, s in enumerate(symbols):
        by_symbol[s].append(i)
    group = [0] * n
    for g, s in enumerate(sorted(by_symbol)):
        members.append(by_symbol[s])
        below.append(g - 1)
        above.append(g + 1)
        size.append(1)
        for i in by_symbol[s]:
            group[i] = g
    above[-1] = -1
    current = len(members) - 1
    prev = [-2] * n
    high = bytearray(len(members))  # groups that are not lower than the current one
    while current != -1:
        high[current] = 1
        mine = [i for i in members[current] if group[i] == current]
        members[current] = mine
        mine.sort()
        pointed = Counter()
        for i in mine:
            p = i - 1
            while p >= 0 and high[group[p]]:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                pointed[p] += 1
        fresh = defaultdict(list)
        for p, times in pointed.items():
            fresh[times, group[p]].append(p)
        for times, old in sorted(fresh, reverse=True):
            new = len(members)
            members.append(fresh[times, old])
            size.append(size[old] + times * size[current])
            high.append(0)
            below.append(old)
            above.append(above[old])
            if above[old] != -1:
                below[above[old]] = new
            above[old] = new
            for p in fresh[times, old]:
                group[p] = new
        current = below[current]
    # the places of the groups, in ascending order
    first = [g for g in range(len(members)) if below[g] == -1]
    front, at, g = [0] * len(members), 0, first[0]
    while g != -1:
        front[g] = at
        at += sum(1 for i in members[g] if group[i] == g)
        g = above[g]
    ends = defaultdict(list)
    for i in range(n):
        ends[i + size[group[i]]].append(i)
    out = [0] * n
    for rank in range(-1, n):
        for i in ends.get(n if rank < 0 else out[rank], ()):
            g = group[i]
            out[front[g]] = i
            front[g] += 1
    return out


def _grams(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each position on, by doubling."""
    h = b.astype(np.uint64) + np.uint64(1)
    width = 1
    while width < GRAM:
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    rest = width - span
    return np.minimum(v[:len(v) - rest], v[rest:]) if rest else v


def anchors(raw: bytes, length: int):
    """``(anchor, first, last, hash)`` arrays: the windows of ``length`` bytes that start at first..last share an anchor.

    The anchor of a window is its 32-byte string of the smallest hash, the leftmost if equal, so equal windows have
    the same anchor at the same distance wherever they are.  Every window belongs to one row.
    """
    out = []
    data = np.frombuffer(raw, dtype=np.uint8)
    width = length - GRAM + 1
    for low in range(0, len(raw) - length + 1, _CHUNK):
        part = data[low:low + _CHUNK + length - 1]
        h = _grams(part)
        best = _sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), width) & _PLACE
        best = best.astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(best)) + 1])
        last = np.concatenate([first[1:] - 1, [len(best) - 1]])
        at = best[first]
        if out and out[-1][0][-1] == at[0] + low:  # the windows of one anchor go on across the chunks
            out[-1][2][-1] = last[0] + low
            at, first, last = at[1:], first[1:], last[1:]
        if len(at):
            out.append((at + low, first + low, last + low, h[at].view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out))


ANCHORS = "id long, th long, a long, s long, pos long, first long, last long"


def find_anchors(rows: DataFrame, length: int) -> DataFrame:
    """One row per anchor of each text: ``s`` is a 64-bit digest of all its windows' text."""

    def run(batches):
        for batch in batches:
            parts = [[] for _ in range(7)]
            for i, raw in enumerate(batch.column(2).cast(pa.binary())):
                raw = raw.as_py()
                if len(raw) < length:
                    continue
                at, first, last, h = anchors(raw, length)
                view = memoryview(raw)
                digest = b"".join(hashlib.blake2b(view[f:t + length], digest_size=8).digest()
                                  for f, t in zip(first.tolist(), last.tolist()))
                n = len(at)
                for p, x in zip(parts, (np.full(n, batch.column(0)[i].as_py()), np.full(n, batch.column(1)[i].as_py()), h,
                                        np.frombuffer(digest, dtype=np.int64), at, first, last)):
                    p.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(p) if p else np.zeros(0, np.int64), pa.int64()) for p in parts],
                names=["id", "th", "a", "s", "pos", "first", "last"])

    return rows.select("id", "th", "text").mapInArrow(run, ANCHORS)


def ordered_cores(pieces: list[tuple[bytes, int, int, int]], core: int):
    """``(owner, start, run)``: all block-aligned cores of ``core`` blocks in the order of a suffix array.

    A piece is (text, anchor, first, last); its blocks are counted from the anchor, and each 16 bytes are a symbol.
    Cores are equal where neighbours in the array share a prefix of ``core`` symbols: such runs get one number.
    """
    texts, owner, start = [], [], []
    valid, base = [], 0
    for k, (raw, pos, first, last) in enumerate(pieces):
        c0 = pos - (pos - first) // STEP * STEP
        c1 = pos - (pos - last) // STEP * STEP
        n = (c1 - c0) // STEP + core
        texts.append(raw[c0:c0 + n * STEP])
        many = n - core + 1
        valid.append(np.arange(base, base + many))
        owner.append(np.full(many, k))
        start.append(c0 + STEP * np.arange(many))
        base += n
    blocks = np.frombuffer(b"".join(texts), dtype=np.dtype((np.void, STEP)))
    _, symbols = np.unique(blocks, return_inverse=True)
    symbols = symbols.reshape(-1)
    order = np.asarray(suffix_array(symbols.tolist()))
    valid, owner, start = map(np.concatenate, (valid, owner, start))
    place = np.full(len(symbols), -1)
    place[valid] = np.arange(len(valid))
    order = place[order]
    order = order[order >= 0]
    at = valid[order]
    same = np.ones(max(len(at) - 1, 0), dtype=bool)
    for k in range(core):
        same &= symbols[at[1:] + k] == symbols[at[:-1] + k]
    run = np.concatenate([[0], np.cumsum(~same)])
    return owner[order], start[order], run


def repeated_windows(pieces: list[tuple[bytes, int, int, int]], length: int):
    """``(piece, low, high)`` arrays: the windows that start at low..high of a piece are in another piece as well.

    Equal windows have equal cores, so they stand in one run of the suffix array; what a window has before and behind
    its core, 16 bytes together, is compared byte by byte inside the run.
    """
    core = length // STEP - 1
    owner, start, run = ordered_cores(pieces, core)
    size = np.bincount(run)[run]
    owner, start, run, size = (x[size > 1] for x in (owner, start, run, size))
    if not len(owner):
        return (np.zeros(0, np.int64),) * 3
    pad = b"\0" * STEP
    joined = np.frombuffer(pad + b"".join(raw + pad for raw, _, _, _ in pieces), dtype=np.uint8)
    base = STEP + np.concatenate([[0], np.cumsum([len(p[0]) + STEP for p in pieces])])[:-1]
    first, last = (np.array([p[i] for p in pieces])[owner] for i in (2, 3))
    at = (base[owner] + start)[:, None]
    edge = np.hstack([joined[at + np.arange(-STEP, 0)], joined[at + core * STEP + np.arange(STEP)]])
    # the windows of a core start 0 to 15 bytes before it; each piece stands for some of them
    least, most = np.maximum(0, start - last), np.minimum(STEP - 1, start - first)
    out = []
    i = np.flatnonzero((size == 2) & (np.r_[run[1:], -1] == run))
    j = i + 1
    equal = edge[i] == edge[j]
    before = np.cumprod(equal[:, STEP - 1::-1], axis=1).sum(axis=1)
    behind = np.cumprod(equal[:, STEP:], axis=1).sum(axis=1)
    low = np.maximum.reduce([STEP - behind, least[i], least[j]])
    high = np.minimum.reduce([before, most[i], most[j]])
    found = low <= high
    for k in (i[found], j[found]):
        out.append((owner[k], start[k] - high[found], start[k] - low[found]))
    many = np.flatnonzero(size > 2)
    for o in range(STEP if len(many) else 0):
        k = many[(least[many] <= o) & (o <= most[many])]
        if len(k) < 2:
            continue
        halves = np.ascontiguousarray(edge[k, STEP - o:2 * STEP - o]).view("<u8")
        by = np.lexsort((halves[:, 0], halves[:, 1], run[k]))
        k, halves = k[by], halves[by]
        twin = (run[k][1:] == run[k][:-1]) & (halves[1:] == halves[:-1]).all(axis=1)
        k = k[np.r_[twin, False] | np.r_[False, twin]]
        out.append((owner[k], start[k] - o, start[k] - o))
    return tuple(np.concatenate(x) for x in zip(*out))


def _promising(group: list[tuple[bytes, int, int, int]], length: int) -> list[int]:
    """The pieces of one anchor that share what all their windows, or one half of them, must have in common."""
    half = (length - GRAM) // 2
    keys = []
    seen = Counter()
    for raw, pos, first, last in group:
        mine = []
        if pos - last <= half:
            mine.append((0, raw[pos:pos + length - half]))
        if pos - first > half:
            mine.append((1, raw[pos - half - 1:pos + GRAM]))
        seen.update(mine)
        keys.append(mine)
    return [i for i, mine in enumerate(keys) if any(seen[k] > 1 for k in mine)]


PIECES = "a long, n long, id long, th long, low long, pos long, first long, last long, raw binary"
SPANS = "id long, th long, start long, stop long"


def cut_pieces(fetched: DataFrame, length: int) -> DataFrame:
    """A row for each of the ``pieces`` of a text, with the bytes around its windows."""

    def run(batches):
        for batch in batches:
            ids, ths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [[] for _ in range(9)]
            for i in range(batch.num_rows):
                raw = batch.column(2)[i].as_py().encode()
                for p in batch.column(3)[i].as_py():
                    low = max(0, p["first"] - STEP)
                    row = (p["a"], p["n"], ids[i], ths[i], low, p["pos"] - low, p["first"] - low, p["last"] - low, raw[low:p["last"] + length + STEP])
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 8 else pa.int64()) for i, c in enumerate(out)],
                                             names=[c.split()[0] for c in PIECES.split(", ")])

    return fetched.select("id", "th", "text", "pieces").mapInArrow(run, PIECES)


def repeated_in_groups(pieces: DataFrame, length: int, block_pieces: int) -> DataFrame:
    """Spans of the pieces whose windows are repeated, from suffix arrays over whole anchor groups.

    Rows of an anchor stand together; a block takes groups up to ``block_pieces`` pieces, a larger group alone.
    """

    def settle(block, names):
        rows = [[] for _ in range(4)]
        if block:
            piece, low, high = repeated_windows(block, length)
            order = np.lexsort((low, piece))
            spans: list[list[int]] = []
            for k, a, b in zip(piece[order].tolist(), low[order].tolist(), high[order].tolist()):
                if spans and spans[-1][0] == k and a <= spans[-1][2] + length:
                    spans[-1][2] = max(spans[-1][2], b)
                else:
                    spans.append([k, a, b])
            for k, a, b in spans:
                doc, th, offset, times = names[k]
                if times == 1:  # else the whole piece is known to be repeated
                    for column, value in zip(rows, (doc, th, a + offset, b + offset + length)):
                        column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["id", "th", "start", "stop"])

    def run(batches):
        block, names, group, group_names, current = [], [], [], [], None

        def close():
            for i in _promising(group, length):
                block.append(group[i])
                names.append(group_names[i])
            group.clear()
            group_names.clear()

        for batch in batches:
            a, n, ids, ths, low, pos, first, last, raw = (batch.column(i).to_pylist() for i in range(9))
            for i, anchor in enumerate(a):
                if anchor != current:
                    close()
                    current = anchor
                    if len(block) >= block_pieces:
                        yield settle(block, names)
                        block, names = [], []
                group.append((raw[i], pos[i], first[i], last[i]))
                group_names.append((ids[i], ths[i], low[i], n[i]))
        close()
        yield settle(block, names)

    return pieces.repartition("a").sortWithinPartitions("a", "id", "th", "pos").mapInArrow(run, SPANS)


CORES = "key binary, before binary, after binary, id long, th long, c long, owned int, n long"


def block_runs(pieces: list[tuple[bytes, int, int, int]], core: int):
    """``(piece, core start, digest)`` for every core in the pieces; one digest is made per run of equals."""
    digest, before = b"", -1
    for k, c, run in zip(*(x.tolist() for x in ordered_cores(pieces, core))):
        if run != before:
            digest, before = hashlib.blake2b(memoryview(pieces[k][0])[c:c + core * STEP], digest_size=16).digest(), run
        yield k, c, digest


def find_cores(pieces: DataFrame, length: int, block_pieces: int) -> DataFrame:
    """Cores of the pieces, with the blocks around them and which window starts they stand for."""
    core = length // STEP - 1

    def emit(block, names):
        out = [[] for _ in range(8)]
        for k, c, digest in block_runs(block, core):
            raw, pos, first, last = block[k]
            owned = 0
            for o in range(STEP):
                owned |= (first <= c - o <= last) << o
            # neighbouring anchors can both have a core here; each stands for windows of its own
            key = digest + (pos - c).to_bytes(4, "little", signed=True)
            row = (key, raw[max(0, c - STEP):c], raw[c + core * STEP:c + (core + 1) * STEP], names[k][0], names[k][1], c + names[k][2], owned, names[k][3])
            for column, value in zip(out, row):
                column.append(value)
        kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)],
                                          names=[c.split()[0] for c in CORES.split(", ")])

    def run(batches):
        block, names = [], []
        for batch in batches:
            _, n, ids, ths, low, pos, first, last, raw = (batch.column(i).to_pylist() for i in range(9))
            for i in range(batch.num_rows):
                block.append((raw[i], pos[i], first[i], last[i]))
                names.append((ids[i], ths[i], low[i], n[i]))
                if len(block) >= block_pieces:
                    yield emit(block, names)
                    block, names = [], []
        if block:
            yield emit(block, names)

    return pieces.mapInArrow(run, CORES)


def _ranges(start: Column, stop: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"))


def repeated_spans(rows: DataFrame, length: int = 400, block_pieces: int = 2048, group_pieces: int = 8192) -> DataFrame:
    """``(id, th, start, stop)``: bytes of strings of ``length`` bytes that start elsewhere too, in any order, overlapping.

    ``rows`` has ``id, th, text`` (no nulls).  Windows of equal content share an anchor.  Anchors that occur once are
    done; where all occurrences of an anchor agree in all their windows, or some agree fully, those are repeats, by
    128 bits of digests.  Of the rest, one piece of text for each different surrounding of an anchor goes to the task
    that holds the anchor, where the runs of a suffix array find the repeats and bytes are compared.  An anchor of more
    than ``group_pieces`` surroundings is not gathered: its pieces go through suffix arrays in blocks anywhere, and the
    runs are merged over all blocks by 128-bit digests of their cores.
    """
    if length < 64 or length % STEP:
        raise ValueError("length must be a multiple of 16, 64 at least")
    found = durable(find_anchors(rows, length), "suffix-anchors")
    seen = found.groupBy("a").agg(F.count("*").alias("n"), F.min("s").alias("s0"), F.max("s").alias("s1")).where("n > 1")
    # a join with a written aggregate has plain shuffles on both sides, so a frequent key can be split
    seen = durable(seen.select("a", (F.col("s0") == F.col("s1")).alias("alike")), "suffix-seen")
    shared = durable(found.join(seen, "a"), "suffix-shared")
    release(found, seen)
    whole = _ranges(F.col("first"), F.col("last") + length).alias("r")
    alike = shared.where("alike").select("id", "th", whole)

    mixed = shared.where("not alike")
    one = F.min(F.struct("id", "th", "pos", "first", "last")).alias("p")
    kinds = durable(mixed.groupBy("a", "s").agg(F.count("*").alias("n"), one), "suffix-kinds")
    equal = mixed.join(kinds.where("n > 1").select("a", "s"), ["a", "s"]).select("id", "th", whole)

    pieces = kinds.select("p.id", "p.th", F.struct("a", "p.pos", "p.first", "p.last", "n").alias("x"))
    pieces = pieces.groupBy("id", "th").agg(F.collect_list("x").alias("pieces"))  # at most a document's own anchors
    texts = rows.dropDuplicates(["id", "th"]) if rows.groupBy("id", "th").count().where("count > 1").take(1) else rows
    pieces = cut_pieces(texts.join(pieces, ["id", "th"]), length)
    crowded = durable(kinds.groupBy("a").count().where(F.col("count") > group_pieces).select("a"), "suffix-crowded")
    if crowded.isEmpty():
        return _spans(alike.union(equal)).union(durable(repeated_in_groups(pieces, length, block_pieces), "suffix-spans"))
    pieces = durable(pieces, "suffix-pieces")
    crowded = small(crowded)
    near = durable(repeated_in_groups(pieces.join(crowded, "a", "left_anti"), length, block_pieces), "suffix-spans")
    wide, narrow = _merged_over_blocks(pieces.join(crowded, "a"), length, block_pieces)
    return _spans(alike.union(equal).union(wide).union(narrow)).union(near)


def _spans(ranges: DataFrame) -> DataFrame:
    return ranges.select("id", "th", "r.start", "r.stop")


def _merged_over_blocks(pieces: DataFrame, length: int, block_pieces: int) -> tuple[DataFrame, DataFrame]:
    """Ranges of the repeated windows of pieces that no task could hold: all grouping is by partial aggregates and
    joins that adaptive execution can split."""
    cores = durable(find_cores(pieces, length, block_pieces), "suffix-cores")
    around = [F.min("before").alias("b0"), F.max("before").alias("b1"), F.min("after").alias("a0"), F.max("after").alias("a1")]
    many = cores.groupBy("key").agg(F.sum("n").alias("m"), *around).where("m > 1")
    many = durable(many.select("key", ((F.col("b0") == F.col("b1")) & (F.col("a0") == F.col("a1"))).alias("settled")), "suffix-many")
    open_cores = cores.join(many, "key")
    offsets = F.filter(F.sequence(F.lit(0), F.lit(STEP - 1)), lambda o: F.call_function("getbit", F.col("owned"), o) == 1)
    wide = open_cores.where("settled and n = 1").select(
        "id", "th", _ranges(F.col("c") - F.array_max(offsets), F.col("c") - F.array_min(offsets) + length).alias("r"))

    windows = open_cores.where("not settled").select("key", "before", "after", "id", "th", "c", "n", F.explode(offsets).alias("o"))
    edge = F.xxhash64(F.expr("substring(before, length(before) - o + 1, o)"), F.expr(f"substring(after, 1, {STEP} - o)"))
    windows = durable(windows.select("key", "o", edge.alias("w"), "id", "th", "c", "n"), "suffix-windows")
    twice = durable(windows.groupBy("key", "o", "w").agg(F.sum("n").alias("m")).where("m > 1").select("key", "o", "w"), "suffix-twice")
    narrow = windows.where("n = 1").join(twice, ["key", "o", "w"]).select(
        "id", "th", _ranges(F.col("c") - F.col("o"), F.col("c") - F.col("o") + length).alias("r"))
    return wide, narrow


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: what of its UTF-8 bytes goes, as maximal removed runs, and the digest of the rest.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in the same document or in
    another; strings never cross documents and are judged on the input.  Null text is empty text.  Repeated rows are
    documents of their own and repeat each other; ids may be null or repeated; extra columns are ignored; an empty
    table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    spans = repeated_spans(rows.where(F.octet_length("text") >= length), length)
    spans = spans.groupBy("id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py().encode()
                merged = []
                for s in sorted((x["start"], x["stop"]) for x in batch.column(2)[i].as_py() or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                kept, at = hashlib.sha256(), 0
                for start, stop in merged:
                    kept.update(raw[at:start])
                    at = stop
                kept.update(raw[at:])
                row = (batch.column(0)[i].as_py(), len(raw), sum(b - a for a, b in merged), len(merged), kept.hexdigest(),
                       [{"start": a, "stop": b} for a, b in merged])
                for column, value in zip(out, row):
                    column.append(value)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), kind)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    joined = rows.join(spans, ["id", "th"], "left")
    doc_id = F.when(F.col("id") != F.lit(-(2**63)), F.col("id"))
    return joined.select(doc_id.alias("doc_id"), "text", "spans").mapInArrow(run, RESULT)
