"""Packing token sequences: dot-product vector bin packing under limits on tokens, segments and loss tokens."""

from __future__ import annotations

import json
import re
import zlib
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import ship_package

END_ID = 1
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long, loss_tokens long")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class TokenIds:
    """Ids of the tokenizer file ``vocab``, as little-endian unsigned 32-bit bytes.

    The byte-level pre-tokenizer never joins text across a space that stands between two other characters, so the
    parts between such spaces are encoded once and remembered, up to ``memo_limit`` parts.  ``ranks`` names the
    same vocabulary as a rank file, which encodes unseen parts faster; without it ``tokenizers`` does.
    A text that mentions a special token is left to ``tokenizers`` whole.
    """

    def __init__(self, vocab: str, ranks: str | None = None, memo_limit: int = 250_000):
        self.vocab = vocab
        with open(vocab, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file)["added_tokens"]]
        self.memo: dict[str, bytes] = {}
        self.memo_limit = memo_limit
        self.encode_part = self._by_ranks(ranks) if ranks else self._whole

    @cached_property
    def full(self):
        """The tokenizer itself: about 90 MB, so a worker loads it at the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocab)

    @staticmethod
    def _by_ranks(path: str):
        import base64

        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda part: np.array(encode(part), dtype="<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._whole(text)
        parts = text.split(" ")
        if any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
            parts = _SINGLE_SPACE.split(text)
        memo = self.memo
        out = [self.encode_part(parts[0]) if parts[0] else b""]
        for part in parts[1:]:
            ids = memo.get(part)
            if ids is None:
                ids = self.encode_part(" " + part)
                if len(memo) < self.memo_limit:
                    memo[part] = ids
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=2)
def _token_ids(vocab: str, ranks: str | None) -> TokenIds:
    return TokenIds(vocab, ranks)


def _share(take: int, tokens: int, loss: int) -> int:
    """Loss tokens of a piece: those of its item in proportion, rounded up."""
    return -(-loss * take // tokens)


def _all_but_first(take: int, tokens: int, loss: int) -> int:
    return max(0, take - 1)


def dot_product_bins(items: list[tuple[int, int, int]], limits: tuple[int, int, int], cut: bool = False, piece_loss=_share):
    """Bins of ``(item, start, length)`` for items of (tokens, segments, loss tokens) under three limits at once.

    The open bin takes the fitting item with the largest dot product of what the bin has left and what the item
    needs, both as shares of the limits and weighted by the overall demand; ties go to the earlier item.
    With ``cut`` an item may be split when nothing whole fits: the largest one left gives as much as the bin holds.
    ``piece_loss(take, tokens, loss)`` gives the loss tokens of a piece of what is left of an item.  An item that exceeds a limit and
    can't be cut raises ValueError.
    """
    if not items:
        return []
    caps = np.asarray(limits, dtype=np.float64)
    need = np.asarray(items, dtype=np.float64)
    done = np.zeros(len(items), dtype=np.int64)  # tokens of each item already placed
    if not cut and (need > caps).any():
        raise ValueError("an item exceeds a limit and may not be cut")
    weight = need.sum(axis=0) / caps
    weight = weight / max(weight.sum(), 1e-300)
    open_items = need[:, 0] > 0
    bins = []
    while open_items.any():
        left, content, used = caps.copy(), [], np.zeros(len(items), dtype=bool)
        while True:
            fits = open_items & ~used & (need <= left).all(axis=1)
            if fits.any():
                score = np.where(fits, (need / caps) @ (weight * left / caps), -1.0)
                k = int(score.argmax())
                take = int(need[k, 0])
            elif cut and left[0] >= 1 and left[1] >= 1 and (open_items & ~used).any():
                k = int(np.where(open_items & ~used, need[:, 0], -1.0).argmax())
                per_token = need[k, 2] / need[k, 0]
                take = int(min(left[0], need[k, 0], left[2] // per_token if per_token else left[0]))
                if take < 1:
                    break
            else:
                break
            tokens, whole = int(need[k, 0]), int(need[k, 2])
            loss = piece_loss(take, tokens, whole)
            content.append((k, int(done[k]), take))
            left -= (take, need[k, 1], min(loss, left[2]))
            done[k] += take
            need[k, 0] -= take
            need[k, 2] = piece_loss(tokens - take, tokens, whole) if take < tokens else 0
            used[k] = True
            open_items[k] = need[k, 0] > 0
        bins.append(content)
    return bins


def powers_of_two(total: int) -> list[int]:
    return [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]


def regroup(content, lengths: list[int]):
    """Deal the pieces of a bin, cut where needed, into sequences of exactly these lengths."""
    out, queue = [], list(content)
    for size in lengths:
        sequence = []
        while size:
            k, start, length = queue.pop(0)
            take = min(size, length)
            sequence.append((k, start, take))
            size -= take
            if take < length:
                queue.insert(0, (k, start + take, length - take))
        out.append(sequence)
    return out


def pack_window(lengths: list[int], max_tokens: int, max_segments: int, max_loss: int):
    """Sequences of ``(document, start, length)`` that hold every token once, none of them padded.

    Whole multiples of ``max_tokens`` become sequences of their own; what is left is bin-packed with cuts; a bin
    that stays short is dealt into sequences whose lengths are powers of two.
    """
    sequences, items, origin = [], [], []
    for d, n in enumerate(lengths):
        full = n // max_tokens if max_loss >= max_tokens - 1 else 0
        sequences += [[(d, j * max_tokens, max_tokens)] for j in range(full)]
        if n > full * max_tokens:
            rest = n - full * max_tokens
            items.append((rest, 1, max(0, rest - 1)))
            origin.append((d, full * max_tokens))
    for content in dot_product_bins(items, (max_tokens, max_segments, max_loss), cut=True, piece_loss=_all_but_first):
        pieces = [(origin[k][0], origin[k][1] + start, length) for k, start, length in content]
        total = sum(p[2] for p in pieces)
        sequences += [pieces] if total == max_tokens else regroup(pieces, powers_of_two(total))
    return sequences


def pack(docs: DataFrame, vocab: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text",
         max_tokens: int = 2048, max_segments: int = 64, max_loss: int = 2048, window: int = 256) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and the checksum of its ids.

    A document's ids are the tokenizer's, without special ones, and id 1 at the end (null or empty text: just id 1).
    All but the first id of a piece bear loss.  Partitions are packed on their own in windows of ``window``
    documents, so nothing is shuffled and memory is bounded by a window; sequence ids carry the partition number.
    Repeated rows are documents of their own; ids may be null; very long texts are cut; extra columns are ignored; an
    empty table gives no rows.  A limit on loss below ``max_tokens - 1`` is kept by shorter sequences.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        from pyspark import TaskContext

        tokens = _token_ids(vocab, ranks)
        end = np.array([END_ID], dtype="<u4").tobytes()
        next_id = (TaskContext.get().partitionId()) << 40
        for batch in batches:
            for low in range(0, batch.num_rows, window):
                part = batch.slice(low, window)
                names = part.column(0).to_pylist()
                ids = [tokens.ids(t.as_py()) + end for t in part.column(1)]
                out = [[] for _ in range(9)]
                for sequence in pack_window([len(x) // 4 for x in ids], max_tokens, max_segments, max_loss):
                    size, offset = sum(p[2] for p in sequence), 0
                    for d, start, length in sequence:
                        crc = zlib.crc32(memoryview(ids[d])[4 * start:4 * (start + length)])
                        row = (names[d], start, length, crc, len(ids[d]) // 4, next_id, offset, size, length - 1)
                        for column, value in zip(out, row):
                            column.append(value)
                        offset += length
                    next_id += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                                 names=[x.split()[0] for x in PIECES.split(", ")])

    return rows.mapInArrow(run, PIECES)


def pack_conversations(turns: DataFrame, max_tokens: int = 2048, max_segments: int = 16, max_loss: int = 1024,
                       group: int = 512) -> DataFrame:
    """Instruction data: ``(item_id, tokens, segments, loss_tokens)`` -> ``(item_id, bin_id)``, items never cut.

    Items over a limit get ``bin_id`` null.  Items are dealt to groups of about ``group`` by their hash.
    """
    ship_package(turns.sparkSession)
    fit = ((F.col("tokens") <= max_tokens) & (F.col("segments") <= max_segments)
           & (F.col("loss_tokens") <= max_loss) & (F.col("tokens") > 0))
    rows = turns.select("item_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
                                     for c in ("tokens", "segments", "loss_tokens")])
    n = max(1, rows.count() // group)
    dealt = rows.where(fit).withColumn("_g", F.pmod(F.xxhash64("item_id"), F.lit(n)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("tokens", "descending"), ("item_id", "ascending")])
        items = list(zip(*(table.column(c).to_pylist() for c in ("tokens", "segments", "loss_tokens"))))
        bin_of = [0] * len(items)
        for b, content in enumerate(dot_product_bins(items, (max_tokens, max_segments, max_loss))):
            for k, _, _ in content:
                bin_of[k] = b
        base = table.column("_g")[0].as_py() << 32
        return pa.table({"item_id": table.column("item_id").cast(pa.int64()),
                         "bin_id": pa.array([base | b for b in bin_of], pa.int64())})

    packed = dealt.groupBy("_g").applyInArrow(run, "item_id long, bin_id long")
    return packed.union(rows.where(~fit).select(F.col("item_id").cast("long"), F.lit(None).cast("long")))


def conversation_items(turns: DataFrame, vocab: str, ranks: str | None = None) -> DataFrame:
    """``(conv_id, turn, role, text)`` -> ``(item_id, tokens, segments, loss_tokens)``: one item a conversation.

    A turn is a segment, its ids and id 1; only those of the assistant bear loss.  Null text is empty text; turns
    without conv_id are left out; repeated rows are turns of their own; an empty table gives no rows.
    """
    ship_package(turns.sparkSession)
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("bears"))

    def run(batches):
        known = _token_ids(vocab, ranks)
        for batch in batches:
            sizes = [len(known.ids(t.as_py())) // 4 + 1 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), batch.column(2)], names=["item_id", "n", "bears"])

    counted = rows.mapInArrow(run, "item_id long, n long, bears boolean")
    return counted.groupBy("item_id").agg(F.sum("n").alias("tokens"), F.count("*").alias("segments"),
                                          F.sum(F.when(F.col("bears"), F.col("n")).otherwise(0)).alias("loss_tokens"))
