"""BPE encoding and decoding through a pair occurrence index.

Each task cuts its texts into pre-tokens and merges the distinct ones it has
not met yet together. All their symbols lie in one array; an index maps every
adjacent pair that has a rank to all its positions. The active ranks are taken
in ascending order: all positions of a rank are merged at once, and the lists
of the pairs that appear beside the merged symbols grow. A position whose pair
has changed meanwhile is passed over when its rank comes up.

Rows never move between tasks: encoding and decoding are maps. A task holds
one block of texts, the index of that block and a memo of bounded size.

Defined results: NULL and empty texts give no ids; ids outside the vocabulary
and NULL ids decode to nothing; bytes that aren't UTF-8 decode to U+FFFD.
Repeated rows are encoded each; pairs of equal rank merge from left to right; very
long texts are a block of their own; an empty table gives no rows. Columns named like the output are replaced; all others pass through.
"""

from __future__ import annotations

import heapq
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe_vocab import Vocabulary, cut_block, is_one_pretoken, load_vocabulary
from .common import append_columns, once_per_worker

#: A worker keeps the ids of at most so many units, besides those of the current block.
MEMO_UNITS = 150_000
#: Bytes of text that are encoded and decoded at once; ids, decoded text and index of a block are held together.
ROUND_TRIP_BLOCK = 2 << 20

_GAP, _DEAD = -1, -2
_SHIFT = 32
#: Lists of at least so many positions are merged as arrays, shorter ones one by one.
_MANY = 48


class PairRanks:
    """The merges of a vocabulary, by pair and by rank."""

    def __init__(self, vocab: Vocabulary):
        self.byte_ids = np.array(vocab.byte_ids, np.int64)
        self.rank = {left << _SHIFT | right: rank for (left, right), (rank, _) in vocab.merges.items()}
        self.by_rank = {rank: (*pair, merged) for pair, (rank, merged) in vocab.merges.items()}
        keys = np.array([*self.rank, np.iinfo(np.int64).max], np.int64)
        ranks = np.array([*self.rank.values(), -1], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], ranks[order]

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 where they never merge."""
        keys = np.where((left < 0) | (right < 0), -1, left << _SHIFT | right)
        at = np.searchsorted(self._keys, keys)
        return np.where(self._keys[at] == keys, self._ranks[at], -1)


def merge_pieces(pieces: list[str], pairs: PairRanks) -> list[tuple[int, ...]]:
    """The token ids of each pre-token, all merged together by the pair index."""
    if not pieces:
        return []
    raw = [p.encode() for p in pieces]
    data = np.frombuffer(b"\0".join([b"", *raw, b""]), np.uint8)
    gaps = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)])
    symbols = pairs.byte_ids[data]
    symbols[gaps] = _GAP
    after = np.arange(1, len(data) + 1)
    before = np.arange(-1, len(data) - 1)
    symbol_at, after_at, before_at = memoryview(symbols), memoryview(after), memoryview(before)

    ranks = pairs.of(symbols[:-1], symbols[1:])
    at = np.flatnonzero(ranks >= 0)
    at = at[np.argsort(ranks[at], kind="stable")]
    active, first = np.unique(ranks[at], return_index=True)
    heap = active.tolist()  # sorted, so a heap already
    index = {r: p.tolist() for r, p in zip(heap, np.split(at, first[1:]))} if heap else {}
    rank_of = pairs.rank.get

    def add(rank: int, position: int) -> None:
        if rank in index:
            index[rank].append(position)
        else:
            index[rank] = [position]
            heapq.heappush(heap, rank)

    while heap:
        rank = heapq.heappop(heap)
        left, right, merged = pairs.by_rank[rank]
        positions = index.pop(rank)
        if left != right and len(positions) >= _MANY:
            # No two of these overlap, so all merge at once; one listed twice does no harm.
            at = np.array(positions, np.int64)
            at = at[symbols[at] == left]
            at = at[symbols[after[at]] == right]
            gone = after[at]
            symbols[at], symbols[gone], after[at] = merged, _DEAD, after[gone]
            before[after[at]] = at
            for start in (before[at], at):
                made = pairs.of(symbols[start], symbols[after[start]])
                some = made >= 0
                made, start = made[some], start[some]
                order = np.argsort(made, kind="stable")
                kinds, bounds = np.unique(made[order], return_index=True)
                for r, group in zip(kinds.tolist(), np.split(start[order], bounds[1:]) if len(kinds) else ()):
                    if r in index:
                        index[r] += group.tolist()
                    else:
                        index[r] = group.tolist()
                        heapq.heappush(heap, r)
            continue
        if left == right:
            positions.sort()  # a run of one symbol merges from its left
        for p in positions:
            if symbol_at[p] != left:
                continue
            gone = after_at[p]
            if symbol_at[gone] != right:
                continue
            nxt, prv = after_at[gone], before_at[p]
            symbol_at[p], symbol_at[gone], after_at[p], before_at[nxt] = merged, _DEAD, nxt, p
            one, two = symbol_at[prv], symbol_at[nxt]
            if one >= 0 and (made := rank_of(one << _SHIFT | merged)) is not None:
                add(made, prv)
            if two >= 0 and (made := rank_of(merged << _SHIFT | two)) is not None:
                add(made, p)

    alive = symbols >= 0
    ids = symbols[alive].tolist()
    bounds = np.concatenate([[0], np.cumsum(alive)])[gaps].tolist()
    return [tuple(ids[a:b]) for a, b in zip(bounds, bounds[1:])]


class BlockEncoder:
    """Encodes blocks of texts; keeps the ids of units met before."""

    def __init__(self, vocab: Vocabulary, memo_units: int = MEMO_UNITS):
        self.vocab, self.pairs, self.memo_units = vocab, PairRanks(vocab), memo_units
        self.memo: dict[str | int, tuple[int, ...]] = {}

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Token ids of each text."""
        block = cut_block(texts, self.vocab)
        known = self._ids(block.units)
        lengths = np.fromiter(map(len, known), np.int64, len(known))
        flat = np.fromiter(chain.from_iterable(known), np.int32, int(lengths.sum()))
        first = np.cumsum(lengths) - lengths
        taken = lengths[block.unit_of]
        ends = np.cumsum(taken)
        # Each occurrence of a unit takes that unit's run of ``flat``.
        ids = flat[np.repeat(first[block.unit_of] - ends + taken, taken) + np.arange(int(taken.sum()))]
        bounds = np.concatenate([[0], ends])[block.starts]
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))

    def _ids(self, units: list[str | int]) -> list[tuple[int, ...]]:
        memo, pretokens = self.memo, self.vocab.pretokens
        new = [u for u in units if u not in memo]
        whole = [u for u in new if isinstance(u, str) and is_one_pretoken(u)]
        fresh: dict[str | int, tuple[int, ...]] = dict.fromkeys(whole, ())
        cuts = [(u, (u,) if isinstance(u, int) else pretokens(u)) for u in new if u not in fresh]
        rest = dict.fromkeys(p for u, found in cuts if isinstance(u, str) for p in found if p not in fresh)
        whole += rest
        merged = dict(zip(whole, merge_pieces(whole, self.pairs)))
        fresh.update(merged)
        for unit, found in cuts:
            fresh[unit] = found if isinstance(unit, int) else tuple(chain.from_iterable(map(merged.__getitem__, found)))
        out = [memo[u] if u in memo else fresh[u] for u in units]
        # The units met first, so mostly the common ones, stay.
        memo.update(islice(fresh.items(), max(0, self.memo_units - len(memo))))
        return out


def encode_texts(df: DataFrame, vocab_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``: the token ids of column ``text`` under the byte-level BPE
    vocabulary at ``vocab_path`` (read on the driver). Special strings inside a
    text give their own id, as the tokenizers library does by default."""
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocab_path))  # bounded: the vocabulary file

    def start():
        encoder = once_per_worker(f"encoder {vocab_path}", lambda: BlockEncoder(shared.value))
        return lambda texts: [encoder.encode(texts)]

    return append_columns(df, text, T.StructType().add(ids, T.ArrayType(T.IntegerType())), start)


class BlockDecoder:
    """Decodes blocks of id lists by gathering the tokens' bytes."""

    def __init__(self, vocab: Vocabulary):
        self.size = max(vocab.token_bytes, default=-1) + 1
        spelled = [vocab.token_bytes.get(i, b"") for i in range(self.size)] + [b""]  # the last: unknown ids
        self.length = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.first = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)

    def decode(self, lists: pa.ListArray) -> pa.StringArray:
        """The text that each list of ids spells."""
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        ids[(ids < 0) | (ids >= self.size)] = self.size
        taken = self.length[ids]
        ends = np.cumsum(taken)
        data = self.flat[np.repeat(self.first[ids] - ends + taken, taken) + np.arange(int(taken.sum()))]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts),
                                               [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # some list does not spell UTF-8
            return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())


def decode_ids(df: DataFrame, vocab_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``: the string that the token ids in column ``ids`` spell."""
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocab_path))  # bounded: the vocabulary file

    def start():
        decoder = BlockDecoder(shared.value)
        return lambda lists: [decoder.decode(lists)]

    return append_columns(df, ids, T.StructType().add(text, T.StringType()), start)


def round_trip(df: DataFrame, vocab_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded",
               keep_text: bool = True) -> DataFrame:
    """Add ``ids`` and ``decoded``, as ``encode_texts`` and then ``decode_ids``
    do, in one pass: a task needs one Python worker, and ids travel once."""
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocab_path))  # bounded: the vocabulary file

    def start():
        encoder, decoder = once_per_worker(f"round trip {vocab_path}",
                                           lambda: (BlockEncoder(shared.value), BlockDecoder(shared.value)))

        def compute(texts: pa.Array) -> list:
            found = encoder.encode(texts)
            return [found, decoder.decode(found)]
        return compute

    fields = T.StructType().add(ids, T.ArrayType(T.IntegerType())).add(decoded, T.StringType())
    return append_columns(df, text, fields, start, block_bytes=ROUND_TRIP_BLOCK, keep_source=keep_text)
