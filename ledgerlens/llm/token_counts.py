"""Token counts of whole texts by the whole-token shortcut.

Offline, the driver proves for every vocabulary string whether it is one
pre-token that merges into exactly one token. Tasks then count pre-tokens found
among the proven strings as one token without merging; only the rest is merged
(together, per block) and its count kept in a memo of bounded size. Counting is
a map: no rows move between tasks, and a text is read whole.

Defined results: NULL counts as the empty text, with 0 bytes and 0 tokens;
special strings inside a text count as one token each. Repeated rows are counted
each; very long texts are a block of their own; an empty table gives no rows.
Columns named like the output are replaced; all others pass through.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import MEMO_UNITS, PairRanks, merge_pieces
from .bpe_vocab import Vocabulary, cut_block, is_one_pretoken, load_vocabulary
from .common import append_columns, once_per_worker, utf8


def prove_single_tokens(vocab: Vocabulary) -> frozenset[str]:
    """The vocabulary strings that, as a text of their own, give one token.

    Proven by cutting and merging each: it must be a single pre-token, hold no
    special string, and merge into its own id alone. Strings that aren't UTF-8
    can't be pre-tokens. Bounded by the vocabulary, so done on the driver.
    """
    found = {}
    for i, raw in vocab.token_bytes.items():
        try:
            found[raw.decode()] = i
        except UnicodeDecodeError:
            continue
    whole = [s for s in found
             if s and not any(x in s for x in vocab.specials) and vocab.pretokens(s) == [s]]
    return frozenset(s for s, ids in zip(whole, merge_pieces(whole, PairRanks(vocab))) if ids == (found[s],))


class TokenCounter:
    """Counts the tokens of blocks of texts."""

    def __init__(self, vocab: Vocabulary, single: frozenset[str], memo_units: int = MEMO_UNITS):
        self.vocab, self.single, self.memo_units = vocab, single, memo_units
        self.pairs = PairRanks(vocab)
        self.memo: dict[str | int, int] = {}

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        block = cut_block(texts, self.vocab)
        tokens = np.concatenate([[0], np.cumsum(self._counts(block.units)[block.unit_of])])
        return np.diff(tokens[block.starts])

    def _counts(self, units: list[str | int]) -> np.ndarray:
        memo, single, pretokens = self.memo, self.single, self.vocab.pretokens
        # A special string is one token, and so is a pre-token of the shortcut.
        fresh: dict[str | int, int] = {u: 1 for u in units if u in single or isinstance(u, int)}
        new = [u for u in units if u not in memo and u not in fresh]
        rest = [u for u in new if is_one_pretoken(u)]
        alone = set(rest)
        cuts = [(u, pretokens(u)) for u in new if u not in alone]
        rest += dict.fromkeys(p for _, found in cuts for p in found if p not in single and p not in alone)
        merged = dict(zip(rest, map(len, merge_pieces(rest, self.pairs))))
        fresh.update(merged)
        for unit, found in cuts:
            fresh[unit] = sum([merged.get(p, 1) for p in found])
        out = np.fromiter((memo[u] if u in memo else fresh[u] for u in units), np.int64, len(units))
        # The units met first, so mostly the common ones, stay.
        memo.update(islice(fresh.items(), max(0, self.memo_units - len(memo))))
        return out


def token_counts(df: DataFrame, vocab_path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than
    ``limit`` tokens) of column ``text`` under the byte-level BPE vocabulary at
    ``vocab_path``, which the driver reads."""
    vocab = load_vocabulary(vocab_path)
    shared = df.sparkSession.sparkContext.broadcast((vocab, prove_single_tokens(vocab)))  # bounded: the vocabulary

    def start():
        counter = once_per_worker(f"counter {vocab_path}", lambda: TokenCounter(*shared.value))
        return lambda texts: [pa.array(counter.count(texts), pa.int64())]

    sized = df.withColumn("n_bytes", F.octet_length(utf8(text)).cast("long"))
    counted = append_columns(sized, text, T.StructType().add("n_tokens", T.LongType()), start)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
