"""Byte-level BPE vocabularies: loading, pre-tokens and special strings.

The vocabulary file's path is a parameter. The driver reads the file once and
broadcasts the parsed vocabulary; its size is the file's own (tens of thousands
of entries), whatever the data.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# The published pattern that cuts text into pre-tokens.
PRETOKEN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Two adjacent characters of Unicode's White_Space, in RE2's syntax.
_SPACES_MEET = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]{2}"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte, by the published rule:
    printable Latin-1 bytes stand for themselves, the others take 256, 257, ..."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabulary:
    """A byte-level BPE vocabulary.

    ``merges`` maps ``(left id, right id)`` to ``(rank, merged id)``;
    ``token_bytes`` maps an id to its bytes; ``specials`` maps the special
    strings to their ids.
    """

    merges: dict[tuple[int, int], tuple[int, int]]
    token_bytes: dict[int, bytes]
    byte_ids: list[int]
    specials: dict[str, int]
    _special_pattern: object = field(default=None, repr=False)
    _pretoken_pattern: object = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_special_pattern": None, "_pretoken_pattern": None}

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a text that holds no special string."""
        if self._pretoken_pattern is None:
            self._pretoken_pattern = regex.compile(PRETOKEN_PATTERN)
        return self._pretoken_pattern.findall(text)

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """``text`` cut at its special strings: (ordinary text, None) and
        (special string, its id) in order; the longest string wins a tie."""
        if not self.specials:
            return [(text, None)] if text else []
        if self._special_pattern is None:
            longest_first = sorted(self.specials, key=len, reverse=True)
            self._special_pattern = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")
        if not any(s in text for s in self.specials):
            return [(text, None)] if text else []
        return [(p, self.specials.get(p) if i % 2 else None)
                for i, p in enumerate(self._special_pattern.split(text)) if p]


def is_one_pretoken(unit: str) -> bool:
    """Whether ``unit`` is a space and letters, the commonest pre-token
    (``isalpha`` holds where every character is of the pattern's \\p{L})."""
    return unit[:1] == " " and unit[1:].isalpha()


@dataclass
class CutBlock:
    """A block of texts cut into units: document i consists of the units
    ``unit_of[starts[i]:starts[i + 1]]``. A unit is a string that can be cut and
    merged by itself, or the id of a special string."""

    units: list[str | int]
    unit_of: np.ndarray
    starts: np.ndarray


def cut_block(texts: pa.Array, vocab: Vocabulary) -> CutBlock:
    """Cut texts into units that don't depend on what stands beside them.

    Where no two white-space characters meet, the pre-tokens of a text are
    those of its part before the first space and then, part by part, those of
    a space and the part: the pattern lets a pre-token begin with a space but
    never hold one inside. So such texts are cut at their spaces and each
    distinct part becomes one unit. Other texts, and those that hold a special
    string, are cut at the special strings and into pre-tokens.
    """
    texts = texts.fill_null("")
    hard = pc.match_substring_regex(texts, _SPACES_MEET)
    for special in vocab.specials:
        hard = pc.or_(hard, pc.match_substring(texts, special))
    hard = hard.to_numpy(zero_copy_only=False)

    plain = texts.filter(pa.array(~hard))
    parts = pc.split_pattern(plain, " ")
    flat = parts.flatten().dictionary_encode()
    units: list[str | int] = [" " + word for word in flat.dictionary.to_pylist()]
    others: dict[str | int, int] = {}  # leading parts, and the units of hard texts
    unit_of = flat.indices.to_numpy().astype(np.int64)
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    firsts = np.cumsum(counts) - counts
    leading = flat.take(pa.array(firsts)).dictionary_decode().to_pylist() if len(firsts) else []
    unit_of[firsts] = [others.setdefault(w, len(units) + len(others)) for w in leading]

    slow, slow_counts = [], []
    for text in texts.filter(pa.array(hard)).to_pylist():
        before = len(slow)
        for part, special in vocab.segments(text):
            for unit in vocab.pretokens(part) if special is None else (special,):
                slow.append(others.setdefault(unit, len(units) + len(others)))
        slow_counts.append(len(slow) - before)

    if slow_counts:  # back to the order of the texts
        all_counts = np.empty(len(hard), np.int64)
        all_counts[~hard], all_counts[hard] = counts, slow_counts
        of_hard = np.repeat(hard, all_counts)
        joined = np.empty(len(of_hard), np.int64)
        joined[~of_hard], joined[of_hard] = unit_of, slow
        unit_of, counts = joined, all_counts
    return CutBlock(units + list(others), unit_of, np.concatenate([[0], np.cumsum(counts)]))


@lru_cache(maxsize=8)
def load_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE vocabulary in the tokenizers library's JSON form.

    Raises ValueError for files that ask for something else than plain
    byte-level BPE (a normaliser, a prefix space, stripping specials, dropout).
    """
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, pre = data["model"], data.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True):
        raise ValueError(f"{path}: not a byte-level BPE vocabulary")
    if data.get("normalizer") or pre.get("add_prefix_space") or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError(f"{path}: normalisers, prefix spaces, dropout and ignored merges are not supported")
    added = data.get("added_tokens") or []
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
        raise ValueError(f"{path}: stripping or single-word special tokens are not supported")
    alphabet = byte_alphabet()
    ids: dict[str, int] = model["vocab"]
    specials = {t["content"]: t["id"] for t in added}
    token_bytes = {i: bytes(alphabet[c] for c in s) for s, i in ids.items() if s not in specials}
    token_bytes |= {i: s.encode() for s, i in specials.items()}
    byte_ids = [0] * 256
    for char, byte in alphabet.items():
        byte_ids[byte] = ids[char]
    merges, made_at = {}, {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        if len(left) > 1 and left not in made_at or len(right) > 1 and right not in made_at:
            raise ValueError(f"{path}: merge {rank} uses a token that no earlier merge makes")
        made_at[left + right] = rank
        merges[ids[left], ids[right]] = (rank, ids[left + right])
    return Vocabulary(merges, token_bytes, byte_ids, specials)
