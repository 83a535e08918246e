"""Hierarchical multi-length packing of documents into training sequences.

Documents are tokenized and packed inside the partition that reads them, block
by block (a block holds about ``block_tokens`` tokens), so no token is shuffled
and a lost executor only repeats its own partitions.

1. *Route*: a document gives as many full windows of ``max_len`` tokens as fit;
   the rest goes to the smallest tier (power of two) that holds it.
2. *Pack*: from the longest tier down, each window starts with the longest rest
   of its tier; its gap is filled from shorter tiers, best fit first, and by
   the head of the shortest rest if none fits whole.
3. The last open window of a block is cut into windows of the shorter tiers;
   what is left is the one sequence of the block that needs padding.
4. *Balance*: windows of a tier are dealt to step groups of ``step_tokens``
   tokens, so that groups hold about as many pieces as each other.

Defined cases: a null text is an empty one, and an empty document is its end
token alone. A null id is kept as null. Repeated rows are documents of their
own. A text longer than a block is a block of its own. An empty table gives no
rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import bisect
import functools
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_text, map_rows

SCHEMA = [("doc_id", pa.int64(), "long"), ("start", pa.int64(), "long"), ("length", pa.int64(), "long"),
          ("ids_crc32", pa.int64(), "long"), ("doc_tokens", pa.int64(), "long"),
          ("sequence_id", pa.int64(), "long"), ("offset", pa.int64(), "long"),
          ("tier", pa.int64(), "long"), ("step_group", pa.int64(), "long")]
#: Words in a generation of the cache; a full one is kept until the next is full, so that frequent words stay.
_GENERATION = 400_000
_CALL = 500


def _letters(word: str) -> bool:
    """Whether a word has only Latin, Greek or Cyrillic letters, of which all Unicode versions in use know the same."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0530")


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit bytes, through a cache of words.

    Words between ASCII white space are tokenized on their own, which equals
    tokenizing the text because the tokenizer drops white space. Texts that are
    not in normal form C, with a capital sigma (whose lower case depends on its
    place) or with one of the tokenizer's added tokens (found before anything
    else) go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        # For words of letters only, in lower case and normal form, nothing is left to normalise or to split but blanks.
        # It has the same model, not a copy: each worker holds one.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _ids(self, ids: list[int]) -> bytes:
        return np.asarray(ids, dtype="<u4").tobytes()

    def _unknown(self, words: set[str]) -> set[str]:
        """The words whose ids are not at hand; those of the generation before are taken over."""
        new = words.difference(self.words)
        old = {w: self.before[w] for w in new if w in self.before}  # set.intersection would go through all of a dict
        self.words.update(old)
        return new.difference(old)

    def _learn(self, words: set[str]) -> None:
        """Words of letters only are one pre-token each; for others, a token is the last word's that begins at or before it."""
        stems = {w: w[:-1] for w in words if w[-1:] in (".", ",") and _letters(w[:-1])}  # the first part is often known
        todo = self._unknown({".", ",", *stems.values()}) | (words - stems.keys())
        plain = [w for w in todo if _letters(w)]
        for k in range(0, len(plain), _CALL):
            some = plain[k:k + _CALL]
            got = self.letters.encode(" ".join(some), add_special_tokens=False)
            self._take(some, got.ids, got.word_ids, np.arange(len(some) + 1))
        odd = [w for w in todo if not _letters(w)]
        for k in range(0, len(odd), _CALL):
            some = odd[k:k + _CALL]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            self._take(some, got.ids, [a for a, _ in got.offsets], np.cumsum([0, *(len(w) + 1 for w in some)]))
        self.words.update((w, self.words[x] + self.words[w[-1]]) for w, x in stems.items())

    def _take(self, words: list[str], ids: list[int], at: list[int], begins: np.ndarray) -> None:
        """The ids of each word: those whose place is at or after its own, and before the next word's."""
        whole, cuts = self._ids(ids), (4 * np.searchsorted(np.asarray(at, dtype=np.int64), begins)).tolist()
        self.words.update((w, whole[a:b]) for w, a, b in zip(words, cuts, cuts[1:], strict=False))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of some texts; words that are new to all of them are tokenized together."""
        split: list[list[str] | None] = []
        for text in texts:
            low = text.lower()
            plain = "Σ" not in text and unicodedata.is_normalized("NFC", text) and not any(map(low.__contains__, self.special))
            split.append((low.replace("\n", " ") if "\n" in low else low).split(" ") if plain else None)
        if len(self.words) > _GENERATION:
            self.before, self.words = self.words, {}
        new = self._unknown(set().union(*(x for x in split if x)))
        if new:
            self._learn(new)
        find = self.words.__getitem__
        return [self._ids(self.tokenizer.encode(text, add_special_tokens=False).ids) if x is None else b"".join(map(find, x))
                for text, x in zip(texts, split, strict=True)]


def _portions(batch: pa.RecordBatch, chars: int = 1_000_000):
    """``(ids, texts)`` of a batch, a few at a time: texts of about ``chars`` in all, or one longer one."""
    ids, some, held = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        ids.append(doc_id)
        some.append(text.as_py() or "")
        held += len(some[-1])
        if held >= chars:
            yield ids, some
            ids, some, held = [], [], 0
    yield ids, some


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder, with its cache of words, per Python worker."""
    return Encoder(path)


def pack_block(lengths: list[int], max_len: int = 4096, min_len: int = 256) -> list[tuple[int, list[tuple]]]:
    """Windows ``(tier, [(document, start, length), ...])`` for documents of the given lengths."""
    windows: list[tuple[int, list[tuple]]] = []
    pool: list[tuple[int, int, int]] = []  # (tokens left, document, where they start), sorted
    for doc, n in enumerate(lengths):
        full = n // max_len
        windows += [(max_len, [(doc, i * max_len, max_len)]) for i in range(full)]
        if n % max_len:
            pool.append((n % max_len, doc, full * max_len))
    pool.sort()
    while pool:
        left, doc, start = pool.pop()
        tier, pieces, used = max(min_len, 1 << (left - 1).bit_length()), [(doc, start, left)], left
        while used < tier and pool:
            gap = tier - used
            k = bisect.bisect_right(pool, (gap, len(lengths), 0)) - 1
            left, doc, start = pool.pop(max(k, 0))
            if left > gap:  # none fits whole
                bisect.insort(pool, (left - gap, doc, start + gap))
                left = gap
            pieces.append((doc, start, left))
            used += left
        if used == tier:
            windows.append((tier, pieces))
        else:
            windows += _cascade(pieces, used, max_len, min_len)
    return windows


def _cascade(pieces: list[tuple], used: int, max_len: int, min_len: int) -> list[tuple[int, list[tuple]]]:
    """The last, open window as full windows of shorter tiers and one that is padded."""
    windows, rest = [], list(reversed(pieces))
    while used:
        tier = 1 << (used.bit_length() - 1)
        take, out = (tier, []) if tier >= min_len else (used, [])
        used -= take
        tier = tier if tier >= min_len else max_len
        while take:
            doc, start, n = rest.pop()
            if n > take:
                rest.append((doc, start + take, n - take))
                n = take
            out.append((doc, start, n))
            take -= n
        windows.append((tier, out))
    return windows


def step_groups(windows: list[tuple[int, list[tuple]]], step_tokens: int) -> list[int]:
    """A group for each window: ``step_tokens`` of one tier, with pieces spread evenly."""
    groups, first = [0] * len(windows), 0
    for tier in sorted({t for t, _ in windows}, reverse=True):
        own = sorted((i for i, w in enumerate(windows) if w[0] == tier), key=lambda i: -len(windows[i][1]))
        n = -(-len(own) // max(1, step_tokens // tier))
        for k, i in enumerate(own):
            groups[i] = first + (k % n if k // n % 2 == 0 else n - 1 - k % n)
        first += n
    return groups


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
         end_id: int = 2, max_len: int = 4096, min_len: int = 256, step_tokens: int = 131_072,
         block_tokens: int = 8_000_000) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    tier, step_group``.

    ``sequence_id`` and ``step_group`` hold the partition in their upper bits.
    ``start`` counts the tokens of the document before the piece.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(it):
        enc, base = encoder(tokenizer_path), TaskContext.get().partitionId() << 36
        n_seq = n_step = held = 0
        block: list[tuple] = []

        def flush():
            nonlocal n_seq, n_step
            block.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
            windows = pack_block([len(ids) // 4 for _, ids in block], max_len, min_len)
            groups = step_groups(windows, step_tokens)
            for (tier, pieces), group in zip(windows, groups, strict=True):
                offset = 0
                for doc, start, n in pieces:
                    doc_id, ids = block[doc]
                    yield (doc_id, start, n, zlib.crc32(memoryview(ids)[4 * start:4 * (start + n)]), len(ids) // 4,
                           base + n_seq, offset, tier, base + n_step + group)
                    offset += n
                n_seq += 1
            n_step += max(groups, default=-1) + 1
            block.clear()

        for batch in it:
            for doc_ids, some in _portions(batch):
                for doc_id, ids in zip(doc_ids, enc.encode_all(some), strict=True):
                    block.append((doc_id, ids + end))
                    held += len(ids) // 4 + 1
                    if held >= block_tokens:
                        yield from flush()
                        held = 0
        yield from flush()

    return map_rows(id_text(docs, id_col, text_col), run, SCHEMA)
