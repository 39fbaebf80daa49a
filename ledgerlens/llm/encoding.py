"""Word-memoised encoding with a public tokenizer file: the same ids as encoding whole texts, at a fraction of the work.

The tokenizer's pre-splitting never joins characters over white space, so a text's ids are those of its
white-space-separated words, one after another. Arrow splits a part of the texts and numbers its different words;
only these are looked up, and only unknown ones are encoded. Worker processes keep a bounded memo from word to ids.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerlens.llm.memos import memo

#: Most words that a worker remembers; later ones are encoded as they come.
MEMO_WORDS = 300_000
#: Rows and about the bytes of text that are encoded at once, and words that the library gets in one call.
PART_ROWS, PART_BYTES, CALL_WORDS = 1000, 2 << 20, 4000
#: Signs that, at a word's end, the pre-splitting parts from its letters (an apostrophe may not be).
_SIGNS = ".,!?;:#$%&*|)"
#: Words of letters that stay single letters when normalised (the capital I with a dot doesn't, nor do some of other scripts).
_LETTERS = "^[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+$"
_ODD = "<\\||[\u0300-\u036f]"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITS = ["'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"]


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a ``text`` column: ``PART_ROWS`` at most, cut where ``PART_BYTES`` of text are reached."""
    at, ends = 0, np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    while at < batch.num_rows:
        last = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES)) + 1
        n = min(last - at, PART_ROWS)
        yield batch.slice(at, n)
        at += n


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    Texts with a special token's opening ``<|`` or with combining marks take the library's plain path, as
    lowering them beforehand could change what it sees; so does a tokenizer that isn't known to split at white space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {b"": b""}
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        normalizer, pre = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}
        splits = [(x.get("pattern") or {}).get("Regex") for x in pre.get("pretokenizers", []) if x["type"] != "ByteLevel"]
        self.by_words = file["model"]["type"] == "BPE" and normalizer.get("normalizers") == _NORMALIZERS and splits == _SPLITS and not file.get("post_processor")
        #: For the known kind, by id, whether the token ends a word; and the same model for lower-case letter words alone.
        self.final = self.letters = None
        if self.by_words:
            self.tokenizer.model._resize_cache(0)
            suffix = self.tokenizer.model.end_of_word_suffix
            if suffix:
                vocabulary = self.tokenizer.get_vocab()
                self.final = np.zeros(max(vocabulary.values()) + 1, bool)
                self.final[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
                self.letters = Tokenizer(self.tokenizer.model)
                self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _plain(self, some: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def _learn(self, words: pa.Array) -> Iterator[bytes]:
        """The ids of words that the memo doesn't have, in their order."""
        is_letters = pc.match_substring_regex(words, _LETTERS).to_numpy(zero_copy_only=False)
        some, out = words.to_numpy(zero_copy_only=False), np.empty(len(words), object)
        for kind in (is_letters, ~is_letters):
            at = np.flatnonzero(kind)
            for call in np.split(at, range(CALL_WORDS, len(at), CALL_WORDS)):
                ordered = some[call].tolist()
                if kind is is_letters and self.letters is not None:  # one text of all; each ends with its only word-end token
                    ids = np.asarray(self.letters.encode_batch_fast([" ".join(ordered).lower()], add_special_tokens=False)[0].ids, dtype="<u4")
                    ends = np.flatnonzero(self.final[ids]) + 1 if len(ids) else ids
                    if len(ends) == len(ordered):
                        raw, ends = ids.tobytes(), (4 * ends).tolist()
                        out[call] = [raw[a:z] for a, z in zip([0, *ends], ends)]
                        continue
                out[call] = self._plain(ordered)
        return iter(out)

    def _known(self, words: pa.Array) -> list[bytes]:
        """The ids of different words; the new ones are remembered while there is room."""
        known = self.memo
        keys = words.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(known.get, keys))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            for i, ids in zip(missing, self._learn(words.take(pa.array(missing, pa.int64())))):
                found[i] = ids
            known.update((keys[i], found[i]) for i in islice(missing, max(MEMO_WORDS - len(known), 0)))
        return found

    def _words(self, words: pa.Array) -> list[bytes]:
        """The ids of different words, letters and the signs at their ends apart."""
        heads = pc.ascii_rtrim(words, _SIGNS)
        cut = pc.and_(pc.less(pc.binary_length(heads), pc.binary_length(words)), pc.match_substring_regex(heads, _LETTERS))
        stems = pc.if_else(cut, heads, words).dictionary_encode()
        ids = self._known(stems.dictionary)
        found = [ids[k] for k in stems.indices.to_numpy().tolist()]
        at = np.flatnonzero(cut.to_numpy(zero_copy_only=False)).tolist()
        if at:
            tails = pa.array([w[len(h) :] for w, h in zip(words.filter(cut).to_numpy(zero_copy_only=False), heads.filter(cut).to_numpy(zero_copy_only=False))], pa.large_string()).dictionary_encode()
            ids = self._known(tails.dictionary)
            for i, k in zip(at, tails.indices.to_numpy().tolist()):
                found[i] += ids[k]
        return found

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's end."""
        # A copy from offset 0: in slices that were cast, ``ascii_lower`` (Arrow 23) takes the wrong bytes.
        texts = texts.cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
        odd = pc.match_substring_regex(texts, _ODD) if self.by_words else pa.array(np.ones(len(texts), bool))
        plain = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(plain):
            by_library = self._plain(texts.filter(odd).to_pylist())
            texts = pc.if_else(odd, pa.scalar("", pa.large_string()), texts)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words = lists.flatten().dictionary_encode()
        table = pa.array(self._words(words.dictionary), pa.large_binary())
        taken = table.take(words.indices)
        at = np.concatenate([[0], np.cumsum(pc.binary_length(taken).to_numpy(zero_copy_only=False), dtype=np.int64)]) // 4
        ids = np.frombuffer(taken.buffers()[2] or b"", "<u4", count=int(at[-1]))
        ends = at[np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)]
        if len(plain):
            more = [np.frombuffer(x, "<u4") for x in by_library]
            ids = np.insert(ids, np.repeat(ends[plain], [len(x) for x in more]), np.concatenate(more))
            n = np.diff(ends, prepend=0)
            n[plain] = [len(x) for x in more]
            ends = np.cumsum(n)
        return ids, ends

    def encode(self, some: list[str] | pa.Array) -> Iterator[bytes]:
        """The ids of each text, in order."""
        ids, ends = self.encode_column(some if isinstance(some, pa.Array) else pa.array(some, pa.large_string()))
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        return (raw[a:z] for a, z in zip([0, *ends], ends))


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a tokenizer file."""
    return memo("encoder", path, lambda: WordEncoder(path))
