"""Token ids of whole texts, with one call of the tokenizer for each new word."""

from __future__ import annotations

import os
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
VOCABULARY = "word_bpe_49k.json"
# ASCII marks after the last letter of a word; not ">", which ends the names of special tokens.
_LAST_MARKS = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([!-/:-=?@\[-`{-~]+)(\s|$)"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts under a tokenizer that drops white space and marks the last id of a run of letters.

    Such a tokenizer never joins characters across white space, so a text's ids are those of its words in turn. Words
    met before are looked up; beyond ``known_limit`` words those that came up only once are forgotten, which bounds
    memory and changes no result.
    """

    AT_ONCE = 500

    def __init__(self, path: str, known_limit: int = 400_000, longest_known: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        size = self._tokenizer.get_vocab_size()
        self._closes = np.array([(self._tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self._known_limit = known_limit
        self._longest_known = longest_known
        self._row: dict[str, int] = {}
        self._lengths = np.zeros(0, np.int64)
        self._uses = np.zeros(0, np.int32)
        self._ids = np.zeros(0, np.uint32)

    def _forget(self) -> None:
        keep = self._uses > 1
        if 2 * keep.sum() > self._known_limit:
            keep[:] = False
        at = np.cumsum(keep) - 1
        self._row = {w: int(at[r]) for w, r in self._row.items() if keep[r]}
        self._ids = self._ids[np.repeat(keep, self._lengths)]
        self._lengths = self._lengths[keep]
        self._uses = np.ones(len(self._lengths), np.int32)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, many in one text: each ends at its closing id, or the words are encoded singly."""
        ids, lengths = [], []
        groups = [words[a : a + self.AT_ONCE] for a in range(0, len(words), self.AT_ONCE)]
        texts = [" ".join(g) for g in groups]
        for group, encoding in zip(groups, self._tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            own = np.array(encoding.ids, np.uint32)
            ends = np.flatnonzero(self._closes[own]) + 1
            if len(ends) == len(group) and ends[-1] == len(own):
                own_lengths = np.diff(ends, prepend=0)
            else:
                own, own_lengths = self._each(group)
            ids.append(own)
            lengths.append(own_lengths)
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty.astype(np.uint32), *ids]), np.concatenate([empty, *lengths])

    def _rows(self, words: list[str]) -> np.ndarray:
        if len(self._lengths) > self._known_limit:
            self._forget()
        rows = np.fromiter(map(self._row.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(rows < 0).tolist()
        plain = [i for i in new if words[i].isalpha()]
        other = [i for i in new if not words[i].isalpha()]
        for at, encode in ((plain, self._letters), (other, self._each)):
            fresh = [words[i] for i in at]
            ids, lengths = encode(fresh)
            first = len(self._lengths)
            rows[at] = first + np.arange(len(at))
            self._row.update((w, r) for r, w in enumerate(fresh, first) if len(w) <= self._longest_known)
            self._lengths = np.concatenate([self._lengths, lengths])
            self._uses = np.concatenate([self._uses, np.zeros(len(lengths), np.int32)])
            self._ids = np.concatenate([self._ids, ids])
        self._uses[rows] += 1
        return rows

    def encode(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array and the bounds of each text in it; ``end_id`` closes every text."""
        # The tokenizer lower-cases, except for special tokens. Marks that end a word are a word of their own to it, if
        # the letter before stays a letter (some beyond Latin-1 become a letter and a mark, which would join them).
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _LAST_MARKS, r"\1 \2\3"))
        bounds = split.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = pc.dictionary_encode(split.flatten())
        rows = self._rows(coded.dictionary.to_pylist())
        # One row more closes texts: it stands behind the known words, and each text ends with it.
        ids = np.append(self._ids, np.uint32(end_id))
        lengths = np.append(self._lengths, 1)
        words = rows[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
        words = np.insert(words, bounds[1:], len(lengths) - 1)
        own = lengths[words]
        ends = np.concatenate([[0], np.cumsum(own)])
        starts = (np.cumsum(lengths) - lengths)[words] - ends[:-1]
        place = np.repeat(starts.astype(np.int32), own)  # far fewer than 2^31 ids are known or in a block
        place += np.arange(len(place), dtype=np.int32)
        return ids[place], ends[bounds + np.arange(len(bounds))]


@cache
def encoder(path: str | None = None) -> WordEncoder:
    """The encoder of this Python process; later tasks of the process know the words of earlier ones."""
    return WordEncoder(path or vocabulary_path())
