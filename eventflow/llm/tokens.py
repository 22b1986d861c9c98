"""Batch encoding with a word memory, for token counts and packing.

A tokenizer splits text before it merges; where that split always falls, a text can be cut and its parts encoded alone.  Such
safe boundaries also let a batch encode each distinct part once, however often it occurs.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMORY = 700_000  # distinct words a worker remembers (under 200 MB); beyond that it starts anew
NUMBERED = 600_000  # the same for an encoder, below the size at which its dictionary doubles
BATCH_BYTES = 1 << 20  # text encoded at a time
CALL_BYTES = 1 << 15  # words that an encoder sends at a time; the library needs a multiple of that
HUGE = 1 << 44  # count of a part that must not stand alone
ODD_SPACE = "\u180e\u200b\ufeff"  # space to some Unicode versions

def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def by_bytes(texts: Iterable[str], limit: int = BATCH_BYTES) -> Iterable[list[str]]:
    """Consecutive texts in lists of about `limit` characters; a longer text is alone."""
    batch, size = [], 0
    for text in texts:
        if batch and size + len(text) > limit:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += len(text)
    if batch:
        yield batch


class Counter:
    """Token counts with a byte-level tokenizer whose pattern gives a space to the word behind it.

    A blank after a character that is no space is a safe boundary: no match of the pattern goes over it, and none begins or
    ends otherwise because of what is on its other side.  So texts are cut there, and parts other than the first begin with
    that blank.  Where a blank follows other space, the parts are joined again.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}

    def _encode(self, parts: list[str]) -> list[int]:
        return [len(e) for group in by_bytes(parts) for e in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]

    def _learn(self, memory: dict[str, int], words: set[str], blank: str) -> None:
        if len(memory) > MEMORY:
            memory.clear()
        new = [w for w in words if w not in memory]
        memory.update(zip(new, self._encode([blank + w for w in new])))
        memory.update((w, HUGE) for w in new if not w or w[-1].isspace() or w[-1] in ODD_SPACE)

    def _joined(self, words: list[str]) -> int:
        parts = []
        for w in words:
            if parts and not (parts[-1].strip(" ") and not parts[-1][-1].isspace() and parts[-1][-1] not in ODD_SPACE):
                parts[-1] += " " + w
            else:
                parts.append(" " + w if parts else w)
        return sum(self._encode(parts))

    def count(self, texts: list[str]) -> list[int]:
        split = [t.split(" ") for t in texts]
        self._learn(self.first, {w[0] for w in split}, "")
        self._learn(self.later, set().union(*(w[1:] for w in split)), " ")
        out = []
        for text, words in zip(texts, split):
            if len(words) == 1:
                n = self._encode([text])[0] if text else 0
            else:
                n = self.first[words[0]] + sum(map(self.later.__getitem__, words[1:]))
            out.append(self._joined(words) if n >= HUGE else n)
        return out


#: Letters that are lower case, one code point and composed, then punctuation: a word tokenizer always splits between the two.
PLAIN = "^(?P<stem>[a-z\u00df-\u00f6\u00f8-\u00ff]+)(?P<rest>[-!#$%&()*+,./:;=?@_{}~\"]*)$"


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


def lowered(text: str) -> str:
    """Lower case, which is all that such a tokenizer sees, where it goes by character and no control string can be in the text."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class Encoder:
    """Token ids with a tokenizer that drops space and case and merges only within words: any blank is a safe boundary.

    Words are remembered by their number.  Plain ones are letters and punctuation behind them; many of these go to the
    tokenizer's model in one call, which tells by the mark on last tokens where each ends.  All others are encoded whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        self.suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if self.suffix:
            from tokenizers import Tokenizer, pre_tokenizers
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            self.letters = byte_letters() | {ord(" "): " "}
            vocabulary = self.model.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(self.suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}  # of words, in `starts` and `lengths`
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain words, with a blank between letters and punctuation."""
        joined = " ".join(words).encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        pieces = np.fromiter((1 + (" " in w) for w in words), np.int64, len(words)).cumsum()
        if len(ends) != pieces[-1] or ends[-1] != len(ids):  # a vocabulary that lacks a letter, or the mark
            return self._whole([w.replace(" ", "") for w in words])
        return ids, np.diff(ends[pieces - 1], prepend=0)

    def _add(self, ids: np.ndarray, sizes: np.ndarray, first: int) -> None:
        self.flat = _room(self.flat, self.used + len(ids))
        self.starts, self.lengths = _room(self.starts, first + len(sizes)), _room(self.lengths, first + len(sizes))
        self.flat[self.used:self.used + len(ids)] = ids
        self.lengths[first:first + len(sizes)] = sizes
        self.starts[first:first + len(sizes)] = self.used + sizes.cumsum() - sizes
        self.used += len(ids)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """The places of the words, which are distinct."""
        names, known = _strings(words), len(self.place)
        at = np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        fresh = words.take(pa.array(new))
        cut = pc.extract_regex(fresh, PLAIN)
        plain = cut.is_valid().to_numpy(zero_copy_only=False) if self.suffix else np.zeros(len(fresh), bool)
        stem, rest = (part.filter(pa.array(plain)) for part in cut.flatten())
        both = pc.if_else(pc.equal(rest, ""), stem, pc.binary_join_element_wise(stem, rest, " "))
        first = known
        for encode, kind in ((self._plain, both), (self._whole, fresh.filter(pa.array(~plain)))):
            for group in by_bytes(_strings(kind), CALL_BYTES):
                self._add(*encode(group), first)
                first += len(group)
        new = np.concatenate([new[plain], new[~plain]])
        at[new] = np.arange(known, first)
        self.place.update((names[k], p) for k, p in zip(new.tolist(), range(known, first)))
        return at

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.place) > NUMBERED:
            self._forget()
        if not texts:
            return []
        # words are Python strings once for all these texts, however often they occur
        split = pc.split_pattern(pa.array([lowered(t).replace("\n", " ") for t in texts], pa.string()), " ")
        words = split.flatten().dictionary_encode()
        at = self._learn(words.dictionary)[words.indices.to_numpy()]
        n = self.lengths[at]
        ends = n.cumsum()
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[at] - ends + n, n)]
        # each text has a word, if an empty one
        return np.split(ids, ends[split.offsets.to_numpy()[1:-1] - 1])


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array with room for `size` entries, doubled as often as needed."""
    grown = len(array)
    while grown < size:
        grown *= 2
    return array if grown == len(array) else np.concatenate([array, np.empty(grown - len(array), array.dtype)])
