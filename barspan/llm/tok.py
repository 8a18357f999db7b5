"""Whole texts to token ids through the tokenizers library, each distinct word once."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from barspan.llm import common

#: End id appended to each document.
END_ID = 2
#: Words whose ids a worker keeps at once, in each of two generations: bounds its memory.
CACHED_WORDS = 250_000
#: The vocabulary's first control token: parts the words that go to the library in one call.
MARK = "<|startoftext|>"
#: A letter, then marks that end a word: always two pieces of the vocabulary's splitting rule.
ENDING = r"([a-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([,.|!?:;#$%&*]+) "

#: Words that the vocabulary's normaliser leaves as they are and its splitting rule leaves whole.
PLAIN = r"^[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+$"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Known:
    """Words with their ids: the words in one array, their ids in a row. Holds the empty word from the start."""

    def __init__(self):
        self.words = pa.array([""], pa.large_string())
        self.counts, self.ids = np.zeros(1, np.int32), np.zeros(0, "<u4")

    def __len__(self) -> int:
        return len(self.words)

    def find(self, words: pa.Array) -> np.ndarray:
        """Number of each of these distinct words here, or -1. The table to look up in is made of the fewer words of one call."""
        there = pc.fill_null(pc.index_in(self.words, value_set=words), -1).to_numpy()
        hit = np.flatnonzero(there >= 0)
        at = np.full(len(words), -1, np.int32)
        at[there[hit]] = hit
        return at

    def starts(self) -> np.ndarray:
        return np.cumsum(self.counts, dtype=np.int32) - self.counts

    def add(self, words: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.counts = np.concatenate((self.counts, counts))
        self.ids = np.concatenate((self.ids, ids))

    def taken(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each of these words, all their ids in a row)."""
        counts = self.counts[at]
        return counts, self.ids[runs(self.starts()[at], counts)]


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, so many as its count."""
    ends = np.cumsum(counts, dtype=np.int32)
    at = np.repeat(starts - (ends - counts), counts)
    at += np.arange(len(at), dtype=np.int32)
    return at


class WordEncoder:
    """Ids of texts.

    The vocabulary's splitting rule never joins characters across a blank or line feed and drops
    both, and its normaliser lower-cases; so a text's ids are the ids of its words, A-Z lower-cased, in
    a row. Marks that end a word count as a word. Each distinct word is encoded by the library and kept.
    Texts that might hold a control token's string go to the library whole, as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        # The same model without the normaliser, parting words at blanks: for plain words, which come out alike and faster.
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.mark = self.library.token_to_id(MARK)
        self.ends = np.zeros(self.library.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[k for word, k in self.library.get_vocab().items() if word.endswith("</w>")]] = True
        self.now, self.old = Known(), Known()

    def alone(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the words' places in an order of its own, number of ids of each, all their ids in a row).

        Words of letters alone are one piece each, whose last id says so; others are parted by the control token.
        """
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        letters = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False) & ~plain
        rest, done = [np.flatnonzero(~(plain | letters))], [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4"))]
        for library, which in ((self.plain, plain), (self.library, letters)):
            for part, ids in self._together(library, words, np.flatnonzero(which), " "):
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) == len(part) and cuts[-1] == len(ids):
                    done.append((part, np.diff(cuts, prepend=0).astype(np.int32), ids))
                else:
                    rest.append(part)
        for part, ids in self._together(self.library, words, np.concatenate(rest), MARK):
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(part) - 1:
                raise ValueError("words and their ids do not agree")
            done.append((part, (np.diff(cuts, prepend=-1, append=len(ids)) - 1).astype(np.int32), ids[ids != self.mark]))
        return tuple(map(np.concatenate, zip(*done, strict=True)))

    def _together(self, library, words: pa.Array, which: np.ndarray, between: str):
        parts = [which[k : k + 1000] for k in range(0, len(which), 1000)]
        lists = pa.ListArray.from_arrays(pa.array([*range(0, len(which), 1000), len(which)], pa.int32()), words.take(pa.array(which)))
        found = library.encode_batch_fast(pc.binary_join(lists, pa.scalar(between, words.type)).to_pylist(), add_special_tokens=False) if parts else []
        return [(p, np.array(f.ids, dtype="<u4")) for p, f in zip(parts, found, strict=True)]

    def _words(self, words: pa.Array) -> np.ndarray:
        """The numbers of distinct words in ``now``, which holds all of them afterwards."""
        if len(self.now) > CACHED_WORDS:
            self.now, self.old = Known(), self.now
        at = self.now.find(words)
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return at
        lost = words.take(pa.array(missing))
        old = self.old.find(lost)
        again, new = np.flatnonzero(old >= 0), np.flatnonzero(old < 0)
        order, *learned = self._learn(lost.take(pa.array(new)))
        order = np.concatenate((again, new[order]))
        at[missing[order]] = len(self.now) + np.arange(len(order))
        self.now.add(lost.take(pa.array(order)), *map(np.concatenate, zip(self.old.taken(old[again]), learned, strict=True)))
        return at

    def rest(self) -> None:
        """Between tasks: the older words go, and free memory goes back to the machine."""
        self.old = Known()
        common.rest()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids in a row); null texts are empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        special = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        held = {int(k): self.alone(texts[int(k)].as_py()) for k in special}
        if held:
            texts = pc.if_else(pc.match_substring(texts, "<|"), pa.scalar("", pa.large_string()), texts)
        flat = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
        lists = pc.split_pattern(pc.replace_substring_regex(flat, ENDING, r"\1 \2 "), " ")
        coded = pc.dictionary_encode(lists.flatten())
        codes = coded.indices.to_numpy()
        word = self._words(coded.dictionary)[codes]
        each = self.now.counts[word]
        ids = self.now.ids[runs(self.now.starts()[word], each)]
        ends = np.concatenate(([0], np.cumsum(each, dtype=np.int64)))
        bounds = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        counts = np.diff(bounds)
        if held:
            parts = np.split(ids, bounds[1:-1])
            for k, own in held.items():
                parts[k], counts[k] = own, len(own)
            ids = np.concatenate(parts)
        return counts, ids


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One for each worker and vocabulary file."""
    return WordEncoder(path)


def in_parts(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """(first, length) of runs of texts with about so many bytes: bounds what is worked on at once."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) if len(texts) else np.zeros(0)
    start = 0
    while start < len(texts):
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + most)))
        yield start, min(end, len(texts)) - start
        start = end


def with_end(counts: np.ndarray, ids: np.ndarray, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each text's ids."""
    return counts + 1, np.insert(ids, np.cumsum(counts), end)
