"""Token ids of whole texts by a public tokenizer file, word by word through a cache.

Byte-pair encoding never merges across the pre-tokenizer's cuts, so a text's ids are the ids of
its words one after another. A worker keeps the ids of every word it has met and asks the
tokenizer only for new ones; texts of natural language repeat most of their words.

Cases: null and empty texts have no ids; texts that hold a special token are left to the tokenizer
as a whole; a text of any length is one list of words; a cache that grows past MAX_CACHED words
keeps those the current texts use and those met most often.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A lone space between two non-spaces opens a new pre-token in byte-level vocabularies and
# belongs to the word behind it. Longer runs of white space stay inside a piece.
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
PAIRS = ("  ", " \n", "\n ", "\n\n")
OTHER_SPACE = ("\t", "\v", "\f", "\r", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680",
               *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
# Bytes that are in no UTF-8 text: BETWEEN stands between two pieces, and BARE starts one that has
# no space before it.
BETWEEN, BARE = b"\xfe", b"\xff"
BETWEEN_SIGN, BARE_SIGN = (x.decode("utf-8", "surrogateescape") for x in (BETWEEN, BARE))
LINE_END = BETWEEN + BARE + b"\n" + BETWEEN + BARE
WORD_END = "</w>"
MAX_CACHED = 600_000  # words
JOINED = 200


def loose_space(text: str) -> bool:
    """Is there white space other than lone blanks and line ends inside the text?

    Plain substring searches: a regular expression takes as long as all the rest.
    """
    return (text[:1].isspace() or text[-1:].isspace() or any(p in text for p in PAIRS)
            or any(c in text for c in OTHER_SPACE))


class WordEncoder:
    """ids(texts) -> (flat ids, number of ids of each text); equal to encoding whole texts.

    spaced: True for vocabularies in which a space is part of the next word (byte-level BPE);
    False for those that drop white space.
    """

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the tokenizer cuts texts at these before anything else; texts with one are left to it
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.largest_id = max(vocabulary.values())
        self.spaced = spaced
        # what parts plain words of one call: byte-level tokens have a sign for each byte, others
        # say where a word ends (and each byte can end one, so that no word is without an end)
        self.share = np.zeros(self.largest_id + 1, "i8")
        self.share[list(vocabulary.values())] = [
            len(t) if spaced else t.endswith(WORD_END) for t in vocabulary]
        self.parted = spaced or sum(
            t.endswith(WORD_END) and len(t) == 1 + len(WORD_END) for t in vocabulary) == 256
        # stands between new words that are encoded in one call, and never merges with them
        self.mark, self.between = ("\n", "\n") if spaced else ("\ue000", " \ue000 ")
        self.unfit = re.compile(rf"\s|{self.mark}|^$").search
        self.sign = np.array(self.tokenizer.encode(self.mark, add_special_tokens=False).ids, "i4")
        found = {x: self.tokenizer.encode(x, add_special_tokens=False).ids for x in (",", ".")}
        self.stops = {x: np.array(ids, "i4").tobytes() for x, ids in found.items()
                      if len(ids) == 1}
        # row by row a cached word, its ids, and in how many groups of texts it was met
        self.words, self.table = _column([]), _rows(np.zeros(0, "i4"), np.zeros(0, "i8"))
        self.hits = np.zeros(0, "i4")

    def _shrink(self, at: np.ndarray) -> np.ndarray:
        """Keep the cached words that these places use again and, up to half of MAX_CACHED, those
        met in most groups; the new places."""
        half = MAX_CACHED // 2
        keep = self.hits > np.partition(self.hits, -half)[-half]
        keep[at[at >= 0]] = True
        kept = np.flatnonzero(keep)
        place = np.full(len(keep) + 1, -1, "i4")
        place[kept] = np.arange(len(kept), dtype="i4")
        self.words, self.table = self.words.take(pa.array(kept)), self.table.take(pa.array(kept))
        self.hits = self.hits[kept] // 2
        return place[at]  # -1 picks the last entry, which is -1

    def _places(self, words: pa.Array) -> np.ndarray:
        """Row of each of some different words in the cache, or -1."""
        # the table that Arrow makes is of the fewer ones
        found = pc.index_in(self.words, value_set=words).fill_null(-1).to_numpy()
        rows = np.flatnonzero(found >= 0)
        at = np.full(len(words), -1, "i4")
        at[found[rows]] = rows
        return at

    def _marked(self, text: str) -> bytes:
        """The words of a text with BETWEEN between them; one that has no space before it starts
        with BARE."""
        if not self.spaced:
            return text.encode().replace(b"\n", BETWEEN).replace(b" ", BETWEEN)
        if loose_space(text):
            return BARE + BETWEEN.join(w.encode() for w in LONE_SPACE.split(text))
        return BARE + text.encode().replace(b"\n", LINE_END).replace(b" ", BETWEEN)

    def _asked(self, words: list[str]) -> list[str]:
        if not self.spaced:
            return words
        return [w[1:] if w[:1] == BARE_SIGN else " " + w for w in words]

    def _is_plain(self, word: str) -> bool:
        """Does the word need no mark before the next one? With a space before it, or of letters
        only, so that it is one pre-token."""
        return self.parted and (word[:1] != BARE_SIGN if self.spaced else word.isalpha())

    def _plain(self, asked: list[str]) -> pa.Array:
        """The ids of many plain words, JOINED of them in one call."""
        blank = "" if self.spaced else " "
        found = self.tokenizer.encode_batch_fast(
            [blank.join(asked[k:k + JOINED]) for k in range(0, len(asked), JOINED)],
            add_special_tokens=False)
        flat: list[int] = []
        for e in found:
            flat += e.ids
        ids = np.array(flat, "i4")
        have = np.cumsum(self.share[ids])
        want = np.cumsum([len(w.encode()) for w in asked] if self.spaced else [1] * len(asked))
        ends = np.searchsorted(have, want) + 1
        if have[-1:].tolist() != want[-1:].tolist() or (have[ends - 1] != want).any():
            return self._encoded(asked)
        return _rows(ids, np.diff(ends, prepend=0))

    def _encoded(self, asked: list[str]) -> pa.Array:
        """The ids of many short strings, JOINED of them in one call, with a mark between them."""
        lots = [self.between.join(asked[k:k + JOINED]) for k in range(0, len(asked), JOINED)]
        found = self.tokenizer.encode_batch_fast(lots, add_special_tokens=False)
        flat, n = [], len(self.sign)
        for k, e in enumerate(found):
            flat += e.ids
            if k + 1 < len(found):
                flat += self.sign.tolist()
        ids = np.array(flat, "i4")
        hit = np.ones(max(0, len(ids) - n + 1), bool)
        for k in range(n):
            hit &= ids[k:len(hit) + k] == self.sign[k]
        at = np.flatnonzero(hit)
        if len(at) != len(asked) - 1:
            raise ValueError("a word holds the mark that stands between words")
        begins = np.concatenate([[0], at + n])
        sizes = np.concatenate([at, [len(ids)]]) - begins
        keep = np.ones(len(ids), bool)
        for k in range(n):
            keep[at + k] = False
        return _rows(ids[keep], sizes)

    def _ends_in_stop(self, word: str) -> bool:
        """Is there a comma or full stop at the end that is a pre-token of its own: behind a Latin
        letter or digit, before white space?"""
        last = word[-2:-1]
        return word[-1:] in self.stops and last < "\u0250" and last.isalnum()

    def _learn(self, words: list[str]) -> list[int]:
        """Put the words into the cache; their places."""
        ended = [w for w in words if self._ends_in_stop(w)]
        known, stems = set(ended), list(dict.fromkeys(w[:-1] for w in ended))
        place = {w: k for w, k in zip(stems, self._places(_column(stems)).tolist()) if k >= 0}
        fresh = list(dict.fromkeys([*(w for w in words if w not in known),
                                    *(w for w in stems if w not in place)]))
        # white space at a word's edge would merge with the mark, and nothing leaves two marks
        odd = set()
        if self.unfit("".join(fresh)) or "" in fresh or BARE_SIGN in fresh:
            odd.update(w for w in fresh if self.unfit(w) or w == BARE_SIGN)
            fresh = [w for w in fresh if w not in odd]
        plain = [w for w in fresh if self._is_plain(w)]
        held = set(plain)
        for lot, encoded in ((plain, self._plain),
                             ([w for w in fresh if w not in held], self._encoded),
                             (list(odd), self._each)):
            if lot:
                self._keep(place, lot, encoded(self._asked(lot)))
        if ended:  # a stem's ids and the stop's
            stop = pa.array([self.stops[w[-1]] for w in ended], pa.large_binary())
            at = pa.array([place[w[:-1]] for w in ended], pa.int32())
            self._keep(place, ended, pc.binary_join_element_wise(
                self.table.take(at), stop, pa.scalar(b"", pa.large_binary())))
        return list(map(place.__getitem__, words))

    def _keep(self, place: dict[str, int], words: list[str], ids: pa.Array) -> None:
        place.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self.words = pa.concat_arrays([self.words, _column(words)])
        self.table = pa.concat_arrays([self.table, ids])
        self.hits = np.append(self.hits, np.ones(len(words), "i4"))

    def _each(self, asked: list[str]) -> pa.Array:
        found = self.tokenizer.encode_batch_fast(asked, add_special_tokens=False)
        sizes = np.fromiter((len(e.ids) for e in found), "i8", len(found))
        return _rows(np.fromiter((i for e in found for i in e.ids), "i4", int(sizes.sum())), sizes)

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        whole = {k: self.tokenizer.encode(text, add_special_tokens=False).ids
                 for k, text in enumerate(texts)
                 if text and any(token in text for token in self.special)}
        if not whole:
            return self._by_words(texts)
        flat, sizes = self._by_words([None if k in whole else t for k, t in enumerate(texts)])
        own = np.split(flat, np.cumsum(sizes)[:-1])
        for k, ids in whole.items():
            own[k] = np.array(ids, "i4")
        return np.concatenate(own), np.array([len(x) for x in own], "i8")

    def _by_words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(texts), "i8")
        marked = []
        for k, text in enumerate(texts):
            if text:
                own = self._marked(text)
                counts[k] = own.count(BETWEEN) + 1
                marked.append(own)
        if not marked:
            return np.zeros(0, "i4"), counts
        # a group's words are told apart in Arrow; only different ones are looked up
        words = _split(BETWEEN.join(marked)).dictionary_encode()
        at = self._places(words.dictionary)
        if len(self.words) > MAX_CACHED:
            at = self._shrink(at)
        self.hits[at[at >= 0]] += 1
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self._learn(_strings(words.dictionary.take(pa.array(new))))
        rows = self.table.take(pa.array(at)).take(words.indices)
        upto = np.frombuffer(rows.buffers()[1], "i8")[rows.offset:][:len(rows) + 1] // 4
        flat = np.frombuffer(rows.buffers()[2] or b"", "i4")[upto[0]:upto[-1]]
        return flat, np.diff(upto[np.append(0, np.cumsum(counts))])


def _rows(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Ids as one row of bytes for each size."""
    ends = np.append(0, np.cumsum(sizes)).astype("i8") * 4
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [
        None, pa.py_buffer(ends), pa.py_buffer(ids.astype("i4", copy=False))])


def _split(data: bytes) -> pa.Array:
    return pc.split_pattern(pa.array([data], pa.large_binary()), BETWEEN).flatten()


def _column(words: list[str]) -> pa.Array:
    """Words as bytes, all at once: one by one takes several times as long."""
    if not words:
        return pa.array([], pa.large_binary())
    return _split(BETWEEN_SIGN.join(words).encode("utf-8", "surrogateescape"))


def _strings(words: pa.Array) -> list[str]:
    lists = pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words)
    joined = pc.binary_join(lists, pa.scalar(BETWEEN, pa.large_binary()))[0].as_py()
    return joined.decode("utf-8", "surrogateescape").split(BETWEEN_SIGN)


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    return WordEncoder(path, spaced)


def text_groups(texts: list[str | None], chars: int = 4_000_000):
    """(from, to) ranges of consecutive texts with about `chars` characters; one text at least."""
    begin, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text) if text else 0
        if held >= chars:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
