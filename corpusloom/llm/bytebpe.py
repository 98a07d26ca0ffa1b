"""Splitting texts for a byte-level BPE vocabulary, and encoding of distinct words.

A word is what the vocabulary's pre-tokenizer calls one piece; BPE never merges across pieces, so a text's ids are the
ids of its words in order.  Splitting is done over whole batches of code points in numpy.  Texts with code points
outside the tables below, or with the special token's string, go through the tokenizers library's own splitter.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

OTHER, LETTER, NUMBER, SPACE, UNKNOWN = range(5)
#: Code points whose class is the same in all versions of Unicode that the libraries may use.
KNOWN = [range(0x0, 0x250), range(0x2010, 0x2028), range(0x2030, 0x205F)]
SPACES = [*range(9, 14), 32, 0x85, 0xA0]
#: Words per joined call of the library.
JOINED = 2000


@cache
def classes() -> np.ndarray:
    """Class of each code point below 0x2060; the last entry stands for all above."""
    table = np.full(0x2061, UNKNOWN, np.uint8)
    for cp in (cp for r in KNOWN for cp in r):
        kind = unicodedata.category(chr(cp))[0]
        table[cp] = SPACE if cp in SPACES else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    return table


@cache
def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def specials(path: str) -> list[str]:
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def word_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which code points begin a word.  ``first`` marks the first code point of each text.

    Runs of letters, numbers and other signs are words, with the blank before them when it is a plain one; of a run of white space the
    last sign stands alone unless it is such a blank; an apostrophe that begins a word takes s, t, m, d, re, ve or ll along.
    """
    c = classes()[np.minimum(cp, 0x2060)]
    n = len(cp)
    start = first.copy()
    start[1:] |= c[1:] != c[:-1]
    space = c == SPACE
    ends = np.flatnonzero(~space[1:] & space[:-1] & ~first[1:]) + 1
    start[ends - 1] = True
    start[ends[cp[ends - 1] == 32]] = False
    q = np.flatnonzero((cp == 39) & start)
    q = q[q + 1 < n]
    q = q[(c[q + 1] == LETTER) & ~first[q + 1]]
    if len(q):
        pad = np.concatenate([cp, np.zeros(2, cp.dtype)])
        edge = np.concatenate([first, np.ones(2, bool)])
        a, b = pad[q + 1], pad[q + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ~edge[q + 2] & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        start[q[one | two] + 1] = False
        after = np.concatenate([q[one] + 2, q[two] + 3])
        start[after[after < n]] = True
    return start


class Numbered(dict):
    """Gives each new word the next number."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def library_words(text: str, special: list[str]) -> list[str]:
    """The words of one text as the tokenizers library splits it; special tokens are words of their own."""
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    parts = [text]
    for s in special:
        parts = [y for x in parts for y in (_around(x, s) if x not in special else [x])]
    return [w for part in parts for w in ([part] if part in special else [part[a:b] for _, (a, b) in split.pre_tokenize_str(part)])]


def _around(text: str, special: str) -> list[str]:
    found = []
    for k, x in enumerate(text.split(special)):
        found += [special] * (k > 0) + [x] * bool(x)
    return found


def numbered_words(texts: list[str], numbers: Numbered, special: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of the texts in order, and the count of words per text."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(length)
    unknown = np.concatenate([[0], np.cumsum(classes()[np.minimum(cp, 0x2060)] == UNKNOWN)])
    slow = unknown[ends] - unknown[ends - length] > 0
    for s in special:
        slow |= np.fromiter((s in t for t in texts), bool, len(texts))
    codes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    if not slow.any():
        plain = cp
    else:
        plain = cp[~np.repeat(slow, length)]
    kept = np.flatnonzero(~slow & (length > 0))
    fast_codes = np.zeros(0, np.int32)
    if len(kept):
        first = np.zeros(len(plain), bool)
        at = np.cumsum(length[kept]) - length[kept]
        first[at] = True
        begin = np.flatnonzero(word_starts(plain, first))
        text = "".join([texts[i] for i in kept]) if slow.any() else "".join(texts)
        cuts = begin.tolist()
        fast_codes = np.fromiter(map(numbers.__getitem__, [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]), np.int32, len(cuts))
        counts[kept] = np.diff(np.searchsorted(begin, np.append(at, len(plain))))
    if not slow.any():
        return fast_codes, counts
    done = 0
    for i, is_slow in enumerate(slow.tolist()):
        if is_slow:
            words = library_words(texts[i], special)
            codes.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
            counts[i] = len(words)
        else:
            codes.append(fast_codes[done:done + counts[i]])
            done += counts[i]
    return np.concatenate(codes), counts


def encode_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words one after the other (uint32), and the count per word.

    Many words go into one call of the library, joined so that it splits them again: words of a blank and letters as they are, others
    but white space after a line end, whose own id is taken out.  A joined call that does not come back with the expected pieces is done over word by word.
    """
    t = tokenizer(path)
    special = specials(path)
    kind = np.fromiter((0 if w[0] == " " and w[1:].isalpha() else 2 if w.isspace() or w in special else 1 for w in words), np.int8, len(words))
    order, found, counts = [], [], []
    alone = np.flatnonzero(kind == 2).tolist()
    for k, (before, pieces_) in enumerate((("", 1), ("\n", 2))):
        chosen = np.flatnonzero(kind == k).tolist()
        for start in range(0, len(chosen), JOINED):
            part = chosen[start:start + JOINED]
            e = t.encode(before + before.join([words[i] for i in part]), add_special_tokens=False)
            of = np.array(e.word_ids, np.int64)
            n = np.bincount(of)
            if len(n) != pieces_ * len(part):
                alone += part
                continue
            order += part
            found.append(np.array(e.ids, np.uint32)[of % pieces_ == pieces_ - 1])
            counts.append(n[pieces_ - 1::pieces_])
    if alone:
        got = [e.ids for e in t.encode_batch_fast([words[i] for i in alone], add_special_tokens=False)]
        order += alone
        counts.append(np.fromiter(map(len, got), np.int64, len(got)))
        found.append(np.fromiter((x for y in got for x in y), np.uint32, int(counts[-1].sum())))
    if not order:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    n, where = np.concatenate(counts), np.empty(len(words), np.int64)
    where[order] = np.arange(len(words))
    return gather(np.concatenate(found), np.cumsum(n) - n, n, where), n[where]


def gather(flat: np.ndarray, begin: np.ndarray, count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The runs flat[begin[i]:begin[i] + count[i]] for each i of ``of``, joined."""
    n = count[of]
    ends = np.cumsum(n)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(begin[of] - (ends - n), n) + np.arange(ends[-1])]


@cache
def pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vocabulary's bytes by id: all bytes, and begin and count per id.  One row per id, so its size is fixed."""
    t = tokenizer(path)
    table = {c: b for b, c in enumerate(_byte_signs())}
    vocabulary = t.get_vocab(with_added_tokens=True)
    parts = [b""] * (max(vocabulary.values()) + 1)
    added = {x.content for x in t.get_added_tokens_decoder().values()}
    for piece, i in vocabulary.items():
        parts[i] = piece.encode() if piece in added else bytes(table[c] for c in piece)
    count = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(count) - count, count


def _byte_signs() -> list[str]:
    """The printable sign that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in own else next(other)) for b in range(256)]


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """The bytes of the ids' pieces in order."""
    return gather(*pieces(path), ids).tobytes()
