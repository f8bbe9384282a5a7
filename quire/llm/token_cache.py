"""Exact encoding of whole texts by a byte-level BPE, with each distinct stretch between spaces encoded once.

The pre-tokenisation pattern never lets a match cross a single space that stands between two other
non-space characters: such a space always opens a new match. So a text may be cut before each of these
spaces, the parts be encoded apart (from a cache, as parts recur), and their ids be joined: the result is that
of encoding the whole text.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import pairwise

import numpy as np

_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
#: White space other than U+0020 (fixed values: Unicode White_Space, and the separators that Python adds to it).
_OTHER_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word of Latin letters, on which all versions of Unicode agree, perhaps after a line end, and marks behind it.
_WORD = re.compile("(\n?)([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-/:-@\\[-`{-~]*)")
#: Parts in the cache from which on only those stay that the texts at hand have. Memory stays bounded; results don't depend on it.
LIMIT = 750_000
#: Characters of texts that are encoded together, about; a longer text stands alone.
TEXTS = 4_000_000
#: Parts longer than this are encoded each time.
LONGEST = 64


def parts(text: str) -> list[str]:
    """``text`` cut before spaces, and before line ends, that surely open a match; the parts after a space lack it."""
    if "  " not in text and not any(c in text and (c + " " in text or " " + c in text or c + "\n" in text or "\n" + c in text) for c in _OTHER_SPACE):
        return text.replace("\n", " \n").split(" ")
    return _BOUNDARY.split(text)


class CachedEncoder:
    """Encodes texts to little-endian uint32 bytes.

    ``one`` gives such bytes for a string, ``many`` for each of many parts as ``parts`` gives them; it may use, and add to, those known already.
    Without it every text is encoded as a whole. ``heads`` gives the bytes of the first parts of texts, together; without it ``one`` does.
    """

    def __init__(self, one: Callable[[str], bytes], many: Callable[[set[str], dict[str, bytes]], dict[str, bytes]] | None, heads: Callable[[list[str]], list[bytes]] | None = None, limit: int = LIMIT):
        self.one, self.many, self.new, self.limit = one, many, {}, limit
        self.heads = heads or (lambda texts: [one(t) for t in texts])

    def clear(self) -> None:
        self.new = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.many is None:
            return [self.one(t) for t in texts]
        cut = [parts(t) for t in texts]
        wanted: set[str] = set()
        for p in cut:
            wanted.update(p[1:])
        if len(self.new) > self.limit:
            self.new = {x: self.new[x] for x in wanted if x in self.new}
        new = self.new
        missing = wanted.difference(new)
        new.update(self.many(missing, new))
        get = new.__getitem__
        first = list({p[0] for p in cut})
        head = dict(zip(first, self.heads(first), strict=True))
        out = [head[p[0]] + b"".join(map(get, p[1:])) for p in cut]
        for x in [x for x in missing if len(x) > LONGEST]:
            del new[x]
        return out


def byte_letters() -> dict[int, str]:
    """The printable letters by which byte-level vocabularies write bytes.

    Fixed rule of the format: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards in order.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def library_encoder(path: str, special_as_text: bool = False, limit: int = LIMIT) -> CachedEncoder:
    """By the tokenizers library, from its JSON file. As by its default, a special token's string in a text gives that token's id, unless
    ``special_as_text``: then it is ordinary text.

    Where the file's pre-tokeniser is the plain byte-level one, words of Latin letters, which are one match with the space
    before them, go to the library in batches, one to a line; all else goes through it as it is.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text
    made = json.loads(tokenizer.to_str())
    pre, letters = made.get("pre_tokenizer") or {}, byte_letters()
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not made.get("normalizer")

    def one(text: str) -> bytes:
        return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    added = [] if special_as_text else made.get("added_tokens", [])
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].isalpha() or not t["content"].isprintable() or " " in t["content"] for t in added):
        return CachedEncoder(one, None)  # one might reach across parts, or be a word
    if not plain:
        return CachedEncoder(one, lambda words, known: {x: one(x if x[:1] == "\n" else " " + x) for x in words})
    by_line = Tokenizer.from_file(path)
    by_line.encode_special_tokens = True  # what goes there has letters only
    by_line.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    table = "".join("\n" if b == 10 else letters[b] for b in range(256))
    first = np.zeros(max(made["model"]["vocab"].values()) + 1, bool)
    first[[i for x, i in made["model"]["vocab"].items() if x[0] == letters[ord(" ")]]] = True
    newline, marks = one("\n"), {"": b""}

    def lines(words: list[str], space: str) -> list[bytes]:
        """Ids of words of letters, each with ``space`` (one or none) before it."""
        if not words:
            return []
        got = [codecs.charmap_decode((space + ("\n" + space).join(words[i : i + 500])).encode(), "strict", table)[0] for i in range(0, len(words), 500)]
        made = (by_line.encode_batch_fast if space else by_line.encode_batch)(got, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in made])
        if space:
            at = np.flatnonzero(first[ids])
        else:
            at = np.concatenate([np.array([1, *np.diff(e.word_ids)], bool) for e in made]).nonzero()[0]
        held = ids.tobytes()
        return [held[a:b] for a, b in pairwise([*(at * 4).tolist(), len(held)])]

    def many(words: set[str], known: dict[str, bytes]) -> dict[str, bytes]:
        """A word of letters is one match with the space before it; a line end before it, or marks behind it, are others."""
        found, marked, first_words, rest = [], [], [], []
        for x in words:
            if x.isascii() and x.isalpha():
                found.append(x)
            elif m := _WORD.fullmatch(x):
                line, stem, mark = m.groups()
                if line:
                    first_words.append((x, stem, mark))
                elif mark:
                    marked.append((x, stem, mark))
                else:
                    found.append(x)
            else:
                rest.append(x)
        stems = {stem for _, stem, _ in marked}.difference(known)
        stems.difference_update(found)
        found += stems
        out = dict(zip(found, lines(found, " "), strict=True))
        for mark in {m for _, _, m in marked + first_words}.difference(marks):
            if len(marks) > 10_000:
                marks.clear()
                marks[""] = b""
            marks[mark] = one(mark)
        for x, stem, mark in marked:
            out[x] = (out.get(stem) or known[stem]) + (marks.get(mark) or one(mark))
        for (x, _, mark), ids in zip(first_words, lines([w[1] for w in first_words], ""), strict=True):
            out[x] = newline + ids + ((marks.get(mark) or one(mark)) if mark else b"")
        got = tokenizer.encode_batch_fast([x if x[:1] == "\n" else " " + x for x in rest], add_special_tokens=False)
        out.update((x, array("I", e.ids).tobytes()) for x, e in zip(rest, got, strict=True))
        return out

    return CachedEncoder(one, many, limit=limit)


def tokenizer_path(name: str) -> str:
    """The default place of a public vocabulary file; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
