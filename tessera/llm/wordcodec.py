"""Token ids by the tokenizers library, one white-space word at a time.

A tokenizer that collapses white space and keeps only the matches of its split pattern never lets a token cross
white space, and its NFC and lower-case steps work within a word. So a text's ids are those of its words joined, and
each distinct word meets the library once per worker. ``splits_at_space`` tells whether a tokenizer file is of that kind.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

#: Where a long text may be cut: the ASCII white space at which ``bytes.split`` cuts.
SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Bytes of words and ids that a worker remembers, and about how many an entry takes.
CACHE_BYTES, ENTRY_BYTES = 112 << 20, 224
CACHE_WORDS = CACHE_BYTES // ENTRY_BYTES
#: Bytes of text that are encoded together, and beyond which one text is cut.
SLICE_BYTES = 1 << 20


def splits_at_space(path: str) -> bool:
    spec = json.loads(open(path, encoding="utf-8").read())
    norms = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = steps[0] if steps else {}
    return set(norms) <= {"NFC", "Replace", "Lowercase"} and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and spec.get("post_processor") is None


#: Words of small letters a-z and U+00DF to U+00FF: composed, in lower case, and one match of a pattern that takes letters.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _byte_level() -> dict[int, int]:
    """Bytes to the characters that stand for them in byte-level vocabularies: printable ones themselves, the others from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(others)}


_BYTE_LEVEL = _byte_level()


def _letters_alone(path: str) -> bool:
    """Whether the split takes runs of letters as they are and then goes to bytes."""
    steps = json.loads(open(path, encoding="utf-8").read())["pre_tokenizer"]["pretokenizers"]
    last = steps[-1]
    return len(steps) == 2 and r"[\p{L}]+" in steps[0].get("pattern", {}).get("Regex", "") and last.get("type") == "ByteLevel" and not last.get("add_prefix_space") and not last.get("use_regex")


def cut(data: bytes, limit: int) -> Iterator[bytes]:
    """Pieces of about ``limit`` bytes that end at white space; a single longer word stays whole."""
    at = 0
    while len(data) - at > limit:
        m = SPACE.search(data, at + limit)
        if m is None:
            break
        yield data[at : m.start()]
        at = m.end()
    yield data[at:] if at else data


def by_bytes(texts: Iterable[str | None], limit: int = SLICE_BYTES) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` bytes; null is empty, and a longer text ends its run."""
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1]) if held[-1].isascii() else len(held[-1].encode())
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def library(path: str):
    """The tokenizer of a file, without truncation, padding or threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit bytes, for one worker process."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.library = library(path)
        self.known = _Known(self.library, splits_at_space(path) and _letters_alone(path), cache_words)

    def words(self, data: bytes) -> list[bytes]:
        # lower case first means fewer distinct words; not where it could make a special string
        return (data if b"<|" in data else data.lower()).split()

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text, in order; null is empty."""
        held: list[list[bytes]] = []
        size = 0
        for text in texts:
            data = (text or "").encode()
            if len(data) > SLICE_BYTES:
                yield from self._flush(held)
                held, size = [], 0
                yield b"".join(x for part in cut(data, SLICE_BYTES) for x in self._flush([self._checked(part, data)]))
                continue
            held.append(self.words(data))
            size += len(data)
            if size >= SLICE_BYTES:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _checked(self, part: bytes, whole: bytes) -> list[bytes]:
        return part.split() if b"<|" in whole else part.lower().split()

    def _flush(self, lists: list[list[bytes]]) -> Iterator[bytes]:
        if lists:
            get = self.known.__getitem__
            for words in lists:
                yield b"".join(map(get, words))


class _Known(dict):
    """Words to ids; a word that is new is encoded, and remembered while there is room."""

    def __init__(self, library, plain: bool, limit: int):
        super().__init__()
        self.library, self.model, self.plain, self.limit = library, library.model, plain, limit
        self.stops = {c: self._encode(c) for c in (b".", b",")}

    def __missing__(self, word: bytes) -> bytes:
        # a full stop or comma after an ASCII letter is a token of its own
        ids = self[word[:-1]] + self.stops[word[-1:]] if word[-1:] in self.stops and word[-2:-1].isalpha() else self._encode(word)
        if len(self) < self.limit and len(word) <= 64:
            self[word] = ids
        return ids

    def _encode(self, word: bytes) -> bytes:
        """Plain words need none of the library's steps before its model."""
        if self.plain and PLAIN.fullmatch(word):
            ids = [t.id for t in self.model.tokenize(word.decode("latin-1").translate(_BYTE_LEVEL))]
        else:
            ids = self.library.encode(word.decode(), add_special_tokens=False).ids
        return array.array("I", ids).tobytes()


_remembering: list = []


def remembered(f: Callable) -> Callable:
    """``f`` with its result kept by this worker until another stage releases it; one operator's at a time."""
    cached = functools.lru_cache(maxsize=1)(f)

    @functools.wraps(f)
    def get(*args):
        for other in _remembering:
            if other is not cached:
                other.cache_clear()
        return cached(*args)

    _remembering.append(cached)
    return get


def release_words() -> None:
    """Forgets what this worker remembers, which a stage that encodes nothing has no use for."""
    for cached in _remembering:
        cached.cache_clear()


@remembered
def worker_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
