"""Token counts of a byte-level BPE by the whole-token shortcut.

Offline, each string of the vocabulary is encoded alone; those that give just themselves make up the set of whole tokens. A text is cut
into pre-tokens, in any script; one that is a whole token counts 1 with no merge, and only the rest is merged. A text's words repeat, so
that the counts of short stretches between single blanks are remembered in a table of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tidemark.llm.common import map_texts

#: The white space and the split pattern of the byte-level pre-tokenizer.
WHITE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

#: Stretches that a worker remembers (some 170 bytes each); the table is emptied when it is full.
REMEMBERED = 1_000_000
LONGEST_REMEMBERED = 64


class IrregularSpace(Exception):
    """A stretch that isn't bounded by single blanks or line ends."""


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
    return [letters[b] for b in range(256)]


class WholeTokenCounter:
    """Counts tokens as the library does for a byte-level BPE file, with no special tokens added."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.letters = byte_letters()
        self.pieces = regex.compile(PATTERN).findall
        self.stretches = regex.compile(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))).split if self.special else None
        self.merge = self.library.model.tokenize
        self.cut = self.library.pre_tokenizer.pre_tokenize_str
        self.written = self.prove()
        back = {c: b for b, c in enumerate(self.letters)}
        self.whole = frozenset(bytes(back[c] for c in w).decode() for w in self.written)
        self.first = Remembered(lambda s: self.of_stretch(s))
        self.inner = Remembered(self._inner)

    def prove(self) -> frozenset[str]:
        """The strings of the vocabulary, as it writes them, that are one pre-token and encode alone as one token."""
        back = {c: b for b, c in enumerate(self.letters)}
        found = []
        for written, number in self.library.get_vocab(with_added_tokens=False).items():
            try:
                text = bytes(back[c] for c in written).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if self.pieces(text) == [text] and len(self.cut(text)) == 1 and [t.id for t in self.merge(written)] == [number]:
                found.append(written)
        return frozenset(found)

    def of_stretch(self, text: str) -> int:
        """Tokens of a text that holds no special token and that the split pattern may cut on both sides."""
        n = 0
        if not text.isascii() and max(text) > "\u024f":  # the class of a letter may differ between Unicode versions: the library's pre-tokens
            written = self.written
            for piece, _ in self.cut(text):
                n += 1 if piece in written else len(self.merge(piece))
            return n
        whole = self.whole
        for piece in self.pieces(text):
            n += 1 if piece in whole else len(self.merge("".join(map(self.letters.__getitem__, piece.encode()))))
        return n

    def _inner(self, stretch: str) -> int:
        line = stretch[:1] == "\n"
        bare = stretch[1:] if line else stretch
        if not bare or bare != bare.strip():
            raise IrregularSpace
        return self.of_stretch(stretch if line else " " + stretch)

    def plain(self, text: str) -> int:
        """Tokens of a text without special tokens."""
        if not text:
            return 0
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            if not first or first != first.strip():
                raise IrregularSpace
            return self.first[first] + sum(map(self.inner.__getitem__, rest))
        except IrregularSpace:  # cut after all other than white space that white space follows; no pre-token spans such a place
            return sum(map(self.first.__getitem__, self.stretches(text)))

    def __call__(self, text: str) -> int:
        if self.split_special and any(s in text for s in self.special):
            parts = self.split_special(text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)


class Remembered(dict):
    """A table of bounded size of a function's values."""

    def __init__(self, f: Callable, most: int = REMEMBERED):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, key):
        value = self.f(key)
        if len(key) <= LONGEST_REMEMBERED:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


_counters: dict[str, WholeTokenCounter] = {}


def counter(path: str) -> WholeTokenCounter:
    """One counter a worker process."""
    if path not in _counters:
        _counters[path] = WholeTokenCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """Tokens of each whole text, as the library counts them.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids are kept as they are; other columns are not looked at.
    Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).
    """

    def make():
        count = counter(tokenizer_path)
        return lambda texts: [(len(t.encode()), n := count(t), n > limit) for t in texts]

    return map_texts(docs, make, "n_bytes long, n_tokens long, over_limit boolean")
