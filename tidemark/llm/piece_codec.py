"""Encoding and decoding with a SentencePiece BPE model, by backtracking over longest matches.

An Aho-Corasick automaton finds the longest vocabulary piece at each place. Pieces are laid from left to right; a piece may follow another
only if merging their letters again would leave that boundary in place. If no piece can follow, the last one is taken back for a shorter
one, and a bit for the place says that no encoding passes it. The result is what merging by score gives. Pieces of blanks alone share one
score, below all others, and are merged from the left: a run of blanks is laid with its longest matches.

Words repeat, so the encoding of stretches that no piece of the vocabulary can cross is remembered in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import re

from pyspark.sql import DataFrame

from tidemark.llm.common import map_texts
from tidemark.llm.token_counts import Remembered

SPACE = "▁"


class PieceCodec:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("the model isn't a BPE with byte fallback, a dummy prefix and no text rules")
        if any(p.type == 4 for p in model.pieces):
            raise ValueError("user-defined pieces aren't supported")
        self.text = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        self.eos = next(i for i, p in enumerate(model.pieces) if p.piece == "</s>")
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.number = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        normal = [p for p in self.number if p.strip(SPACE) or len(p) == 1]  # pieces of blanks alone have their own rule, see _blanks
        #: A piece's rank: single letters first, then by falling score, the order in which merges are made.
        order = sorted(normal, key=lambda p: (len(p) > 1, -self.score[p], self.number[p]))
        self.rank = {p: r for r, p in enumerate(order)}
        self.order = order
        self.halves = [self._halves(p) for p in order]
        self.shorter = [self._shorter(p) for p in order]
        automaton = ahocorasick.Automaton()
        for r, p in enumerate(order):
            if len(p) == 1 or self.halves[r]:
                automaton.add_word(p, (len(p), r))
        automaton.make_automaton()
        self.matches, self.longest = automaton.iter, automaton.iter_long
        # Proved from the vocabulary: letters that stand next to each other in no piece are never in one token.
        self.neighbours = {p[i : i + 2] for p in self.number for i in range(len(p) - 1)}
        self.lines_apart = not any("\n" in p for p in self.number)
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in self.number)
        if not self.words_apart:
            raise ValueError("pieces of the model cross blanks")
        self.blanks = sorted((p for p in self.number if not p.strip(SPACE)), key=len, reverse=True)
        longest = len(self.blanks[0])
        last = max((self.score[p] for p in self.blanks if len(p) > 1), default=-1e30)
        if any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.number) or any(self.score[p] <= last for p in normal if len(p) > 1):
            raise ValueError("blanks aren't merged after all else")
        if any(self._blanks(n) != self._merge(SPACE * n) for n in range(1, 4 * longest)):  # it repeats after each longest piece
            raise ValueError("blanks aren't merged from the left")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.stretch = Remembered(self._stretch, 700_000)
        self.stable = Remembered(self._encode, 1 << 17)
        #: What stretches decode to if it isn't their own text.
        self.odd: dict[str, str] = {}
        self.runs = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def _halves(self, piece: str) -> tuple[int, int] | None:
        """The last merge that makes a piece out of its letters; none for a letter, or if merging never makes it."""
        if len(piece) == 1:
            return None
        parts = self._merge(piece, until=2)
        whole = self._merge("".join(parts))
        if len(parts) != 2 or whole != [piece]:
            return None
        a, b = parts
        return (self.rank[a], self.rank[b]) if a in self.rank and b in self.rank else None

    def _shorter(self, piece: str) -> int:
        """Rank of the longest piece that is a proper prefix; -1: none."""
        for n in range(len(piece) - 1, 0, -1):
            if (r := self.rank.get(piece[:n])) is not None and (n == 1 or self.halves[r]):
                return r
        return -1

    def _merge(self, text: str, until: int = 1) -> list[str]:
        """Merging by score from the left, with a queue; stops when ``until`` symbols are left."""
        part: list[str | None] = list(text)
        before, after = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        score, queue, left = self.score, [], len(part)

        def offer(i: int) -> None:
            j = after[i]
            if j < len(part) and (s := score.get(part[i] + part[j])) is not None:
                heapq.heappush(queue, (-s, i, part[i], part[j]))

        for i in range(len(part) - 1):
            offer(i)
        while queue and left > until:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if part[i] != a or j >= len(part) or part[j] != b:
                continue
            part[i], part[j], after[i] = a + b, None, after[j]
            if after[j] < len(part):
                before[after[j]] = i
            left -= 1
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in part if p is not None]

    def _blanks(self, n: int) -> list[str]:
        """A run of blanks: the longest pieces from the left."""
        parts = []
        for p in self.blanks:
            parts += [p] * (n // len(p))
            n %= len(p)
        return parts

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether merging the letters of two adjacent tokens again keeps them apart.

        Both are taken apart in the reverse order of their merges; at each step, a merge across the boundary that comes before the step
        just undone would have been made instead.
        """
        order, halves, rank = self.order, self.halves, self.rank
        most = len(order)
        while True:
            joined = rank.get(order[left] + order[right])
            if joined is not None and joined < most:
                return False
            undo_left = halves[left] is not None and (left > right or halves[right] is None)
            if undo_left:
                most, left = left, halves[left][1]
            elif halves[right] is not None:
                most, right = right + 1, halves[right][0]
            else:
                return True

    def _backtrack(self, text: str) -> list[int]:
        """Ranks of the tokens of a text whose letters are all in the vocabulary."""
        pairs = self.pairs
        tokens = [r for _, (_, r) in self.longest(text)]
        if all([pairs.get(p) for p in zip(tokens, tokens[1:])]) and sum([len(self.order[r]) for r in tokens]) == len(text):
            return tokens  # the longest matches from the left, all known to be compatible: nothing to take back
        n = len(text)
        longest = [-1] * n
        size = [0] * n
        for end, (length, r) in self.matches(text):
            start = end - length + 1
            if length > size[start]:
                size[start], longest[start] = length, r
        failed = bytearray(n + 1)  # places that no encoding of the rest passes
        tokens = []
        order, shorter = self.order, self.shorter
        at = 0
        token = longest[0] if n else -1
        while at < n:
            last = tokens[-1] if tokens else -1
            while token >= 0:
                end = at + len(order[token])
                if not failed[end]:
                    if last < 0:
                        break
                    ok = pairs.get((last, token))
                    if ok is None:
                        if len(pairs) > 1 << 18:
                            pairs.clear()
                        ok = pairs[last, token] = self._may_follow(last, token)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                failed[at] = 1
                if not tokens:
                    raise AssertionError(f"no encoding of {text!r}")
                token = tokens.pop()
                at -= len(order[token])
                token = shorter[token]
        return tokens

    def _encode(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch. Letters that aren't in the vocabulary stand alone, as their bytes."""
        run = len(text) - len(text.lstrip(SPACE))
        # Of several blanks the last one goes with the word if a merge takes it there, and else with the others.
        parts, known, rank = [], 0, self.rank
        if run > 1:
            text = text[run - 1 :]
        for i, c in enumerate(text):
            if c not in rank:
                if known < i:
                    parts += [self.order[r] for r in self._backtrack(text[known:i])]
                parts.append(c)
                known = i + 1
        if known < len(text):
            parts += [self.order[r] for r in self._backtrack(text[known:])]
        if run > 1:
            parts = self._blanks(run) + parts[1:] if parts[0] == SPACE else self._blanks(run - 1) + parts
        ids: list[int] = []
        for p in parts:
            if (i := self.number.get(p)) is not None:
                ids.append(i)
            else:
                ids += [self.byte[b] for b in p.encode()]
        return tuple(ids)

    def _stretch(self, text: str) -> str:
        """Ids as text of a stretch that no token crosses on either side. They are decoded; where that isn't the stretch itself, it is noted."""
        ids: list[int] = []
        begin = 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in self.neighbours:
                ids += self.stable[text[begin:i]]
                begin = i
        ids += self.stable[text[begin:]]
        if "".join(map(self.text.__getitem__, ids)) != text and (decoded := self.decode_pieces(ids)) != text.replace(SPACE, " "):
            self.odd[text] = decoded
        return " ".join(map(str, ids))

    def decode_pieces(self, ids: list[int]) -> str:
        """Text of ids, blanks in front kept."""
        out: list[bytes] = []
        for i in ids:
            if (b := self.of_byte.get(i)) is not None:
                out.append(bytes([b]))
            elif self.kind[i] == 1:
                out.append(self.text[i].encode())
        return b"".join(out).decode(errors="replace").replace(SPACE, " ")

    def stretches(self, text: str) -> list[str]:
        """The normalized text, cut where no token can cross."""
        whole = SPACE + text.replace(" ", SPACE)
        parts = self.runs(whole)
        if self.lines_apart and "\n" in text:
            parts = [x for p in parts for x in (re.split("(?=\n)", p) if "\n" in p else (p,)) if x]
        return parts

    def __call__(self, text: str) -> tuple[int, str, str]:
        """Number of ids with the end id, the ids as text, and the decoded text."""
        if not text:
            return 1, str(self.eos), ""
        if self.lines_apart and SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " " and " \n" not in text:
            found = (SPACE + text.replace("\n", " \n").replace(" ", " " + SPACE).replace(SPACE + "\n", "\n")).split(" ")
        else:
            found = self.stretches(text)
        ids = f"{' '.join(map(self.stretch.__getitem__, found))} {self.eos}"
        if self.odd and any(x in self.odd for x in found):
            decoded = "".join([self.odd.get(x, x) for x in found])
            decoded = decoded[1:] if decoded[:1] in (" ", SPACE) else decoded
        else:
            decoded = text
        return ids.count(" ") + 1, ids, decoded.replace(SPACE, " ")


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_texts(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """Encodes each whole text, and decodes from the ids, a stretch at a time: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` also ids and decoded.

    Null and empty texts are the end id alone, and decode to an empty text. Repeated rows and null ids are kept.
    """

    def make():
        run = codec(model_path)

        def one(text):
            n, ids, decoded = run(text)
            out = (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
            return (*out, list(map(int, ids.split())), decoded) if with_ids else out

        return lambda texts: [one(t) for t in texts]

    return map_texts(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else ""))
