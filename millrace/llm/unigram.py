"""Pieces of a SentencePiece model and the best segmentation of a text into them.

Scores are the file's own, in whole 1/64, so sums are exact. Of equally good segmentations the one counts whose last piece is longest,
then the one before it, and so on. A character that is no piece costs ten more than the worst piece and
stands as its UTF-8 bytes' pieces. In keys a space stands for the model's word mark; the mark itself, where a text
holds it, is a character without a piece, so decoding gives every text back.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np

SPACE = "▁"
NEVER = -(1 << 100)
#: Lower scores in a file count as this: beyond any sum of ordinary pieces, yet sums of many fit 64 bits.
LEAST = -(1 << 20)
#: Spans remembered.
ROOM = 300_000


class Pieces:
    """The vocabulary: a forward trie of nested dicts ({char: node}; key 0 holds (score, id)) and byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = m.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * self.size
        self.byte_id = [0] * 256
        self.root: dict = {}
        self.single: dict[str, tuple[int, int]] = {}
        worst, longest, crossing, used = 0, 1, False, set()
        for i in range(self.size):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_id[b], self.bytes_of[i] = i, bytes([b])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                text = piece.replace(SPACE, " ")
                score = round(max(LEAST, m.get_score(i)) * 64)
                worst, longest = min(worst, score), max(longest, len(text))
                crossing |= " " in text.lstrip(" ")
                used.update(text)
                self.bytes_of[i] = text.encode()
                node = self.root
                for c in text:
                    node = node.setdefault(c, {})
                node[0] = (score, i)
                if len(text) == 1:
                    self.single[text] = (score, i)
        self.longest, self.unknown = longest, worst - 640
        #: Spans no piece leaves or enters: the text falls into them, and each has a best segmentation of its own.
        alone = "".join(c for c in "\n\t\r" if c not in used)
        self.span = re.compile(rf" *[^ {alone}]+|[{alone}]| +" if alone else r" *[^ ]+| +") if not crossing else re.compile(r"(?s).+")
        self.crossing, self.model = crossing, m
        self.cache: dict[str, tuple[int, bytes]] = {}
        self.known: dict[str, bytes] = {}

    def ids_of(self, c: str) -> list[int]:
        return [self.single[c][1]] if c in self.single else [self.byte_id[b] for b in c.encode("utf-8", "replace")]

    def forward(self, text: str, starts: dict[int, int], stop: int) -> tuple[list[int], list[int], list[int]]:
        """Best scores, last pieces and their starts for every position, from the starts' scores; pieces begin before stop."""
        n = len(text)
        best, piece, back = [NEVER] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
        for i, s in starts.items():
            best[i] = s
        root, single, unknown = self.root, self.single, self.unknown
        for i in range(min(n, stop)):
            b = best[i]
            if b == NEVER:
                continue
            if text[i] not in single and b + unknown > best[i + 1]:
                best[i + 1], piece[i + 1], back[i + 1] = b + unknown, -1, i
            node, j = root, i
            while j < n:
                node = node.get(text[j])
                if node is None:
                    break
                j += 1
                if (end := node.get(0)) and b + end[0] > best[j]:
                    best[j], piece[j], back[j] = b + end[0], end[1], i
        return best, piece, back

    def walk(self, text: str, piece: list[int], back: list[int], end: int, start: int) -> list[int]:
        """Ids of the path that ends at end, back to start."""
        out: list[list[int]] = []
        while end > start:
            i = back[end]
            out.append([piece[end]] if piece[end] >= 0 else self.ids_of(text[i:end]))
            end = i
        return [x for ids in reversed(out) for x in ids]

    def best(self, span: str) -> tuple[int, bytes]:
        """Score and ids (int32) of one span, remembered while room lasts."""
        if (known := self.cache.get(span)) is not None:
            return known
        best, piece, back = self.forward(span, {0: 0}, len(span))
        got = best[-1], np.array(self.walk(span, piece, back, len(span), 0), np.int32).tobytes()
        if len(span) <= 64:
            if len(self.cache) >= ROOM // 10:
                self.cache.clear()
            self.cache[span] = got
        return got

    def learn(self, spans: list[str]) -> None:
        """Puts the ids of spans, which must be sorted, where encode_all finds them. What sorted neighbours share of a prefix is computed once."""
        root, single, unknown, known = self.root, self.single, self.unknown, self.known
        room = max(map(len, spans), default=0) + 1
        scores, pieces_, starts, open_ = [0] * room, [-1] * room, [0] * room, [[]] * room
        last = ""
        for span in spans:
            depth = 0
            for a, b in zip(last, span, strict=False):
                if a != b:
                    break
                depth += 1
            last = span
            for c in span[depth:]:
                best, piece, start, still = NEVER, -1, depth, []
                for score, begun, node in open_[depth]:  # pieces that began before, the longest first
                    if (node := node.get(c)) is not None:
                        still.append((score, begun, node))
                        if (end := node.get(0)) and score + end[0] > best:
                            best, piece, start = score + end[0], end[1], begun
                score = scores[depth]
                if (node := root.get(c)) is not None:
                    still.append((score, depth, node))
                    if (end := node.get(0)) and score + end[0] > best:
                        best, piece, start = score + end[0], end[1], depth
                if c not in single and score + unknown > best:
                    best, piece, start = score + unknown, -1, depth
                depth += 1
                scores[depth], pieces_[depth], starts[depth], open_[depth] = best, piece, start, still
            out, j = [], len(span)
            while j:
                i = starts[j]
                if pieces_[j] >= 0:
                    out.append(pieces_[j])
                else:
                    out += reversed(self.ids_of(span[i:j]))
                j = i
            out.reverse()
            known[span] = array("i", out).tobytes()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, a leading space added to each as the models do; none for an empty one."""
        split = self.span.findall
        docs = [split(" " + t) if t else [] for t in texts]
        spans = set().union(*docs)
        fresh = spans - self.known.keys()
        if len(self.known) + len(fresh) > ROOM:  # what this batch uses stays
            self.known = {s: self.known[s] for s in spans if s in self.known}
        self.learn(sorted(fresh))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, d)), np.int32) for d in docs]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def merged_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids that the file's own kind of model gives (for a BPE file its merges), which may fold or drop characters."""
        return [np.array(ids, np.int32) for ids in self.model.encode(texts, num_threads=1)]

    def decode(self, ids) -> str:
        """The text of ids that encode gave."""
        return joined(self.bytes_of, ids).decode()


def joined(table: list[bytes], ids) -> bytes:
    """UTF-8 of a text's ids, without the leading space; what is no text (ids cut within a character) is mended."""
    raw = b"".join([table[i] for i in ids])[1:]
    try:
        raw.decode()
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()
    return raw


@lru_cache(maxsize=2)
def byte_table(path: str) -> list[bytes]:
    """Bytes of every piece: all that decoding needs."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)

    def one(i: int) -> bytes:
        if m.is_byte(i):
            return bytes([int(m.id_to_piece(i)[3:5], 16)])
        return b"" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else m.id_to_piece(i).replace(SPACE, " ").encode()

    return [one(i) for i in range(m.get_piece_size())]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The vocabulary at path, loaded once a process."""
    return Pieces(path)
