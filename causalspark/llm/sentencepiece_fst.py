"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Machines are compiled from a model: the normaliser (white space to the mark U+2581, and a mark before the text), the
pieces (a trie whose final states put out an id and go back to the start), byte fallback (an arc over one character that
no piece spells, putting out its bytes' ids), and an acceptor that weighs each piece after the one before. Composed with
an input, a state is a place in the text and the last piece; weights are relaxed place by place, the least sum is kept,
and the tropical shortest path gives the ids.

For a score model (unigram) the acceptor's weight is the piece's negated score, and byte fallback costs ten more than
the worst piece. For a merge model (BPE) it is zero if the model's merges, applied to the two neighbours joined, keep
them apart, and infinite else; a path is finite exactly if it is the model's encoding, and each place has one finite
state. Other models, and normalisers that rewrite text, are refused.

A text is cut where no piece can reach across (before white space, at line ends, between letters and others, as far as
the model's pieces allow), and short stretches are remembered.

Defined cases: null and empty texts have no ids; a text that holds the white-space mark U+2581 itself is encoded as the
model's library does, decodes to a space there and so has ``exact`` false; a null doc_id stays null; repeated rows give
repeated results; an empty table gives an empty result; other columns do not take part.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalspark.llm.frames import map_rows
from causalspark.llm.segments import PIECE_BPE, Segments, once

MARK, INFINITY, FALLBACK, START = "▁", float("inf"), -1, (1 << 24) - 1
#: Model kinds as the model file numbers them, what an unknown character costs over the worst piece, and piece types (fixed values).
UNIGRAM, BPE, UNKNOWN_COST = 1, 2, 10.0
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Transducer:
    """The compiled machines of one model."""

    def __init__(self, path: str = PIECE_BPE):
        from sentencepiece import sentencepiece_model_pb2
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.kind, rules = model.trainer_spec.model_type, model.normalizer_spec
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"{path}: only unigram and merge models are handled")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: the model's normaliser rewrites text in a way that is not handled")
        self.ids, self.score, self.byte_ids, self.spelling = {}, {}, {}, []
        for i, piece in enumerate(model.pieces):
            if piece.type == BYTE:
                self.byte_ids[int(piece.piece[3:5], 16)] = i
                self.spelling.append(bytes([int(piece.piece[3:5], 16)]))
            elif piece.type in (CONTROL, UNKNOWN):
                self.spelling.append(b"")
            elif piece.type == NORMAL:
                self.ids[piece.piece], self.score[piece.piece] = i, piece.score
                self.spelling.append(piece.piece.replace(MARK, " ").encode())
            else:
                raise ValueError(f"{path}: pieces of type {piece.type} are not handled")
        if len(self.byte_ids) != 256:
            raise ValueError(f"{path}: a model with byte fallback is needed")
        self.pieces = {i: p for p, i in self.ids.items()}
        # the normaliser: what stands before a text, and its one arc that is not the identity
        self.before, self.rewrite = " " if rules.add_dummy_prefix else "", (" ", MARK)
        # the piece machine: a state is its arcs, from a character to the next state and the id put out there (-1: none)
        self.start: dict[str, tuple] = {}
        for piece, i in self.ids.items():
            state = self.start
            for c in piece[:-1]:
                state = state.setdefault(c, ({}, FALLBACK))[0]
            state[piece[-1]] = (state.get(piece[-1], ({},))[0], i)
        # the acceptor: known pairs of a merge model, or the weights of single pieces
        self.allowed: dict[int, float] = {}
        # (in single precision, as the model's library adds them up, so that equal sums are equal here too)
        self.cost = {i: np.float32(-self.score[p]) for i, p in self.pieces.items()}
        self.cost[FALLBACK] = np.float32(UNKNOWN_COST - min(self.score.values(), default=0.0))
        self.weigh = self._pair if self.kind == BPE else self._single
        self.least = 0.0 if self.kind == BPE else min(self.cost.values())
        self.cut = re.compile(self._stretches()).findall
        self.known = Segments(self._shortest_path)

    def _stretches(self) -> str:
        """A pattern for stretches of text whose ends no piece crosses: white space with letters or with others, if the
        pieces keep these apart; with anything; or the whole text."""
        bodies = [p.lstrip(MARK) for p in self.ids]
        if any(MARK in b or "\n" in b for b in bodies):
            return r"(?s:.+)"
        if all(re.fullmatch(r"[^\W\d_]*|(?:[^\w]|[\d_])*", b) for b in bodies):
            return f"\\n|[ {MARK}]*(?:[^\\W\\d_]+|(?:[^\\w \\n{MARK}]|[\\d_])+)|[ {MARK}]+"
        return f"\\n|[ {MARK}]*[^ {MARK}\\n]+|[ {MARK}]+"

    def _merged(self, text: str) -> list[str]:
        """The model's merges on a short text: the best score first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = -INFINITY, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and score > best:
                    best, at = score, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _pair(self, left: int, right: int) -> float:
        """A merge model's weight of a piece after another; nothing merges across a fallback character."""
        if right == FALLBACK:
            return 0.0
        a, b = self.pieces.get(left, ""), self.pieces[right]
        weight = self.allowed[left << 24 | right] = 0.0 if self._merged(a + b) == ([a, b] if a else [b]) else INFINITY
        return weight

    def _single(self, left: int, right: int) -> float:
        """A score model's weight of a piece."""
        return self.cost[right]

    def _shortest_path(self, segment: str) -> bytes:
        """The ids of a stretch of text, as 32-bit numbers: of each place, the least weight, its last piece and where that began."""
        text, n = segment.replace(*self.rewrite), len(segment)
        start, known, weigh, least = self.start, self.allowed.get, self.weigh, self.least
        weight, last, begin = [0.0] + [INFINITY] * n, [START] * (n + 1), [0] * (n + 1)
        for at in range(n):
            base, left = weight[at], last[at]
            if base == INFINITY:
                continue
            state, end, before, bound = start, at, left << 24, base + least
            while end < n and (arc := state.get(text[end])):
                state, piece = arc
                end += 1
                if piece >= 0 and bound < weight[end]:  # else no arc can better this place
                    more = known(before | piece)
                    new = base + (weigh(left, piece) if more is None else more)
                    if new < weight[end]:
                        weight[end], last[end], begin[end] = new, piece, at
            if start.get(text[at], (None, FALLBACK))[1] == FALLBACK:
                new = base + weigh(left, FALLBACK)
                if new < weight[at + 1]:
                    weight[at + 1], last[at + 1], begin[at + 1] = new, FALLBACK, at
        places = [n]
        while places[-1]:
            places.append(begin[places[-1]])
        out = []
        for end in reversed(places[:-1]):
            if last[end] >= 0:
                out.append(last[end])
            else:
                out += [self.byte_ids[b] for b in text[end - 1].encode()]
        return array("i", out).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.cut(self.before + text))), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.spelling.__getitem__, ids.tolist()))[len(self.before):].decode(errors="replace")


def transducer(path: str = PIECE_BPE) -> Transducer:
    """One per Python worker."""
    return once(("transducer", path), lambda: Transducer(path))


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = PIECE_BPE, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, n_fallback (byte tokens), ids_sha256 (of 32-bit little-endian ids), decoded_sha256, exact[, ids].

    ``decoded_sha256`` is taken of the text decoded from the ids; ``exact`` says that it is the source text.
    """
    def make():
        fst = transducer(model)
        byte_ids = np.zeros(len(fst.spelling), bool)
        byte_ids[list(fst.byte_ids.values())] = True

        def step(columns):
            out = []
            for text in columns[1]:
                ids = fst.encode(text)
                back = fst.decode(ids)
                row = [len(ids), int(byte_ids[ids].sum()), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text]
                out.append(row + [ids] if with_ids else row)
            return [columns[0], *map(list, zip(*out, strict=True))]
        return step
    schema = "doc_id bigint, n_tokens bigint, n_fallback bigint, ids_sha256 string, decoded_sha256 string, exact boolean"
    rows = docs.select(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return map_rows(rows, make, schema + (", ids array<int>" if with_ids else ""))


def decode_ids(encoded: DataFrame, model: str = PIECE_BPE, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the texts of id arrays (a null array is empty)."""
    def make():
        fst = transducer(model)
        return lambda columns: [columns[0], [fst.decode(np.array(ids, np.int64)) for ids in columns[1]]]
    rows = encoded.select(F.col(id_col).cast("bigint"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")))
    return map_rows(rows, make, "doc_id bigint, text string")
