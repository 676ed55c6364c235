"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (dummy prefix, spaces to
the piece mark), the piece lexicon with byte fallback, and an acceptor of neighbouring
pieces. A BPE model's acceptor gives weight 0 to two pieces that merging leaves as they
are side by side and infinity to others; a unigram model's gives 0 to all, and its pieces weigh
minus their score. Each input is composed with them on the fly and the path of least
weight in the tropical semiring is its encoding. For BPE, each prefix has one path of
finite weight, namely its own encoding, so the search may drop all but one state per position.

The input is cut where no piece reaches across, before a space and around characters
that no piece joins to others; the parts are composed one by one and remembered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spendlens.llm.arrow import pieces as text_pieces
from spendlens.llm.arrow import texts

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Parts remembered by a task, in each of two generations, and the longest one remembered.
MEMORY, LONGEST = 400_000, 48
ID = np.dtype("<i4")


@dataclass(frozen=True)
class Model:
    """What a model file says, as plain data that can be sent to tasks."""

    ids: dict[str, int]  # pieces that text can become
    scores: dict[str, float]
    byte_ids: tuple[int, ...]  # of the bytes 0 to 255; empty without byte fallback
    unknown: int
    surfaces: tuple[bytes, ...]  # what each id decodes to
    unigram: bool
    prefix: bool  # the normaliser puts a space first
    digest: str  # of the file


def read_model(path: str = DEFAULT_MODEL) -> Model:
    """The model at a path that the driver can read; its size is that of the vocabulary.

    Models whose normaliser does more than mark spaces, or that have pieces defined by
    the user, are refused.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    for probe in ("ﬁⅧ", "a  b ", "Á"):
        if processor.normalize(probe).lstrip(MARK) != probe.replace(" ", MARK):
            raise ValueError("the model's normaliser rewrites text; only identity is compiled")
    size = processor.get_piece_size()
    ids, scores, surfaces, byte_ids = {}, {}, [], {}
    for i in range(size):
        piece = processor.id_to_piece(i)
        if processor.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            surfaces.append(bytes([int(piece[3:5], 16)]))
        elif processor.is_control(i) or processor.is_unknown(i):
            surfaces.append(b"" if processor.is_control(i) else " ⁇ ".encode())
        else:
            ids[piece], scores[piece] = i, processor.get_score(i)
            surfaces.append(piece.replace(MARK, " ").encode())
    whole = processor.serialized_model_proto()

    spec = proto.ModelProto.FromString(whole)
    if any(p.type == p.USER_DEFINED for p in spec.pieces):
        raise ValueError("pieces defined by the user are not compiled")
    if spec.trainer_spec.model_type not in (spec.trainer_spec.BPE, spec.trainer_spec.UNIGRAM):
        raise ValueError("only BPE and unigram models are compiled")
    return Model(
        ids, scores, tuple(byte_ids[b] for b in range(256)) if len(byte_ids) == 256 else (),
        processor.unk_id(), tuple(surfaces),
        spec.trainer_spec.model_type == spec.trainer_spec.UNIGRAM, spec.normalizer_spec.add_dummy_prefix,
        hashlib.sha256(whole).hexdigest(),
    )


class Transducer:
    """The compiled machines, with what they have met so far.

    For BPE the scores must fall from a piece's parts to the piece, as training leaves them.
    """

    def __init__(self, model: Model):
        self.model = model
        self.longest = max(map(len, model.ids), default=1)
        joined = {c for piece in model.ids if len(piece) > 1 for c in piece}
        self.lines = "\n" not in joined
        inner = any(MARK in piece.lstrip(MARK) for piece in model.ids)
        if inner:
            raise ValueError("pieces that go on after a space are not compiled")
        self.lexicon = {piece: np.array([i], ID).tobytes() for piece, i in model.ids.items()}
        self.bigrams = {piece[i : i + 2] for piece in model.ids for i in range(len(piece) - 1)}
        self.edges: dict[tuple[str, bool], tuple[tuple[str, float], ...]] = {}
        self.arcs: dict[str, dict[str, bool]] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the parts known before; those met again move on

    # The lexicon: a piece's arc, or the arcs of a character that is none.
    def _output(self, symbol: str) -> bytes:
        found = self.lexicon.get(symbol)
        if found is not None:
            return found
        if self.model.byte_ids:
            return np.array([self.model.byte_ids[b] for b in symbol.encode()], ID).tobytes()
        return np.array([self.model.unknown], ID).tobytes()

    def _next(self, symbols: list[str]) -> int | None:
        """Where merging goes on: the neighbours with the best score, the leftmost of equals."""
        best, where = None, None
        for i in range(len(symbols) - 1):
            score = self.model.scores.get(symbols[i] + symbols[i + 1])
            if score is not None and (best is None or score > best):
                best, where = score, i
        return where

    def _edge(self, piece: str, right: bool) -> tuple[tuple[str, float], ...]:
        """The symbols that merging has at a piece's end, one after the other, and the
        scores of the merges that make them; the piece itself is last."""
        key = (piece, right)
        found = self.edges.get(key)
        if found is None:
            out: list[tuple[str, float]] = [(piece[-1] if right else piece[0], 0.0)]
            symbols = list(piece)
            while len(symbols) > 1:
                where = self._next(symbols)
                if where is None:
                    break
                symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]
                edge = symbols[-1 if right else 0]
                if edge != out[-1][0]:
                    out.append((edge, self.model.scores[edge]))
            found = self.edges[key] = tuple(out) if len(symbols) == 1 else ()
        return found

    def accepts(self, left: str, right: str) -> bool:
        """Whether merging leaves the two pieces side by side.

        Until then only merges inside them happen, best score first, so what meets at the
        boundary is known step by step; a merge across it that is due before the next of
        either side rules the pair out. (Of equal scores the leftmost is due first.)
        """
        scores = self.model.scores
        mine, other = self._edge(left, True), self._edge(right, False)
        if not mine or not other or left + right in scores:
            return False  # merging never makes one of them, or goes on to join them
        if left[-1] + right[0] not in self.bigrams:
            return True
        i = j = 0
        least = -float("inf")
        while True:
            next_left = mine[i + 1][1] if i + 1 < len(mine) else least
            next_right = other[j + 1][1] if j + 1 < len(other) else least
            across = scores.get(mine[i][0] + other[j][0])
            if across is not None and across > next_left and across >= next_right:
                return False
            if next_left == next_right == least:
                return True
            if next_left >= next_right:
                i += 1
            else:
                j += 1

    def _followers(self, left: str) -> dict[str, bool]:
        """What is known yet of the acceptor's arcs from the state of a piece."""
        found = self.arcs.get(left)
        if found is None:
            if len(self.arcs) >= MEMORY:
                self.arcs.clear()
            found = self.arcs[left] = {}
        return found

    def _finite_path(self, text: str) -> list[str]:
        """The one path of finite weight through lexicon and acceptor: longest arcs first."""
        lexicon, longest, n = self.lexicon, self.longest, len(text)
        path: list[str] = []
        ends: list[int] = []
        at, length = 0, min(longest, n)
        met = bytearray(n + 1)
        arcs = None  # any piece may come first
        while at < n:
            while length:
                end = at + length
                piece = text[at:end]
                if (piece in lexicon or length == 1) and not met[end]:
                    if arcs is None:
                        break
                    accepted = arcs.get(piece)
                    if accepted is None:
                        accepted = arcs[piece] = self.accepts(path[-1], piece)
                    if accepted:
                        break
                length -= 1
            if length:
                met[end] = 1
                path.append(piece)
                ends.append(at)
                at, length = end, min(longest, n - end)
            else:
                if not path:
                    raise AssertionError("no path of finite weight")
                length = len(path.pop()) - 1
                at = ends.pop()
            arcs = self._followers(path[-1]) if path else None
        return path

    def _least_path(self, text: str) -> list[str]:
        """The path of least weight when pieces weigh minus their score."""
        scores, n = self.model.scores, len(text)
        unknown = min(scores.values(), default=0.0) - 10.0
        weight = [0.0] + [float("inf")] * n
        back = [0] * (n + 1)
        for at in range(n):
            for end in range(at + 1, min(n, at + self.longest) + 1):
                score = scores.get(text[at:end], unknown if end == at + 1 else None)
                if score is not None and weight[at] - score < weight[end]:
                    weight[end], back[end] = weight[at] - score, at
        path, end = [], n
        while end:
            path.append(text[back[end] : end])
            end = back[end]
        return path[::-1]

    def _part(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            # Neighbours that no piece holds side by side are never joined: cut there.
            bigrams = self.bigrams
            cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in bigrams]
            if cuts:
                bounds = zip([0, *cuts], [*cuts, len(text)])
                found = b"".join([self.known.get(s) or self._part(s) for s in (text[a:b] for a, b in bounds)])
            else:
                path = self._least_path(text) if self.model.unigram else self._finite_path(text)
                found = b"".join(map(self._output, path))
        if len(text) <= LONGEST:
            if len(self.known) >= MEMORY:
                self.older = self.known.copy()
                self.known.clear()
            self.known[text] = found
        return found

    def forget(self) -> None:
        """All parts and arcs met; what the model alone says stays."""
        self.known, self.older, self.arcs = {}, {}, {}

    def encode(self, text: str) -> bytes:
        """The ids, as little-endian 32-bit integers; none for the empty text."""
        if not text:
            return b""
        whole = (" " if self.model.prefix else "") + text.replace(MARK, " ")
        known, part, out = self.known, self._part, []
        newline = self._output("\n") if self.lines else b""
        for i, line in enumerate(whole.split("\n") if self.lines else [whole]):
            if i:
                out.append(newline)
            words = line.split(" ")
            if words[0]:
                out.append(known.get(words[0]) or part(words[0]))
            run = ""
            for word in words[1:]:
                if word:
                    run = f"{run}{MARK}{word}"
                    out.append(known.get(run) or part(run))
                    run = ""
                else:
                    run += MARK
            if run:
                out.append(part(run))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, in UTF-8: the machines run backwards."""
        surfaces = self.model.surfaces
        text = b"".join([surfaces[i] for i in np.frombuffer(ids, ID).tolist()])
        return text[1:] if self.model.prefix and text[:1] == b" " else text


_machines: dict[str, Transducer] = {}


def _machine(model: Model) -> Transducer:
    """One compiled transducer a Python worker and model. Workers outlive a job: what a task has met is not kept."""
    if model.digest not in _machines:
        _machines.clear()
        _machines[model.digest] = Transducer(model)
    return _machines[model.digest]


def encode(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, round_trip) of every row of (doc_id, text).

    The whole text is encoded; empty and null texts have no ids. ``round_trip`` tells
    whether decoding the ids gives the text again, a literal mark in it read as a space.
    Rows that repeat an id are encoded each.
    """
    compiled = docs.sparkSession.sparkContext.broadcast(model or read_model())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(compiled.value)
        try:
            for batch in text_pieces(batches, limit=1 << 21):
                raw = texts(batch.column("text"))
                ids = [machine.encode(t.decode()) for t in raw]
                mark = MARK.encode()
                same = [machine.decode(i) == t.replace(mark, b" ") for i, t in zip(ids, raw)]
                counts = np.array([len(i) // ID.itemsize for i in ids], np.int64)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), ID))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.ListArray.from_arrays(ends, flat), pa.array(counts), pa.array(same)],
                    ["doc_id", "ids", "n_tokens", "round_trip"],
                )
        finally:
            machine.forget()

    return docs.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, round_trip boolean")
