"""A fixed public vocabulary of word pieces, and the ways to cut text into them."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import cached_property

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"  # how the vocabulary writes a blank
_LEAF: dict = {}  # the one empty node of all tries


@dataclass
class Pieces:
    """The text pieces of a SentencePiece model, by their ids; control and byte pieces apart."""

    ids: dict[str, int]
    scores: list[float]
    bytes: dict[int, int] = field(default_factory=dict)  # piece id of each byte
    unknown: int = 0
    size: int = 0
    is_unigram: bool = False

    def trie(self) -> dict:
        """By character: the same for the next characters, and the id of the piece that ends here or None."""

        def closed(node: dict) -> dict:
            return {c: (closed(below), below.get("")) for c, below in node.items() if c} or _LEAF

        root: dict = {}
        for piece, number in self.ids.items():
            node = root
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = number
        return closed(root)

    @cached_property
    def key(self) -> str:
        """A name for the content: equal models have equal keys."""
        return hashlib.sha256(repr((self.is_unigram, self.size, sorted(self.ids.items()), self.scores)).encode()).hexdigest()

    @property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)


_TRIES: dict[str, dict] = {}


def trie_of(pieces: Pieces) -> dict:
    """The pieces' trie. A worker builds it once and holds the last one, for the tasks of all stages:
    what travels is the list of pieces, about a tenth of its size."""
    if pieces.key not in _TRIES:
        _TRIES.clear()
        _TRIES[pieces.key] = pieces.trie()
    return _TRIES[pieces.key]


def shared_pieces(context, path: str = VOCABULARY):
    """The vocabulary as a broadcast, one for all operators of a Spark context."""
    held = context.__dict__.setdefault("_colloquy_pieces", {})
    if path not in held:
        pieces = load(path)
        pieces.key  # noqa: B018 (computed before it travels)
        held[path] = (pieces, context.broadcast(pieces))
    return held[path]


def _is_unigram(data: bytes) -> bool:
    """Whether the model file names the unigram algorithm (also the default).

    A file is a protocol buffer: field 2 is the trainer's settings, of which
    field 3 is the algorithm, 1 for unigram and 2 for BPE.
    """

    def varint(at):
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at += 1
            if data[at - 1] < 128:
                return value, at
            shift += 7

    def top(at, end, wanted):
        while at < end:
            tag, at = varint(at)
            if tag & 7 == 2:
                size, at = varint(at)
                if tag >> 3 == wanted:
                    return at, at + size
                at += size
            elif tag & 7 == 0:
                value, at = varint(at)
                if tag >> 3 == wanted:
                    return value, None
            else:
                at += 4 if tag & 7 == 5 else 8
        return None

    settings = top(0, len(data), 2)
    kind = top(*settings, 3) if settings else None
    return kind is None or kind[0] == 1


def load(path: str = VOCABULARY) -> Pieces:
    """Read the vocabulary on the driver; it is of fixed size and travels with the tasks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, byte_ids = {}, {}
    scores = [0.0] * model.get_piece_size()
    for number in range(model.get_piece_size()):
        piece = model.id_to_piece(number)
        scores[number] = model.get_score(number)
        if model.is_byte(number):
            byte_ids[int(piece[3:5], 16)] = number
        elif not (model.is_control(number) or model.is_unknown(number) or model.is_unused(number)):
            ids[piece] = number
    with open(path, "rb") as file:
        unigram = _is_unigram(file.read())
    return Pieces(ids, scores, byte_ids, model.unk_id(), model.get_piece_size(), unigram)
