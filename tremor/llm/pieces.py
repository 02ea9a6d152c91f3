"""A SentencePiece model file as plain tables (no encoder of the library is used here)."""

from __future__ import annotations

from dataclasses import dataclass

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


@dataclass(frozen=True)
class Pieces:
    """Pieces by id with score and type; `prefix`: a space is put before every non-empty text."""

    texts: tuple[str, ...]
    scores: tuple[float, ...]
    types: tuple[int, ...]
    prefix: bool
    end_id: int

    @property
    def byte_ids(self) -> list[int]:
        at = {t: i for i, t in enumerate(self.texts) if self.types[i] == BYTE}
        return [at[f"<0x{b:02X}>"] for b in range(256)]


def load_pieces(path: str) -> Pieces:
    """Read a model file.  Supported: identity normalisation, byte fallback, no user-defined or unused pieces
    (anything else raises ValueError rather than giving other ids)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n, t = m.normalizer_spec, m.trainer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
        raise ValueError("only models with identity normalisation are supported")
    if not t.byte_fallback or t.treat_whitespace_as_suffix:
        raise ValueError("only models with byte fallback and leading spaces are supported")
    if {p.type for p in m.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("user-defined and unused pieces are not supported")
    return Pieces(tuple(p.piece for p in m.pieces), tuple(p.score for p in m.pieces), tuple(p.type for p in m.pieces),
                  n.add_dummy_prefix, next(i for i, p in enumerate(m.pieces) if p.piece == (t.eos_piece or "</s>")))
