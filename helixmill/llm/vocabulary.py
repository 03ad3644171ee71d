"""The public vocabulary that the registered queries use; callers with another one give its path to bpe.load_ranks."""

from __future__ import annotations

from .alignment import Pair
from .bpe import load_ranks

NAME = "byte_bpe_multi_50k.tiktoken"


def vocabulary(name: str = NAME) -> tuple[dict[bytes, int], str]:
    """Ranks and the pattern of pre-tokens."""
    import public_tokenizers

    return load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def pair(a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> Pair:
    """The two tokenizers that are aligned."""
    import public_tokenizers

    return Pair.load(public_tokenizers.path(a), public_tokenizers.path(b))
