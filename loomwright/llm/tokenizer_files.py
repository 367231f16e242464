"""Where the public tokenizer files are; the operators take a path as a parameter."""

from __future__ import annotations

import public_tokenizers


def byte_bpe() -> str:
    """The byte-level BPE of about 50 thousand ids."""
    return public_tokenizers.path("byte_bpe_50k.json")


def piece_bpe() -> str:
    """The sentencepiece model of 32 thousand pieces with byte fallback."""
    return public_tokenizers.path("piece_bpe_32k.model")
