"""Token ids of the public byte-level vocabulary, inside tasks."""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np

#: Fixed values of the vocabulary: its split pattern and its one special token.
END_TEXT, END_ID = "<|endoftext|>", 50256


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_encoding(path: str):
    """The tokenizer of a rank file; it gives the same ids as the vocabulary's own tokenizer file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=ranks, special_tokens={END_TEXT: END_ID})


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids; the special token's name in a text is that token."""
    encoding = byte_encoding(path)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")
