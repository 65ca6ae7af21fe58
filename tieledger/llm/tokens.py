"""Byte-level BPE ids of whole texts."""

from __future__ import annotations

import base64

import numpy as np

#: The vocabulary used unless another path is given.
VOCABULARY = "byte_bpe_50k.tiktoken"


#: The added token of that vocabulary, which stands for itself wherever a text has it.
ADDED, ADDED_ID = "<|endoftext|>", 50256


def encoder(path: str | None = None):
    """The public 50k byte-level BPE as ranks; its ids are those of the ``tokenizers`` file of the same name.

    That file's added token is found inside texts, also without special tokens around them; so it is here.
    """
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={ADDED: ADDED_ID})


class TokenIds:
    """Ids as little-endian 32-bit words, and token counts."""

    def __init__(self, path: str | None = None):
        self.encoding = encoder(path)

    def encode(self, text: str) -> list[int]:
        if ADDED not in text:
            return self.encoding.encode_ordinary(text)
        return self.encoding.encode(text, allowed_special={ADDED}, disallowed_special=())

    def of(self, text: str | None) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes() if text else b""

    def count(self, text: str | None) -> int:
        return len(self.encode(text)) if text else 0
