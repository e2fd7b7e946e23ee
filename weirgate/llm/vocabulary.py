"""A public byte-level subword vocabulary, read in each Python process that uses it. Its path is a parameter; every executor must have it there."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(2)
def encoder(vocabulary: str = VOCABULARY):
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def sizes(vocabulary: str = VOCABULARY) -> np.ndarray:
    """Bytes of each id."""
    known = encoder(vocabulary)
    return np.array([len(known.decode_single_token_bytes(i)) for i in range(known.n_vocab)])
