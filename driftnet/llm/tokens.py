"""A public byte-level BPE tokenizer, loaded once per Python worker."""

from __future__ import annotations

import base64
import functools
import os

#: Folder of the vocabulary files; they are read where they lie.
FOLDER = os.environ.get("DRIFTNET_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of the 50,257-entry byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@functools.lru_cache(maxsize=2)
def encoding(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """The encoding; special tokens' strings are ordinary text."""
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def byte_lengths(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """The number of bytes of each token, by id."""
    import numpy as np

    enc = encoding(folder, vocabulary)
    out = np.zeros(max(enc._mergeable_ranks.values()) + 1, dtype=np.int32)
    for token, i in enc._mergeable_ranks.items():
        out[i] = len(token)
    return out
