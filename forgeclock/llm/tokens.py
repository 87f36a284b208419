"""Public tokenizers, loaded once per worker from the folder that ships with their package."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache


@lru_cache(maxsize=1)
def encoder() -> Callable[[str], list[int]]:
    """text -> ids of ``byte_bpe_50k`` without special tokens added.

    The vocabulary exists in two forms, for two libraries; both split and merge alike (a test compares them), one several times
    faster.  Texts that hold a special token's string go through the other, which knows it as one id.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = tuple(t.content for t in slow.get_added_tokens_decoder().values())
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode
