"""Token ids of texts by a public tokenizer file; the file's path is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def _loaded(path: str):
    """The tokenizer file, its special strings, a faster encoder (if a rank file of the same vocabulary lies beside it), and the ids' number."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    ranks_file, fast = Path(path).with_suffix(".tiktoken"), None
    if ranks_file.exists():
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.read_bytes().splitlines() if line)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return slow, special, fast, 1 + max(slow.get_vocab(with_added_tokens=True).values())


def vocabulary_size(path: str) -> int:
    """One more than the largest id of the tokenizer file."""
    return _loaded(path)[3]


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids that the tokenizer file gives (no special tokens added) as uint32.

    A text that holds a special token's own string, or that the faster encoder can't take, goes through the file's tokenizer itself.
    """
    slow, special, fast, _ = _loaded(path)
    if fast is not None and not any(s in text for s in special):
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except BaseException as e:  # noqa: BLE001  the encoder's regex gives up on some very long runs by a panic, which is no Exception
            if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                raise
    return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
