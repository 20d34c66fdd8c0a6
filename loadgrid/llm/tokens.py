"""Token ids of texts by a public byte-level BPE, and their cutting into pieces.

``tokenizers`` reads the named JSON file. Its ids come at about 1.7 MB/s and
core; ``tiktoken`` gives the same ids from the same vocabulary's rank file at
about 7.6 MB/s (tests compare them), so it does the plain texts. Texts that
hold one of the JSON file's special strings always go through ``tokenizers``.
"""

from __future__ import annotations

import base64
import os

import numpy as np

TOKENIZER, RANKS, END_ID, MAX_TOKENS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", 2, 1024


class Ids:
    """Encoder of one task. ``tokenizer`` and ``ranks``: paths, or names of
    public_tokenizers' files."""

    def __init__(self, tokenizer: str = TOKENIZER, ranks: str | None = RANKS):
        import public_tokenizers as files
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        full = lambda p: p if os.path.isabs(p) else files.path(p)
        self.exact = Tokenizer.from_file(full(tokenizer))
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(full(ranks), "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=files.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cuts(n: int, limit: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one, or pieces of ``limit`` of
    which the first takes what is over."""
    if n <= limit:
        return [(0, n)]
    first = n % limit or limit
    return [(0, first)] + [(s, limit) for s in range(first, n, limit)]


def little_endian(ids, dtype: str = "<u4") -> bytes:
    return np.asarray(ids, dtype=np.int64).astype(dtype).tobytes()
