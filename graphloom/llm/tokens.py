"""Token ids of the public byte-level BPE vocabulary.

The ids are those of the ``tokenizers`` file. They are computed with ``tiktoken`` over the same vocabulary, which
gives the same ids in a quarter of the time (tests hold one against the other). A text that spells a special token
goes to ``tokenizers`` itself, since only that library looks for those. Very long runs of white space, on which
``tiktoken`` would run out of stack, are cut off and encoded on their own. Vocabulary files are read where they are
installed; the folder is a parameter.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import numpy as np

#: The split of byte_bpe_50k (fixed value), written with possessive runs so that no text makes it backtrack.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SPECIAL = "<|endoftext|>"
#: Runs of Unicode white space from this length on are encoded on their own.
LONG = 10_000
LONG_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG)


def vocab_path(name: str, folder: str | None = None) -> str:
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def fast_encoder(folder: str | None = None):
    import tiktoken

    with open(vocab_path("byte_bpe_50k.tiktoken", folder), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def exact_encoder(folder: str | None = None):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab_path("byte_bpe_50k.json", folder))


def _stretches(text: str) -> Iterator[str]:
    """The text cut around its long blank runs, at places where PATTERN cuts anyway.

    A run is one match but for its last character where a text goes on, since that may belong to the next match.
    """
    at = 0
    for m in LONG_BLANK.finditer(text):
        end = m.end() - (m.end() < len(text))
        yield text[at : m.start()]
        yield text[m.start() : end]
        at = end
    yield text[at:]


def encode(text: str | None, folder: str | None = None) -> np.ndarray:
    """The ids of one text, without special tokens added; a null text has none."""
    if not text:
        return np.zeros(0, np.uint32)
    if SPECIAL in text:
        return np.array(exact_encoder(folder).encode(text, add_special_tokens=False).ids, np.uint32)
    fast = fast_encoder(folder).encode_ordinary
    if len(text) < LONG:
        return np.array(fast(text), np.uint32)
    return np.concatenate([np.array(fast(part), np.uint32) for part in _stretches(text)])
