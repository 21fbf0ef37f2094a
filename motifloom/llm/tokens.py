"""Token ids of the public byte-level BPE vocabulary of 50,257 entries.

Ids are those that the ``tokenizers`` library gives for ``byte_bpe_50k.json``
without adding special tokens; one that a text itself holds, such as
``<|endoftext|>``, has its own id. They are computed with ``tiktoken`` from the same
vocabulary given as ranks, which takes a quarter of the time; tests hold the
two against each other.
"""

from __future__ import annotations

import base64
import json
from pathlib import Path

import numpy as np


class Encoder:
    """``path``: the vocabulary's ranks, a ``.tiktoken`` file, with its added tokens in the ``.json`` file beside it; ``pattern``: how it splits texts."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        added = json.loads(Path(path).with_suffix(".json").read_text(encoding="utf-8"))["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: added tokens that match by more than their text")
        self._added = {t["content"]: t["id"] for t in added}
        self._inner = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self._added)

    def __call__(self, text: str) -> np.ndarray:
        if any(t in text for t in self._added):
            return np.array(self._inner.encode(text, allowed_special="all"), np.uint32)
        return np.array(self._inner.encode_ordinary(text), np.uint32)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    key = (path, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(path, pattern)
    return _encoders[key]
