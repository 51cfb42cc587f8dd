"""Loading of public byte-level BPE vocabularies, once per Python worker."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import numpy as np
import tiktoken

#: How GPT-2 style vocabularies split text before merging (a fixed value of these vocabularies).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def from_ranks(path: str, pattern: str = PATTERN) -> tiktoken.Encoding:
    """A rank file, without special tokens."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class JsonTokenizer:
    """ids of a tokenizers .json file: special strings in a text become their tokens, none is added.

    If the file is a plain byte-level BPE whose merges stand in the order of their ids, ids come from
    the rank-based encoder (several times as fast, equal ids); any other file goes to the tokenizers library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.encoding = self.library = None
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        plain &= not spec.get("normalizer") and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        plain &= all(not t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word"))
        if plain:
            to_byte = byte_characters()
            vocab = {bytes(to_byte[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
            merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            ids = [model["vocab"]["".join(m)] for m in merges]
            if ids == sorted(ids) and len(ids) + 256 == len(vocab):
                self.encoding = tiktoken.Encoding("json", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens=self.special)
        if self.encoding is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
        self.wide = max([*model["vocab"].values(), *self.special.values()], default=0) > 0xFFFF

    def ids(self, text: str) -> np.ndarray:
        if self.encoding is not None:
            return self.encoding.encode_to_numpy(text, allowed_special="all") if text else np.empty(0, np.uint32)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=4)
def from_json(path: str) -> JsonTokenizer:
    return JsonTokenizer(path)
