"""Token ids of a tokenizer file, as its own library gives them without added special tokens."""

from __future__ import annotations

import json
import os

import numpy as np

#: Longer texts go to the slower encoder, whose merge is not quadratic in one unbroken run.
LONGEST_FAST_TEXT = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


class Encoder:
    """``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.

    Where the same vocabulary lies beside the file as ranks, a faster implementation of the same
    rules computes them. Strings of special tokens in a text become these tokens in both.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if path.endswith(".json") and os.path.exists(ranks):
            with open(path, encoding="utf-8") as file:
                added = json.load(file)["added_tokens"]
            # Tokens that take white space with them or stand for whole words only are not
            # what the fast encoder's special tokens do.
            if not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
                self.fast = self._fast(ranks, {t["content"]: t["id"] for t in added})

    @staticmethod
    def _fast(ranks: str, special: dict[str, int]):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding(
            "pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and len(text) <= LONGEST_FAST_TEXT:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), "<u4")
        return np.asarray(self.plain.encode(text, add_special_tokens=False).ids, "<u4")
