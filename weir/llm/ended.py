"""The encoder of ``bpe`` for vocabularies with word ends, with the words merged by tiktoken instead of numpy rounds.

Each word is marked at its end by a byte that no such word has; in the ranks, a last letter and the mark make the
letter's form at a word's end before anything else is merged, and every word ends with a marked token, which tells where
the ids of the next one begin. Runs of other letters still go through the tokenizers library. Vocabularies of other kinds,
or whose merges are not ranked by their ids, keep the numpy rounds.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex

from .bpe import ENDED_PLAIN, Bpe, byte_letters

#: Stands behind each word; no word that is cut from runs of common letters has it.
MARK = "\x01"


def common_words() -> re.Pattern:
    """The word pattern for runs of common letters, with the letters spelt out: the standard library is twice as fast."""
    common = [chr(c) for c in range(0x21, 0x180) if regex.fullmatch(ENDED_PLAIN, chr(c))]
    letters = "".join(re.escape(c) for c in common if regex.fullmatch(r"\p{L}", c))
    digits = "".join(c for c in common if regex.fullmatch(r"\p{N}", c))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\s{letters}{digits}]+")


class EndedBpe(Bpe):
    def __init__(self, spec: str, batch_chars: int = 1_500_000):
        super().__init__(spec, batch_chars)
        self.fast = None
        data = json.loads(spec)
        vocab, special = data["model"]["vocab"], {x["content"] for x in data.get("added_tokens", [])}
        letters = byte_letters()
        ranks = {}
        for token, i in vocab.items():
            if token not in special and self.end:
                plain = token.removesuffix(self.end)
                ranks[bytes(letters[c] for c in plain) + (MARK.encode() if plain != token else b"")] = i
        marked = [ranks.get(bytes([b]) + MARK.encode(), self.size) for b in range(256)]
        by_id = self.made.tolist()
        if not by_id or by_id != sorted(by_id) or max(marked) > by_id[0] or len(ranks) != len(by_id) + 512:
            return
        import tiktoken

        self.fast = tiktoken.Encoding("ended", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={})
        self.ended = np.zeros(self.size, bool)
        self.ended[[i for token, i in ranks.items() if token.endswith(MARK.encode()) and len(token) > 1]] = True
        self.words = common_words()

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.fast is None or not words:
            return super().merge(words)
        mark = MARK.encode()
        ids = np.array(self.fast.encode_ordinary((mark.join(words) + mark).decode()), np.int32)
        return ids, np.append(0, np.flatnonzero(self.ended[ids]) + 1)
