"""Token ids of a BPE vocabulary with word ends, as the tokenizers library gives them.

The library normalizes and splits a text and merges each word anew. Here words of texts in plain
characters (ASCII and Latin letters, which normalization leaves alone but for their case) are cut
by one expression and merged once, then remembered within a limit. Every other text, and every
text that holds an added token of the vocabulary, goes to the library whole, so ids are the
library's for any text.
"""

import json
import re

import tiktoken
from tokenizers import Tokenizer

LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
OTHER = re.compile(f"[^\t\n\r -~{LETTERS}]")
# How the vocabulary's splitter cuts words, for plain characters.
WORD = re.compile(rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s0-9{LETTERS}]+")
WORD_END = "</w>"
MARK = b"\xff"  # no byte of UTF-8; stands for the end of a word


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes in."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in plain]
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


class WordBpe:
    """``encode`` gives a text's ids, four little-endian bytes each."""

    def __init__(self, path: str, words: int = 100_000):
        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        self.limit, self.known = words, {}
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters, ranks = byte_letters(), {}
        for token, number in vocabulary.items():
            end = token.endswith(WORD_END)
            body = token.removesuffix(WORD_END) if end else token
            if body and all(c in letters for c in body):
                raw = bytes(letters[c] for c in body)
                if MARK not in raw:
                    ranks[raw + MARK * end] = number
        # In such a vocabulary an id is its merge's rank, and a word's last byte takes the mark first.
        self.merger = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})

    def word(self, word: str) -> bytes:
        ids = self.merger._encode_single_piece(word.encode() + MARK)
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def encode(self, text: str) -> bytes:
        if OTHER.search(text) or self.added.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return b"".join(i.to_bytes(4, "little") for i in ids)
        known, out = self.known, []
        for w in WORD.findall(text.lower()):
            ids = known.get(w)
            if ids is None:
                if len(known) >= self.limit:
                    known.clear()
                ids = known[w] = self.word(w)
            out.append(ids)
        return b"".join(out)
