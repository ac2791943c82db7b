"""Token ids of whole texts by a public word-level byte-pair vocabulary.

The ids are those of the ``tokenizers`` library for the same file. Texts are
cut at blanks, which no token crosses, and the ids of a piece between blanks are
kept for the next time. Pieces of plain Latin letters, digits and ASCII marks
are cut as the file's pattern cuts them and merged by ``tiktoken`` with the
file's own merge order (a word's end is one more byte); every other piece goes
to ``tokenizers`` as it is.
"""

from __future__ import annotations

import json
import re

#: Pieces whose ids are kept in one task.
KEPT_PIECES = 300_000
_END = b"\xff"  # no UTF-8 text holds this byte
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!-&(-/:-@\[-`{-~"  # ASCII marks without the apostrophe
_PLAIN = re.compile(rf"[{_LETTERS}0-9{_MARKS}\n\t\r]*")
_CUT = re.compile(rf"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write bytes with."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordTokens:
    """Texts to ids, each id as four little-endian bytes."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        letters = byte_letters()
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        ranks = {}
        for token, number in vocabulary.items():
            ends = token.endswith("</w>") and token != "</w>"
            body = token.removesuffix("</w>") if ends else token
            ranks[bytes(letters[c] for c in body) + (_END if ends else b"")] = number
        merges = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        self.merge = merges._core_bpe.encode_single_piece
        self.ids: dict[str, bytes] = {}
        self.kept = kept

    def _piece(self, piece: str) -> bytes:
        if _PLAIN.fullmatch(piece) and "<|" not in piece:
            numbers = [i for word in _CUT.findall(piece) for i in self.merge(word.lower().encode() + _END)]
        else:
            numbers = self.whole.encode(piece, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in numbers)

    def encode(self, text: str) -> bytes:
        ids = self.ids
        if len(ids) > self.kept:
            ids.clear()
        out = []
        for piece in text.split(" "):
            known = ids.get(piece)
            if known is None:
                known = ids[piece] = self._piece(piece)
            out.append(known)
        return b"".join(out)
