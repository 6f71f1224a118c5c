"""Token ids of a public byte-level vocabulary, as bytes of little-endian unsigned 16-bit numbers."""

from __future__ import annotations

import re
import sys

END_OF_DOCUMENT = 0

# White space as the vocabulary's own splitter sees it; a word keeps one plain space before it. These pieces never
# share a token with their neighbours, so ids of a text are those of its pieces in a row.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder(dict):
    """Piece -> bytes of its ids, filled as pieces are met; ``encode`` gives a text's ids.

    ``path`` is a vocabulary file for `tokenizers`. If the same vocabulary lies beside it as ranks
    (.tiktoken), new pieces are looked up there, which is faster and gives the same ids. At most
    65,536 ids. The first ``limit`` pieces met are remembered.
    """

    def __init__(self, path: str, limit: int = 700_000):
        import base64
        import os
        from array import array

        from tokenizers import Tokenizer

        super().__init__()
        self._limit, self._array = limit, array
        self._whole = Tokenizer.from_file(path)
        if self._whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        self._special = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._new = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        else:
            self._new = self._slow

    def _slow(self, text: str) -> list[int]:
        return self._whole.encode(text, add_special_tokens=False).ids

    def _bytes(self, ids: list[int]) -> bytes:
        out = self._array("H", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def __missing__(self, piece: str) -> bytes:
        found = self._bytes(self._new(piece))
        if len(self) < self._limit:
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self._special):
            return self._bytes(self._slow(text))
        return b"".join(map(self.__getitem__, _PIECE.findall(text)))
