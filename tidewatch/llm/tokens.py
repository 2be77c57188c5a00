"""Token ids of texts, for the operators that write or pack sequences.

The ids are those of a public byte-level BPE vocabulary, loaded from ``vocabulary``
(a tokenizers file) and ``ranks`` (the same vocabulary for tiktoken, which is faster).
A text is cut before each single space that follows a word, where the vocabulary's
own splitting always begins a new piece; the ids of such a chunk do not depend on
its neighbours and are kept in a bounded table. Chunks with characters on which the
two libraries' Unicode tables might differ go to tokenizers, and so do whole texts
that spell out the vocabulary's special token, which has an id of its own.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import cached_property

from tidewatch.llm.text import worker_state
from tidewatch.session import send_by_value

send_by_value(__name__)

END = 2
ID_BYTES = 4
#: The one token of the vocabulary that texts are searched for as a whole.
SPECIAL = "<|endoftext|>"
#: Chunks of text whose ids a worker keeps: the first ones met, which are the frequent ones.
KEPT_CHUNKS = 200_000
_KEPT_LENGTH = 48

_CHUNK = re.compile(r" ?[^\s]+|\s+(?!\S)|\s+")
#: White space that regular expression libraries do not agree on.
_ODD_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SAFE = "\u0500"


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    def __init__(self, vocabulary: str, ranks: str):
        import tiktoken
        from public_tokenizers import PATTERN

        self.vocabulary = vocabulary
        with open(ranks, "rb") as lines:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})
        self.kept: dict[str, bytes] = {}

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    def _ids(self, chunk: str) -> bytes:
        if chunk.isascii() or max(chunk) < _SAFE:
            ids = self.fast.encode_ordinary(chunk)
        else:
            ids = self.exact.encode(chunk, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, without the end of the document."""
        if SPECIAL in text or _ODD_SPACE.search(text):
            return array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()
        chunks = _CHUNK.findall(text)
        kept = self.kept
        out = list(map(kept.get, chunks))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    chunk = chunks[i]
                    ids = kept.get(chunk)
                    if ids is None:
                        ids = self._ids(chunk)
                        if len(kept) < KEPT_CHUNKS and len(chunk) <= _KEPT_LENGTH:
                            kept[chunk] = ids
                    out[i] = ids
        return b"".join(out)


def encoder(files: tuple[str, str]) -> Encoder:
    return worker_state("tokens", lambda: Encoder(*files), files)


_END_BYTES = array("I", [END]).tobytes()


def document_pieces(text: str | None, files: tuple[str, str], length: int) -> list[bytes]:
    """Ids of a document and its end, cut into pieces of ``length`` ids. Only the
    first piece may be shorter."""
    ids = encoder(files).encode(text or "") + _END_BYTES
    size = ID_BYTES * length
    first = len(ids) % size or size
    return [ids[:first], *(ids[at : at + size] for at in range(first, len(ids), size))]
