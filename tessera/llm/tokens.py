"""Token ids by the ``tokenizers`` library, whole texts, with a bounded cache of words.

The tokenizer file normalises (NFC, white space, lower case) and splits at white space
before any merge, so the ids of a text are the ids of its white-space chunks in order.
Each distinct chunk is encoded by the library once and kept in a bounded cache.  Only
ASCII white space separates chunks here; other white space stays inside a chunk for
the library to treat.  Where a tokenizer file does not have this shape, and for texts
that hold the string of one of its special tokens, whole texts are given to the library
instead, so ids are those of the plain call.
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from itertools import islice

import numpy as np

END_ID = 1
CACHE_WORDS = 800_000
_MARKS = b",.;:!?%$#&*|)"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def splits_at_blanks(path: str) -> bool:
    """Whether chunks between white space can be encoded one by one."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    norm = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    split = pre[0].get("type") == "Split" and pre[0].get("behavior") == "Removed" and pre[0].get("invert") is True
    pattern = (pre[0].get("pattern") or {}).get("Regex", "") if split else ""
    return norm == ["NFC", "Replace", "Lowercase"] and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and spec.get("post_processor") is None


class Encoder:
    """ids(texts): the little-endian unsigned 32-bit ids of each text, as bytes."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode("utf-8") for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunked, self.limit, self.cache = splits_at_blanks(path), cache_words, {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        if sys.byteorder == "little":
            return [array("I", e.ids).tobytes() for e in coded]
        return [np.array(e.ids, "<u4").tobytes() for e in coded]

    def _chunks(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of chunks that are not in the cache.

        A chunk that ends in a run of marks after a letter or ASCII digit is split there
        by the tokenizer too, so the two parts are looked up on their own.
        """
        whole, parts = {}, []
        for w in words:
            stem = w.rstrip(_MARKS)
            if 0 < len(stem) < len(w) and (stem[-1] < 128 and stem[-1:].isalnum() or stem[-1] >= 128 and stem.decode("utf-8")[-1].isalpha()):
                parts.append((w, stem, w[len(stem) :]))
                whole[stem] = whole[w[len(stem) :]] = None
            else:
                whole[w] = None
        out = {w: self.cache.get(w) for w in whole}
        todo = [w for w, v in out.items() if v is None]
        for i in range(0, len(todo), 20_000):
            part = todo[i : i + 20_000]
            out.update(zip(part, self._encode([w.decode("utf-8") for w in part]), strict=True))
        for w, stem, marks in parts:
            out[w] = out[stem] + out[marks]
        return out

    def ids(self, texts: list[bytes]) -> list[bytes]:
        if not self.chunked:
            return self._encode([t.decode("utf-8") for t in texts])
        found, missing = [], {}
        for text in texts:
            low = text.lower()
            if any(s in text or s in low for s in self.special):  # the library finds them before it lowers and splits
                found.append((self._encode([text.decode("utf-8")]), []))
                continue
            # ASCII letters may be lowered first where no combining mark can follow.
            plain = text.isascii() or np.frombuffer(text, np.uint8).max() < 0xCC
            words = (low if plain else text).split()
            ids = list(map(self.cache.get, words))
            gaps = [(k, words[k]) for k, v in enumerate(ids) if v is None] if None in ids else []
            missing.update((w, None) for _, w in gaps)
            found.append((ids, gaps))
        if missing:
            missing = self._chunks(list(missing))
            for ids, gaps in found:
                for k, w in gaps:
                    ids[k] = missing[w]
            self.cache.update(missing)
            if len(self.cache) > self.limit:  # words met first are the frequent ones
                self.cache = dict(islice(self.cache.items(), self.limit // 4))
        return [b"".join(ids) for ids, _ in found]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
