"""Whole-text encoding with a file of the ``tokenizers`` library.

A tokenizer that lower-cases texts, drops white space before it forms tokens and sets
punctuation apart lets no token span white space, so a text's ids are those of its
space-separated pieces in turn. Whether a file says so is read when it is loaded; texts go
whole to the library if not. Pieces repeat, so a
worker remembers the ids of pieces it has met (a bounded table) and hands only new
ones to the library, many at a time.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Pieces remembered in each of a worker's two generations; when the young one is full, it
#: becomes the old one, so that frequent pieces survive.
MEMORY = 350_000
#: Longer pieces are encoded but not remembered.
LONG_PIECE = 64
#: Words of letters that go to the library in one text.
LOT = 256

#: The steps of a tokenizer file under which pieces between white space encode alone.
PIECE_NORMALIZERS = ("NFC", "Replace", "Lowercase")
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def encodes_by_piece(config: dict) -> bool:
    """Whether a tokenizer file lower-cases, splits at white space and punctuation, and adds nothing to a text."""
    steps = config.get("normalizer") or {}
    normalizers = steps.get("normalizers", [])
    cuts = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        tuple(x["type"] for x in normalizers) == PIECE_NORMALIZERS
        and (normalizers[1]["pattern"], normalizers[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == ({"Regex": PIECE_PATTERN}, "Removed", True)
        and not cuts[1]["add_prefix_space"]
        and not any(config.get(x) for x in ("post_processor", "truncation", "padding"))
        and all(x["content"].startswith("<|") and " " not in x["content"] for x in config.get("added_tokens", []))
    )


_loaded: dict[str, "PieceEncoder"] = {}


class PieceEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_piece = encodes_by_piece(json.loads(self.tokenizer.to_str()))
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        #: Ids that end a word, if the file marks them.
        self.ends = np.zeros(self.vocabulary, bool)
        if suffix := json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix"):
            self.ends[[k for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> "PieceEncoder":
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces. Words of letters go to the library many in a text, whose ids are cut after each id that ends a word."""
        words, rest, out = [], [], {}
        for x in new:
            (words if _LETTERS(text := x.decode("utf-8")) else rest).append((x, text))
        lots = [words[k : k + LOT] for k in range(0, len(words), LOT)]
        for lot, coded in zip(lots, self._coded([" ".join(text for _, text in lot) for lot in lots])):
            ids = np.array(coded.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(lot) or cuts[-1] != len(ids):  # not every word has an end
                rest += lot
                continue
            raw, begin = ids.tobytes(), 0
            for (x, _), end in zip(lot, (4 * cuts).tolist()):
                out[x] = raw[begin:end]
                begin = end
        for (x, _), coded in zip(rest, self._coded([text for _, text in rest])):
            out[x] = array("I", coded.ids).tobytes()
        return out

    def _coded(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def encode(self, texts: Iterable[str | None], group: int = 256) -> Iterator[np.ndarray]:
        """Little-endian unsigned 32-bit ids of each text; null counts as empty."""
        if not self.by_piece:
            for text in texts:
                yield np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4")
            return
        waiting: list[list[bytes]] = []
        for text in texts:
            body = (text or "").encode("utf-8", "replace")
            # The tokenizer lowers letters itself; only its special tokens know case.
            waiting.append((body if b"<|" in body else body.lower()).split())
            if len(waiting) == group:
                yield from self._flush(waiting)
                waiting = []
        if waiting:
            yield from self._flush(waiting)

    def _flush(self, docs: list[list[bytes]]) -> Iterator[np.ndarray]:
        known, old = self.known, self.old
        met = set().union(*docs).difference(known)
        new, ended = set(), []
        for piece in met:
            if piece in old:
                known[piece] = old[piece]
            # Punctuation after a letter, up to the piece's end, is always a token of its own.
            elif (cut := _ENDED(piece)) and b"<|" not in piece:
                ended.append((piece, *cut.groups()))
                new.update(cut.groups())
            else:
                new.add(piece)
        new = new.difference(known)
        kept = {p: old[p] for p in new if p in old}
        known.update(kept)
        new.difference_update(kept)
        if new:
            known.update(self._learn(sorted(new)))
        for piece, stem, marks in ended:
            known[piece] = known[stem] + known[marks]
        for pieces in docs:
            yield np.frombuffer(b"".join(map(known.__getitem__, pieces)), dtype="<u4")
        for piece in [p for p in (*new, *(x[0] for x in ended)) if len(p) > LONG_PIECE]:
            known.pop(piece, None)
        if len(known) > MEMORY:
            self.old, self.known = known, {}


#: Letters of ASCII and Latin-1 alone: one word to every tokenizer that ``encodes_by_piece`` lets through.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: ASCII punctuation after such a letter, as UTF-8.
_ENDED = re.compile(rb"(.*(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([!-/:-@\[-`{-~]+)", re.DOTALL).fullmatch
