"""Token ids of whole texts with the tokenizers library.

Encoding is done for each distinct word once: the vocabularies used here split at white space, so the ids of a
text are those of its words in order.  Texts that hold the opening of a special token are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lucidform.llm.words import ragged, split_words

#: Words kept by a worker; beyond it the memory starts anew.  Results don't depend on it.
REMEMBERED = 200_000

#: A Latin letter (none that lower-casing or composing turns into several characters) before one mark and a space.
PARTED = r"([a-zA-Z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}])([.,]\s)"

_ENCODERS: dict[str, WordEncoder] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> WordEncoder:
    """One per worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pieces = self.tokenizer.get_vocab()
        self.width = 2 if max(pieces.values(), default=0) < 1 << 16 else 4
        self.last = np.zeros(max(pieces.values(), default=0) + 1, dtype=bool)  # ids that end a word
        self.last[[i for p, i in pieces.items() if p.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.starts = np.zeros(1 << 10, dtype=np.int64)
        self.lengths = np.zeros(1 << 10, dtype=np.int64)
        self.ids = np.zeros(1 << 12, dtype=np.uint32)
        self.used = 0

    def _keep(self, words: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        at, n = len(self.rows), len(words)
        while at + n > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.lengths[at : at + n] = lengths
        self.starts[at : at + n] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.rows.update(zip(words, range(at, at + n)))

    def _learn(self, words: list[str]) -> None:
        """Letters-only words are encoded in one call and parted at the ids that end a word."""
        plain = [w for w in words if w.isalpha()]
        rest = [w for w in words if not w.isalpha()]
        groups = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, dtype=np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):  # each word ends once
                self._keep(group, np.diff(ends, prepend=0), ids)
            else:
                rest += group
        if rest:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            self._keep(rest, np.array([len(x) for x in each], dtype=np.int64), np.array([i for x in each for i in x], dtype=np.uint32))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text; null counts as empty."""
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        if special.any():
            return self._mixed(texts, special)
        # letter and mark are encoded alike when parted, and fewer distinct words remain
        texts = pc.replace_substring_regex(pc.ascii_lower(texts), PARTED, r"\1 \2")
        codes, distinct, bounds = split_words(texts)
        words = distinct.to_numpy(zero_copy_only=False).tolist()
        if len(self.rows) + len(words) > REMEMBERED:
            self._forget()
        new = [w for w in words if w not in self.rows]
        if new:
            self._learn(new)
        row = np.fromiter(map(self.rows.__getitem__, words), dtype=np.int64, count=len(words))[codes]
        lengths = self.lengths[row]
        total = np.zeros(len(lengths) + 1, dtype=np.int64)
        np.cumsum(lengths, out=total[1:])
        return self.ids[ragged(self.starts[row], lengths)], np.diff(total[bounds])

    def _mixed(self, texts: pa.Array, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = pa.array(special)
        ids, counts = self.encode(pc.if_else(mask, "", texts))
        whole = iter(self.tokenizer.encode_batch_fast(texts.filter(mask).to_pylist(), add_special_tokens=False))
        ends = np.cumsum(counts)
        parts = []
        for i, s in enumerate(special.tolist()):
            if s:
                parts.append(np.array(next(whole).ids, dtype=np.uint32))
                counts[i] = len(parts[-1])
            else:
                parts.append(ids[ends[i] - counts[i] : ends[i]])
        return np.concatenate(parts), counts


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """One more id after each text."""
    return np.insert(ids, np.cumsum(counts), end), counts + 1
