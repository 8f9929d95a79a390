"""Token ids of whole texts by a byte-level BPE of the tokenizers library, each distinct chunk once.

The vocabulary splits a text into words before it merges bytes, and a single space or line break
between two visible characters always begins or forms a word of its own. Cutting texts there gives
chunks whose ids, put together, are the ids of the text. A worker encodes each distinct chunk once
and keeps its ids under the chunk's 128-bit hash, within a bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from knowspan.llm import _text as tx

TOKENIZER = "byte_bpe_50k.json"
#: Chunks kept by a worker; beyond it the table starts anew.
KEEP = 600_000
_PRINT = np.zeros(256, dtype=bool)
_PRINT[0x21:0x7F] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Punctuation that ends a run of letters or digits; not of a contraction, nor inside <|endoftext|>.
_PUNCT = _PRINT & ~_ALNUM
_PUNCT[[0x27, 0x7C]] = False
#: After a space, a character that is surely not white space: printable ASCII, or a lead byte under
#: which Unicode has no white space.
_SEEN = _PRINT.copy()
_SEEN[0xC3:0xE1] = True
_SEEN[0xE4:0xF5] = True


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(raw: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Starts of chunks: ``texts``, the starts of texts, and the safe places within them."""
    n = len(raw)
    cut = np.zeros(n + 1, dtype=bool)
    if n > 1:
        prev, here = raw[:-1], raw[1:]
        same = np.ones(n, dtype=bool)
        same[texts] = False
        cut[: n - 1] |= (prev == 0x20) & _SEEN[here] & same[1:]  # before a space that a visible character follows
        cut[1:n] |= _ALNUM[prev] & _PUNCT[here]
    if n > 2:
        alone = (raw[1:-1] == 0x0A) & _PRINT[raw[:-2]] & _PRINT[raw[2:]]
        cut[1 : n - 1] |= alone
        cut[2:n] |= alone
    cut[texts] = True
    cut[n] = False
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts; one per Python worker."""

    _held: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if (most := self.tokenizer.get_vocab_size(with_added_tokens=True)) > 1 << 16:
            raise ValueError(f"ids are held in 16 bits; {path} has {most}")
        self.clear()

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._held:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            cls._held[path] = cls(path)
        return cls._held[path]

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.checks = np.zeros(0, np.uint64)  # the other half of each key
        self.slots = np.zeros(0, np.int64)
        self.firsts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint16)

    def _learn(self, keys: np.ndarray, checks: np.ndarray, texts: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        lists = [e.ids for e in found]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for ids in lists for i in ids), np.uint32, int(sizes.sum()))
        slots = np.arange(len(keys)) + len(self.firsts) - 1
        self.firsts = np.concatenate([self.firsts, self.firsts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, flat.astype(np.uint16)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, slots)
        self.checks = np.insert(self.checks, at, checks)

    def plainly(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, at = raw.tobytes(), offsets.tolist()
        found = self.tokenizer.encode_batch_fast([data[a:z].decode() for a, z in zip(at, at[1:])], add_special_tokens=False)
        lists = [np.asarray(e.ids, np.uint16) for e in found]
        return np.concatenate([np.zeros(0, np.uint16), *lists]), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts in a buffer."""
        n = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, np.uint16), np.zeros(n + 1, np.int64)
        starts = cuts(raw, offsets[:-1][np.diff(offsets) > 0])
        ends = np.append(starts[1:], len(raw))
        h, other = tx.span_hashes(raw, starts, ends), tx.span_hashes(raw, starts, ends, second=True)
        keys, first, which = np.unique(h, return_index=True, return_inverse=True)
        if (other != other[first][which]).any():  # two chunks with one key: encoded without the cache
            return self.plainly(raw, offsets)
        if len(self.keys) + len(keys) > KEEP:
            self.clear()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            data = raw.tobytes()
            self._learn(keys[new], other[first[new]], [data[a:z].decode() for a, z in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            at = np.searchsorted(self.keys, keys)
        if (self.checks[at] != other[first]).any():
            return self.plainly(raw, offsets)
        slot = self.slots[at][which]
        sizes = self.firsts[slot + 1] - self.firsts[slot]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.firsts[slot] - total[:-1], sizes)]
        chunk = np.searchsorted(starts, offsets[:-1])  # the first chunk of each text; of the next, for an empty one
        return ids, np.append(total[chunk], total[-1])


def encode_column(texts: pa.Array, path: str):
    """(row, ids as uint16) for each text of a column, whole."""
    encoder = Encoder.of(path)
    raw, offsets = tx.buffers(texts)
    for i, j, part, offs in tx.slices(raw, offsets):
        ids, at = encoder.encode(part, offs)
        for k in range(j - i):
            yield i + k, ids[at[k] : at[k + 1]]
