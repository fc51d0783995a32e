"""Byte-level BPE ids of whole texts, fast enough for large tables.

Ids are those of the ``tokenizers`` file of the same vocabulary. They are made with the rank file of that vocabulary:
a text is cut before each blank that a word character follows and between a letter and a full stop or comma (no token
of the split pattern spans such a cut), equal pieces of a batch are encoded once, and the ids are put together again by position. Strings of special tokens in a
text are ordinary text.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa

from .textcore import slices, worker_cache

#: The end-of-document id of the packing contract.
END_ID = 1


def vocabulary_file(name: str = "byte_bpe_50k") -> str:
    """The rank file of a public vocabulary of this container."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


class Encoder:
    """Encodes byte columns of text. Needs ids below 2**16."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.size[i] = len(piece)

    @staticmethod
    def of(path: str) -> Encoder:
        """The worker's own encoder for this file, loaded once."""
        kept = worker_cache()
        if ("bpe", path) not in kept:
            kept["bpe", path] = Encoder(path)
        return kept["bpe", path]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts (uint16) and, by text, the position of its first id (one more entry at the end)."""
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(len(bounds), np.int64)
        after = data[1:]
        # Not before white space, nor before a byte that could begin white space beyond ASCII.
        plain = ~((after <= 0x20) | (after == 0xC2) | (after == 0xE1) | (after == 0xE2) | (after == 0xE3))
        letter = (data[:-1] | 0x20) - np.uint8(0x61) < 26
        cut = np.zeros(len(data), bool)
        cut[:-1] = (data[:-1] == 0x20) & plain
        cut[1:] |= letter & ((after == 0x2E) | (after == 0x2C))  # a letter and a full stop or comma never share a token
        cut[bounds[:-1][bounds[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        pieces = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        ).dictionary_encode()
        code = pieces.indices.to_numpy(zero_copy_only=False)
        unique = pieces.dictionary
        own = np.frombuffer(unique.buffers()[1], np.int64)[: len(unique) + 1]
        raw = np.frombuffer(unique.buffers()[2], np.uint8)
        # Pieces of a blank and a word character may stand one behind the other: the cuts between them are cuts of the same kind.
        second = raw[np.minimum(own[:-1] + 1, len(raw) - 1)]
        joined = (raw[own[:-1]] == 0x20) & (np.diff(own) > 1) & (second > 0x20) & ~np.isin(second, (0xC2, 0xE1, 0xE2, 0xE3))
        ids, first = self._unique(unique, raw, own, joined)
        count = np.diff(first)
        per = count[code]
        at = np.concatenate([[0], np.cumsum(per)])
        flat = ids[np.repeat(first[:-1][code] - at[:-1], per) + np.arange(at[-1])]
        return flat, at[np.searchsorted(starts, bounds)]

    def _unique(self, unique: pa.Array, raw: np.ndarray, own: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each unique piece one behind the other, and the position of each piece's first."""
        several = np.flatnonzero(joined)
        counts = np.zeros(len(unique), np.int64)
        parts: dict[int, list[int]] = {i: self.bpe.encode_ordinary(unique[int(i)].as_py().decode()) for i in np.flatnonzero(~joined).tolist()}
        for i, got in parts.items():
            counts[i] = len(got)
        together = np.zeros(0, np.int64)
        if len(several):
            size = (own[1:] - own[:-1])[several]
            whole = raw[own[0] : own[-1]][np.repeat(joined, np.diff(own))].tobytes().decode()
            together = np.asarray(self.bpe.encode_ordinary(whole), np.int64)
            ends = np.cumsum(self.size[together])
            counts[several] = np.diff(np.concatenate([[0], np.searchsorted(ends, np.cumsum(size), side="left") + 1]))
        first = np.concatenate([[0], np.cumsum(counts)])
        ids = np.zeros(first[-1], np.uint16)
        if len(several):
            per = counts[several]
            at = np.concatenate([[0], np.cumsum(per)])
            ids[np.repeat(first[several] - at[:-1], per) + np.arange(at[-1])] = together
        for i, got in parts.items():
            ids[first[i] : first[i + 1]] = got
        return ids, first

    def batches(self, column):
        """First row, end row, ids and first positions for slices of a text column."""
        for a, b, data, bounds in slices(column):
            yield a, b, *self.encode(data, bounds)
