"""Byte-pair encoding with an index from each pair to its positions, and decoding."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tabflow.llm import words as W

# The published split of byte-level BPE into pieces (fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Distinct pieces whose ids a task remembers; when full, it starts anew.
MEMORY = 200_000
# Ranks whose positions lie in one list of the index.
BAND = 1024
_NONE = np.iinfo(np.int64).max


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ascending(x: np.ndarray) -> np.ndarray:
    """Distinct numbers in order."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Tokenizer:
    """Merges, special tokens and bytes of a byte-level tokenizer file.

    The file must be of the kind this module knows: no normaliser, byte-level pieces, and every merge makes a token
    of its own. Then a pair that holds a new token has a later rank than the merge that made it, so ranks can be
    applied to all pieces of a partition at once in ascending order.
    """

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            held = json.load(f)
        model, names = held["model"], byte_names()
        if held["normalizer"] or held["pre_tokenizer"]["type"] != "ByteLevel" or held["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a plain byte-level tokenizer")
        vocab = model["vocab"]
        self.of_byte = np.zeros(256, np.int64)
        for c, b in names.items():
            self.of_byte[b] = vocab[c]
        self.bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in held["added_tokens"])]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(names[c] for c in token) if all(c in names for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if len(set(made)) != len(made) or set(self.of_byte.tolist()) & set(made):
            raise ValueError("two merges make the same token")
        # Pairs as numbers in ascending order, the rank of each, and the token that each rank makes.
        pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64).reshape(-1, 2)
        self.wide = np.int64(len(self.bytes) + 1)
        keys = pairs[:, 0] * self.wide + pairs[:, 1]
        order = np.argsort(keys)
        self.pairs, self.rank, self.made = np.append(keys[order], _NONE), np.append(order, 0), np.array(made, np.int64)
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def pieces(self, text: str) -> list[str]:
        """Pieces of one text in order; a special token is a piece of its own."""
        if not self.cut or not any(t in text for t in self.special):
            return PIECES.findall(text)
        out, start = [], 0
        for m in self.cut.finditer(text):
            out += PIECES.findall(text[start : m.start()])
            out.append(m.group())
            start = m.end()
        return out + PIECES.findall(text[start:])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair of symbols; the largest number for pairs that don't merge."""
        keys = left * self.wide + right
        at = np.searchsorted(self.pairs, keys)
        return np.where((self.pairs[at] == keys) & (left >= 0) & (right >= 0), self.rank[at], _NONE)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and where those of each begin (one more entry at the end).

        All pieces lie in one row of symbols, with a bar after each. The index holds, for every band of ``BAND`` ranks, the positions of
        the left symbols of its pairs. Bands are taken in ascending order; inside a band every piece merges the lowest rank it has,
        at all positions of that pair and leftmost first, until the band is empty. Pieces do not touch and a merge makes pairs of later
        ranks only, so each piece sees its ranks in ascending order. The two pairs that a merge makes are filed under their ranks.
        """
        raw = [p.encode() for p in pieces]
        sizes = np.array([len(x) for x in raw], np.int64)
        n = int(sizes.sum()) + len(raw)
        piece = np.repeat(np.arange(len(raw)), sizes + 1)
        symbols = np.full(n + 1, -1, np.int64)
        inner = np.ones(n, bool)
        inner[np.cumsum(sizes + 1) - 1] = False
        symbols[:n][inner] = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        follow, before = np.arange(1, n + 2), np.arange(-1, n)
        rank = np.full(n + 1, _NONE)
        rank[:n] = self.ranks(symbols[:n], symbols[1:])
        index: dict[int, list[np.ndarray]] = {}

        def file(at: np.ndarray) -> None:
            """Put positions under the band of their rank."""
            at = at[rank[at] != _NONE]
            band = rank[at] // BAND
            order = np.argsort(band, kind="stable")
            at, band = at[order], band[order]
            edge = np.concatenate([[0], np.nonzero(band[1:] != band[:-1])[0] + 1, [len(at)]]) if len(at) else [0]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                index.setdefault(int(band[a]), []).append(at[a:b])

        file(np.arange(n))
        while index:
            band = min(index)
            # Those of pairs that another merge took or changed are gone or filed elsewhere.
            at = _ascending(np.concatenate(index.pop(band)))
            at = at[rank[at] // BAND == band]
            while len(at):
                own = piece[at]
                first = np.concatenate([[0], np.nonzero(own[1:] != own[:-1])[0] + 1])
                least = np.repeat(np.minimum.reduceat(rank[at], first), np.diff(np.append(first, len(at))))
                lowest = rank[at] == least
                i = at[lowest]
                # Equal symbols in a row overlap: every other pair of such a row is taken, from the left.
                joined = np.concatenate([[False], i[1:] == follow[i[:-1]]])
                start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(i))))
                i = i[(np.arange(len(i)) - start) % 2 == 0]
                j = follow[i]
                k = follow[j]
                symbols[i] = self.made[rank[i]]
                symbols[j] = -2
                rank[j] = _NONE
                follow[i] = k
                before[k] = i
                h = before[i]
                h = h[h >= 0]
                changed = _ascending(np.concatenate([i, h]))
                rank[changed] = self.ranks(symbols[changed], symbols[follow[changed]])
                here = rank[changed] // BAND == band
                file(changed[~here])
                at = _ascending(np.concatenate([at, changed[here]]))
                at = at[rank[at] // BAND == band]
        left = symbols[:n] >= 0
        return symbols[:n][left].astype("<u4"), np.concatenate([[0], np.cumsum(np.bincount(piece[left], minlength=len(raw)))])

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


class Encoder:
    """Encodes texts of one task, with the ids of pieces it has met."""

    def __init__(self, tokenizer: Tokenizer, memory: int = MEMORY):
        self.tokenizer, self.memory = tokenizer, memory
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        special = self.tokenizer.special
        if len(self.known) > self.memory:
            self.known = {}
        known = self.known
        split = [self.tokenizer.pieces(t) for t in texts]
        new = list({p for pieces in split for p in pieces if p not in known})
        plain = [p for p in new if p not in special]
        ids, at = self.tokenizer.encode_pieces(plain)
        held, edge = ids.tobytes(), (4 * at).tolist()
        known.update(zip(plain, (held[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)), strict=True))
        known.update({p: np.array([special[p]], np.uint32).tobytes() for p in new if p in special})
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, pieces)), "<u4") for pieces in split]


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(file: str) -> Tokenizer:
    """The tokenizer of a file, read once in a process."""
    if file not in _LOADED:
        _LOADED[file] = Tokenizer(file)
    return _LOADED[file]


def bpe_round_trip(docs: DataFrame, file: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text with the tokenizer in ``file``, then decode its ids.

    Returns the key, ``n_tokens``, ``ids_sha256`` (ids as little-endian 32-bit numbers), ``decoded_sha256`` (UTF-8), and
    with ``with_ids`` also ``ids`` and ``decoded``. Null counts as empty: no ids. Strings of special tokens in a text
    become those tokens. Repeated rows stay; other columns are ignored. Each task holds the distinct pieces of about
    ``words.STEP_BYTES`` of text, or of one longer text; nothing is shuffled. ``file`` must exist on every machine.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(file)
        encode = Encoder(tok)
        for whole in batches:
            for batch in W.steps(whole, "text"):
                ids = encode(W.filled(batch.column("text")).to_pylist())
                decoded = [tok.decode(x.tolist()) for x in ids]
                out = [
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                ]
                if with_ids:
                    out += [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("key"), *out], names=names)

    return docs.selectExpr(f"`{key}` as key", f"`{text}` as text").mapInArrow(run, schema)
