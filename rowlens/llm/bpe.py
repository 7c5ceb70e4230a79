"""Byte-level BPE over whole texts, with forced boundaries.

A text is cut three times, each cut certain not to change the result:

* at the special tokens' own strings, which the tokenizer finds first;
* into chunks that begin where the pre-tokenizer must begin a piece whatever
  stands around them (``CHUNK``), so a chunk can be encoded on its own and its
  ids kept in a bounded cache of the worker;
* inside a piece, between two bytes that are never neighbours inside any
  vocabulary token: no merge can join them, so the fragments on both sides are
  merged independently and their ids concatenated.

``ForcedBoundaryCoder`` does all three. ``ChunkCoder`` stops after the second and
hands each chunk it has not seen to tiktoken's core, built from the same
vocabulary file; where only ids are needed it is faster. Both give the ids that
the tokenizers library gives for the whole text (the tests hold them against
it), and none for a null or empty text. Ids are handled as little-endian
unsigned 32-bit bytes, so joining, counting and hashing need no Python integers.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Callable

import regex

#: Unicode White_Space, as in the pre-tokenizer's own \s.
SPACE = "\t-\r \x85\xa0  -     　"
#: A run of Latin letters that no letter or digit follows (nor what a newer Unicode table may call one), with the one blank before it; else blanks and what follows up to the next blank.
CHUNK = rf" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?![\w\u0100-\U0010ffff])|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
#: The pre-tokenizer's pattern; a fixed value of this kind of vocabulary.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks whose ids a worker keeps at most.
CACHE_CHUNKS = 400_000
#: Longer chunks are not kept.
CACHE_CHARS = 64
#: Fragments up to so many bytes are merged by plain scans, longer ones with a heap.
SHORT = 24


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file, by the rule of such files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Cache(dict):
    """ids of a chunk as bytes, made on first use.

    At half of ``most`` chunks the dictionary becomes the older half, from which chunks in use come back.
    """

    def __init__(self, make: Callable[[str], bytes], most: int = CACHE_CHUNKS):
        super().__init__()
        self.make, self.most = make, most
        self.older: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            found = self.make(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= self.most // 2:
                self.older = dict(self)
                self.clear()
            self[chunk] = found
        return found


def core(vocab: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("vocabulary", pat_str=PIECE, mergeable_ranks=vocab, special_tokens={})


class Coder:
    """Encodes a text chunk by chunk; subclasses say how a chunk is encoded."""

    def __init__(self, path: str, most: int = CACHE_CHUNKS):
        import re

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        pre = self.spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or self.spec["normalizer"] or self.spec["post_processor"]:
            raise ValueError("only plain byte-level vocabularies are handled")
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks = re.compile(CHUNK).findall
        self.cache = Cache(self.chunk, most)

    def chunk(self, chunk: str) -> bytes:
        raise NotImplementedError

    def encode(self, text: str | None) -> bytes:
        """ids of the whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        get = self.cache.__getitem__
        if self.at_special is None or not self.at_special.search(text):
            return b"".join(map(get, self.chunks(text)))
        out = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out.extend(map(get, self.chunks(part)))
        return b"".join(out)


class ForcedBoundaryCoder(Coder):
    """Pieces are cut at byte pairs that no token holds; fragments are merged on their own."""

    def __init__(self, path: str, most: int = CACHE_CHUNKS):
        super().__init__(path, most)
        byte = byte_alphabet()
        vocab = {bytes(byte[c] for c in token): i for token, i in self.spec["model"]["vocab"].items() if token not in self.special}
        merges = (m.split(" ") if isinstance(m, str) else m for m in self.spec["model"]["merges"])
        both = [[bytes(byte[c] for c in side) for side in m] for m in merges]
        #: Rank of a merge by both sides' ids; a side takes 32 bits of the key.
        self.ranks = {vocab[a] << 32 | vocab[b]: k for k, (a, b) in enumerate(both)}
        #: Id that each merge makes.
        self.made = [vocab[a + b] for a, b in both]
        self.ordered = all(a < b for a, b in zip(self.made, self.made[1:]))
        #: Where ids follow ranks, tiktoken's core merges a fragment; else ``merge`` does.
        self.core = core(vocab)._encode_single_piece if self.ordered else self.merge
        self.one = [vocab[bytes([b])] for b in range(256)]
        #: Byte pairs that stand next to each other in some token.
        self.joined = {pair for token in vocab for pair in zip(token, token[1:])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.latin = regex.compile(PIECE).findall
        from tokenizers import pre_tokenizers

        #: The library's own pre-tokenizer; it writes bytes in the vocabulary's alphabet.
        self.own = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.table = {ord(c): b for c, b in byte.items()}
        self.spec = {}

    def pieces(self, chunk: str) -> list[bytes]:
        """The pre-tokenizer's pieces. Which characters are letters depends on the Unicode version, so beyond Latin-1 the library says it."""
        if max(chunk) < "\u0100":
            return [piece.encode() for piece in self.latin(chunk)]
        return [piece.translate(self.table).encode("latin-1") for piece, _ in self.own(chunk)]

    def fragments(self, piece: bytes) -> list[bytes]:
        joined = self.joined
        cuts = [k for k, pair in enumerate(zip(piece, piece[1:]), 1) if pair not in joined]
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)])] if cuts else [piece]

    def merge(self, fragment: bytes) -> list[int]:
        """ids after merging neighbours, lowest rank first and leftmost among equals."""
        ids = list(map(self.one.__getitem__, fragment))
        if len(ids) > SHORT:
            return self.merge_long(ids)
        ranks, none = self.ranks.get, len(self.made)
        while len(ids) > 1:
            found = [ranks(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
            best = min(found)
            if best == none:
                break
            k = found.index(best)
            ids[k : k + 2] = [self.made[best]]
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, near-linear in the length; -1 marks an id merged into the one before."""
        ranks, n = self.ranks.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := ranks(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, left, right = heapq.heappop(heap)
            j = after[k]
            if ids[k] != left or j >= n or ids[j] != right:
                continue
            ids[k], ids[j] = self.made[rank], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for a in (before[k], k):
                b = after[a] if a >= 0 else n
                if b < n and (r := ranks(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]

    def chunk(self, chunk: str) -> bytes:
        ids, core = array("I"), self.core
        for piece in self.pieces(chunk):
            for fragment in self.fragments(piece):
                ids.extend(core(fragment))
        return ids.tobytes()

    def decode(self, ids: bytes) -> str:
        """Text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


class ChunkCoder(ForcedBoundaryCoder):
    """Chunks not in the cache go to tiktoken's core without forced cuts. It only encodes."""

    def __init__(self, path: str, most: int = CACHE_CHUNKS):
        super().__init__(path, most)
        self.whole = None
        if self.ordered:
            self.whole = self.core.__self__.encode_ordinary
            # what forced cuts, merging and decoding need would stay in the worker for nothing
            self.ranks, self.made, self.joined, self.bytes_of = {}, [], set(), []

    def chunk(self, chunk: str) -> bytes:
        return array("I", self.whole(chunk)).tobytes() if self.whole else super().chunk(chunk)


_CODERS: dict[tuple[type, str, int], Coder] = {}


def coder(kind: type[Coder], path: str, most: int = CACHE_CHUNKS) -> Coder:
    """The worker's coder, kept between tasks; it keeps the ids of ``most`` chunks."""
    if (kind, path, most) not in _CODERS:
        _CODERS[kind, path, most] = kind(path, most)
    return _CODERS[kind, path, most]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
