"""Byte-pair encoding with a contiguous rank array per word, and memos in front of tokenizers."""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from itertools import chain, filterfalse

import numpy as np

#: Words that a memo holds before it starts anew; about 150 bytes each.
MEMO_WORDS = 700_000
#: Longer words, in bytes, are merged with a heap instead of repeated scans.
SHORT_WORD = 256
#: Rank of two parts that do not merge.
GONE = np.int64(2**31 - 1)

#: The byte alphabet of byte-level vocabularies (printable bytes stand for themselves).
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> list[str]:
    """Character that stands for each byte value."""
    others = iter(range(256, 512))
    plain = set(PRINTABLE)
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class RankArrayEncoder:
    """Encoder for a byte-level vocabulary whose words end in a suffix.

    A word starts as one part per byte.  A row of a matrix holds the parts of a word and, beside them, the
    ranks of adjacent parts.  Each round scans a row for its smallest rank (the leftmost of equals), deletes
    that boundary, and looks up the two ranks beside it.  Many words go through a round together.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.special_split = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")")
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token.encode()
        alphabet = byte_alphabet()
        self.first = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in alphabet], dtype=np.int64)
        self.size = size
        pairs = np.array([vocab[a] * size + vocab[b] for a, b in model["merges"]], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in model["merges"]], dtype=np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks, self.made = pairs[order], order.astype(np.int64), made
        #: Ranks of two adjacent bytes, inside a word and at its end.
        self.first_ranks = [self.rank_of(self.first[:, None], right[None, :]).astype(np.int32) for right in (self.first, self.last)]
        import regex
        from tokenizers import Tokenizer

        #: Fixed value: the vocabulary's split pattern.
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.library = Tokenizer.from_file(path)
        self.byte_of = {c: b for b, c in enumerate(alphabet)}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], GONE)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for low, width in ((0, 8), (8, 16), (16, 32), (32, 64), (64, SHORT_WORD)):
            rows = np.nonzero((lengths > low) & (lengths <= width))[0]
            step = max(1, 400_000 // width)
            for start in range(0, len(rows), step):
                self._encode_block([words[i] for i in rows[start : start + step]], rows[start : start + step], width, out)
        for i in np.nonzero(lengths > SHORT_WORD)[0]:
            out[i] = self._encode_long(words[i])
        return out

    def _encode_block(self, words: list[bytes], rows: np.ndarray, width: int, out: list[bytes]) -> None:
        """Parts stay where they start; a merge marks the right part as gone and links its neighbours."""
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(-1, width)
        count = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        at = np.arange(len(words))
        column = np.arange(width)
        parts = np.where(column[None, :] < count[:, None], self.first[raw], -1).astype(np.int32)
        parts[at, count - 1] = self.last[raw[at, count - 1]]
        ranks = np.full(parts.shape, GONE, dtype=np.int32)
        ranks[:, :-1] = np.where(column[None, :-1] < count[:, None] - 1, self.first_ranks[0][raw[:, :-1], raw[:, 1:]], GONE)
        long = at[count > 1]
        end = count[long]
        ranks[long, end - 2] = self.first_ranks[1][raw[long, end - 2], raw[long, end - 1]]
        after = np.tile(np.arange(1, width + 2, dtype=np.int16), (len(words), 1))
        before = after - np.int16(2)
        while True:
            left = ranks[at]
            best = left.argmin(axis=1)
            rank = left[np.arange(len(at)), best]
            go = rank != GONE
            at, best, rank = at[go], best[go], rank[go]
            if not len(at):
                break
            gone = after[at, best]
            beyond = after[at, gone]
            merged = self.made[rank]
            parts[at, best], parts[at, gone], ranks[at, gone] = merged, -1, GONE
            after[at, best], before[at, beyond] = beyond, best
            more = beyond < count[at]
            ranks[at, best] = np.where(more, self.rank_of(merged, parts[at, np.minimum(beyond, width - 1)].astype(np.int64)), GONE)
            prior = before[at, best]
            inner = prior >= 0
            ranks[at[inner], prior[inner]] = self.rank_of(parts[at[inner], prior[inner]].astype(np.int64), merged[inner])
        alive = parts >= 0
        ids = parts[alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(alive.sum(axis=1))).tolist()
        start = 0
        for row, stop in zip(rows.tolist(), ends):
            out[row] = ids[start:stop]
            start = stop

    def _encode_long(self, word: bytes) -> bytes:
        raw = np.frombuffer(word, dtype=np.uint8)
        ids = self.first[raw]
        ids[-1] = self.last[raw[-1]]
        n = len(ids)
        first_ranks = self.rank_of(ids[:-1], ids[1:]).tolist()
        part = ids.tolist()
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, i, part[i], part[i + 1]) for i, r in enumerate(first_ranks) if r != GONE]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j >= 0:
                r = int(self.rank_of(np.array([part[i]]), np.array([part[j]]))[0])
                if r != GONE:
                    heapq.heappush(heap, (r, i, part[i], part[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or part[i] != a or part[j] != b:
                continue
            part[i] = int(self.made[r])
            alive[j] = False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([p for p, ok in zip(part, alive) if ok], dtype="<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        """Lower-cased, composed words of a text.

        From U+0500 on the Unicode versions of the library and of Python differ, so the library splits there.
        """
        if text.isascii():
            return self.pattern(text.lower())
        if max(text) < "\u0500":
            text = unicodedata.normalize("NFC", text)
            return self.pattern("".join(c.lower() for c in text) if "Σ" in text else text.lower())
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, piece)).decode() for piece, _ in split]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of texts without ASCII white space, each as little-endian 32-bit integers."""
        plans, index, words = [], {}, []
        for chunk in chunks:
            plan = []
            for segment in self.special_split.split(chunk) if "<|" in chunk else (chunk,):
                if segment in self.special:
                    plan.append(-1 - self.special[segment])
                    continue
                for piece in self.pieces(segment):
                    at = index.get(piece)
                    if at is None:
                        at = index[piece] = len(words)
                        words.append(piece.encode())
                    plan.append(at)
            plans.append(plan)
        ids = self.encode_words(words)
        special = {-1 - i: np.array([i], dtype="<u4").tobytes() for i in self.special.values()}
        return [ids[p[0]] if len(p) == 1 and p[0] >= 0 else b"".join(special[x] if x < 0 else ids[x] for x in p) for p in plans]

    def decode(self, ids: list[int]) -> bytes:
        """The library's text of ids for a vocabulary without a decoder: its tokens, a space between each two."""
        return b" ".join(map(self.tokens.__getitem__, ids))


def _class_to(limit: int, kind: str) -> str:
    """Characters below a limit whose Unicode category starts with `kind`, as part of a character class."""
    return "".join(re.escape(c) for c in map(chr, range(limit)) if unicodedata.category(c)[0] == kind)


class BytePieces:
    """Ids of chunks (`byte_chunks`) for byte-level vocabularies with the GPT-2 split and no word suffix.

    A chunk's pieces are encoded by rank arrays and remembered.  Chunks beyond `PLAIN`, where Unicode versions may
    differ, are left to the library.
    """

    PLAIN = re.compile("^ ?[!-~\xa1-\u04ff]+$", re.MULTILINE).findall

    def __init__(self, path: str, width: np.dtype, limit: int = MEMO_WORDS):
        letters, digits = (_class_to(0x500, kind) for kind in "LN")
        # 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+ of these vocabularies, for lines of plain chunks
        pattern = f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{digits}]+| ?[^ \\n{letters}{digits}]+|\\n"
        self.encoder, self.split, self.width, self.limit, self.known = RankArrayEncoder(path), re.compile(pattern).findall, width, limit, {}

    @staticmethod
    def fits(path: str) -> bool:
        """Whether the vocabulary is one of these."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        odd = ["dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"]
        return (
            spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
            and model.get("type") == "BPE" and not any(model.get(k) for k in odd) and all(t["special"] for t in spec["added_tokens"])
            and all(isinstance(m, list) for m in model["merges"]) and set(byte_alphabet()) <= set(model["vocab"])
        )

    def __call__(self, chunks: list[str]) -> list[bytes]:
        """Raw ids of plain chunks."""
        flat = self.split("\n".join(chunks))  # a line each: no plain chunk holds \n, and no piece reaches over one
        known = self.known
        known["\n"] = b""
        missing = list(set(filterfalse(known.__contains__, flat)))
        if len(known) + len(missing) > self.limit:
            known.clear()
            known["\n"] = b""
            missing = list(set(flat) - {"\n"})
        ids = self.encoder.encode_words([p.encode() for p in missing])
        ends = np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))) // 4 * self.width.itemsize
        raw = np.frombuffer(b"".join(ids), dtype="<u4").astype(self.width).tobytes()
        known.update((p, raw[a:b]) for p, a, b in zip(missing, [0, *ends.tolist()], ends.tolist()))
        parts = list(map(known.__getitem__, flat))
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        ends = [*np.cumsum(sizes)[sizes == 0].tolist(), int(sizes.sum())]
        raw = b"".join(parts)
        return [raw[a:b] for a, b in zip([0, *ends], ends)] if chunks else []


class Memo:
    """Results by chunk of text, for the chunks that come up again; starts anew when full."""

    def __init__(self, compute, chunks_of, limit: int = MEMO_WORDS):
        self.compute, self.chunks_of, self.limit, self.known = compute, chunks_of, limit, {}

    def __call__(self, texts: list[str]) -> list[list]:
        split = [self.chunks_of(t) for t in texts]
        known = self.known
        out = [list(map(known.get, chunks)) for chunks in split]
        open_ = [[i for i, r in enumerate(own) if r is None] for own in out]
        missing = list({chunks[i] for chunks, at in zip(split, open_) for i in at})
        if len(known) + len(missing) > self.limit:
            known.clear()
        for start in range(0, len(missing), 20_000):
            part = missing[start : start + 20_000]
            known.update(zip(part, self.compute(part)))
        for own, chunks, at in zip(out, split, open_):
            for i in at:
                own[i] = known[chunks[i]]
        return out

    def forget(self) -> None:
        """Free the results; the encoder itself stays open."""
        self.known = {}


_OPEN: dict = {}


def opened(kind: str, path: str, make):
    """One encoder of a kind per Python worker and file; workers are used for many tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (kind, path)
    if key not in _OPEN:
        _OPEN[key] = make(path)
    return _OPEN[key]


#: Chunks of a text between which no token and no normalisation of word vocabularies reaches.
word_chunks = re.compile(r"[^\x20\x09-\x0D]+").findall
#: Fixed value: white space as byte-level patterns see it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Chunks of a text whose borders every byte-level pattern of this family keeps: a run of other characters
#: with at most one space before it, or white space.
byte_chunks = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall


def word_ids(path: str) -> Memo:
    return opened("ranks", path, lambda p: Memo(RankArrayEncoder(p).encode_chunks, word_chunks))
