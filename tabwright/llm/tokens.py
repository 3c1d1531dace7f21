"""Token ids of whole texts by a ``tokenizers`` file, with one library call per distinct piece of text.

A byte-level pre-tokenizer never lets a token reach across "visible character, space": a space either starts a
token or stands in a run of white space that began after the last visible character. So a text may be cut
before every space that follows a visible character, the pieces encoded alone, and the ids joined. For the
same reason a piece may be cut between a letter and one of ``.,;:!?``, and after one line end that follows.
Pieces repeat, so a bounded memo of the worker answers most of them. Other tokenizers get each text whole.
A text is first split at the tokenizer's added tokens, whose ids stand in between.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_LIMIT = 1_000_000  # pieces a worker remembers; beyond it the memo starts anew
BATCH_CHARS = 4_000_000  # characters encoded together
_WS_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
_WORD_STOP = re.compile(r"([^\W\d_]+)([.,;:!?]\n?)(.*)", re.S)
_STOPS = frozenset(".,;:!?")
_SPACES = frozenset(c for c in map(chr, range(0x3001)) if c.isspace())
_ENCODERS: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """``encode_many(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes (null text: none).

    With ``added`` they are those of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``; without it
    the strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                     and not pre.get("add_prefix_space") and pre.get("use_regex", True))
        tokens = [t for t in spec.get("added_tokens") or [] if t["content"]] if added and self.cuts else []
        self.added_ids = {t["content"]: array("I", [t["id"]]).tobytes() for t in tokens}
        longest_first = sorted(map(re.escape, self.added_ids), key=len, reverse=True)
        self.added = re.compile(f"({'|'.join(longest_first)})") if tokens else None
        # such tokens take in or look at what stands beside them; texts that hold any are left to the library
        self.added_whole = any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip"))
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.opens = np.zeros(self.vocab_size, bool)  # ids that start with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("\u0120")
        self.space = self._whole([" "])[0]
        self.first: dict[str, bytes] = {}   # pieces as they are
        self.spaced: dict[str, bytes] = {}  # pieces without their leading space

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of alphabetic words, each after a space: many in one call, told apart by that space."""
        for lo in range(0, len(words), 2000):
            part = words[lo:lo + 2000]
            text = " " + " ".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at = (np.flatnonzero(self.opens[ids]) * 4).tolist()
            if len(at) == len(part):
                raw = ids.tobytes()
                yield from map(raw.__getitem__, map(slice, at, [*at[1:], len(raw)]))
            else:
                yield from self._whole([" " + p for p in part])

    def _learn(self, pieces: set[str], memo: dict[str, bytes], prefix: str) -> None:
        """Put the ids of new pieces into a memo; what stands before and after a mark is looked up by itself."""
        words, whole, parts = [], [], {}
        for p in pieces:
            if p.isalpha():
                words.append(p)
                continue
            if p[-1] in _STOPS and p[:-1].isalpha():
                parts[p] = (p[:-1], p[-1], "")
                continue
            m = _WORD_STOP.fullmatch(p)
            if m and m[1].isalpha() and not m[3].startswith((" ", "\n")) and (
                    not m[3] or (m[2][-1] == "\n" or m[3][0].isalpha()) and m[3][0] not in _SPACES):
                parts[p] = m.groups()
            else:
                whole.append(p)
        words.extend({m[0] for m in parts.values()}.difference(memo, words))
        memo.update(zip(whole, self._whole([prefix + p for p in whole]), strict=True))
        memo.update(zip(words, self._words(words) if prefix else self._whole(words), strict=True))
        if parts:
            tails = {x for m in parts.values() for x in m[1:] if x}.difference(self.first)
            self.first.update(zip(tails, self._whole(list(tails)), strict=True))
            first = self.first
            for p, m in parts.items():
                memo[p] = memo[m[0]] + first[m[1]] + (first[m[2]] if m[2] else b"")

    def _known(self, pieces: set[str], memo: dict[str, bytes], prefix: str) -> dict[str, bytes]:
        unknown = pieces.difference(memo)
        if unknown:
            if len(memo) + len(unknown) > MEMO_LIMIT:
                memo.clear()
                unknown = pieces
            self._learn(unknown, memo, prefix)
        return memo

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        held = [i for i, t in enumerate(texts) if t and self.added.search(t)] if self.added else []
        if not held:
            return self._plain(texts)
        out: list[bytes | None] = list(texts)
        if self.added_whole:
            for i, ids in zip(held, self._whole([texts[i] for i in held]), strict=True):
                out[i] = ids
        else:
            split = [self.added.split(texts[i]) for i in held]
            between = iter(self._plain([x for p in split for x in p[::2]]))
            for i, p in zip(held, split, strict=True):
                out[i] = b"".join([self.added_ids[x] if k % 2 else next(between) for k, x in enumerate(p)])
        rest = sorted(set(range(len(texts))).difference(held))
        for i, ids in zip(rest, self._plain([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _plain(self, texts: list[str | None]) -> list[bytes]:
        if not self.cuts:
            return [i if t else b"" for t, i in zip(texts, self._whole([t or "" for t in texts]), strict=True)]
        out = [b""] * len(texts)
        joined = [i for i, t in enumerate(texts) if t and not _WS_SPACE.search(t)]
        if joined:
            for i, ids in zip(joined, self._by_space([texts[i] for i in joined]), strict=True):
                out[i] = ids
        cut = {i: _CUT.split(texts[i]) for i in sorted({i for i, t in enumerate(texts) if t}.difference(joined))}
        first = self._known({x for p in cut.values() for x in p}, self.first, "")
        for i, p in cut.items():
            out[i] = b"".join([first[x] for x in p])
        return out

    def _by_space(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, none empty, that have no white space before a space. Arrow splits them and numbers the distinct
        pieces, so that only those are looked up one by one."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        at = split.offsets.to_numpy()
        pieces = split.flatten().dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        code = pieces.indices.to_numpy().astype(np.int64)
        opening = [distinct[c] for c in code[at[:-1]].tolist()]
        first = self._known(set(opening) - {""}, self.first, "")
        begins = [first[p] if p else b"" for p in opening]
        rest = self._known(set(distinct) - {""}, self.spaced, " ")
        values = [rest[p] if p else self.space for p in distinct] + begins  # a space at the end stands alone
        code[at[:-1]] = len(distinct) + np.arange(len(texts))  # a text's first piece has no space before it
        pool = np.frombuffer(b"".join(values), "<u4")
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        n = size.take(code)
        ends = np.cumsum(n)
        place = np.repeat((np.cumsum(size) - size).take(code) - (ends - n), n)
        place += np.arange(len(place))
        raw = pool.take(place).tobytes()
        stops = (ends[at[1:] - 1] * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def stream(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids text by text; ``BATCH_CHARS`` bounds what is worked on at once (one text is never cut)."""
        held, chars = [], 0
        for t in texts:
            held.append(t)
            chars += len(t or "")
            if chars >= BATCH_CHARS or len(held) >= 10_000:
                yield from self.encode_many(held)
                held, chars = [], 0
        yield from self.encode_many(held)


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a tokenizer file; the memo lives on between tasks of a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path, added=True)
    return _ENCODERS[path]
