"""BPE encoding and decoding by batched numpy merge rounds.

Symbols of many distinct words lie in one flat array. Each round looks every adjacent pair up by
binary search in the sorted array of pair keys, takes each word's lowest rank, and merges all its
occurrences at once. Words that have no mergeable pair left are set aside, so the array shrinks.

Two vocabulary kinds are read from the public tokenizer files: byte-level BPE (``byte``) and
lower-cased BPE with word ends (``word``). Encoders keep a bounded cache from whitespace-delimited
chunks to ids; a chunk's ids don't depend on its neighbours, so the cache never changes a result.

Defined cases: null and empty text have no ids; special tokens written out in a text become their
own id, as in the tokenizers library; repeated rows are encoded alike; any row order is kept.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import regex

#: The pre-tokenisation patterns that the two public vocabularies state.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: First letters of chunks' names: a mark tied to what precedes it, a text's first chunk, one after a line feed, a piece inside a chunk.
TIED, FIRST, LINE, PIECE = "\x00", "\x01", "\x02", "\x03"
#: Texts that hold these, or white space of Python's that isn't any to the patterns' engine, are cut by the pattern.
ODD = re.compile("[\x00-\x03\x1c-\x1f]")
#: Marks that stand as a piece of their own between letters and a blank, in either pattern, and what they are replaced by.
TIES = tuple((mark + " ", " " + TIED + mark + " ") for mark in ".,")
TIED_NAMES = (TIED + ".", TIED + ",")
NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte: itself where printable, else the next free letter from 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Symbols, sorted merge pairs and special tokens of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.kind = "word" if self.end else "byte"
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.base = np.array([ids[letters[b]] for b in range(256)], np.int64)
        self.base_end = np.array([ids[letters[b] + self.end] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.size = max(max(ids.values()), *self.special.values(), 0) + 1
        left, right = (np.array([ids[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        #: With one merge per symbol, a new pair always ranks after the merge that made it, so all of a pair may merge at once.
        self.at_once = len(np.unique(made)) == len(made)
        back = {c: b for b, c in letters.items()}
        texts = [b""] * self.size
        for token, i in ids.items():
            texts[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            texts[i] = token.encode()
        self.bytes_len = np.array([len(t) for t in texts], np.int64)
        self.bytes_at = np.cumsum(self.bytes_len) - self.bytes_len
        self.bytes_flat = np.frombuffer(b"".join(texts), np.uint8)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of adjacent symbols among the sorted pair keys by binary search, -1 where they don't merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        at[self.keys[at] != key] = -1
        return at

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has. Words aren't empty."""
        lens = np.array([len(w) for w in words], np.int64)
        if not len(words):
            return np.zeros(0, np.int64), lens
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym, owner = self.base[flat], np.repeat(np.arange(len(words), dtype=np.int32), lens)
        if self.end:
            last = np.cumsum(lens) - 1
            sym[last] = self.base_end[flat[last]]
        # the place of each symbol and the next one of its word; only pairs beside a merge are looked up again
        at = np.full(len(sym), -1, np.int64)
        at[:-1] = self._ranks(sym[:-1], sym[1:])
        at[np.cumsum(lens) - 1] = -1
        ranks = np.append(self.rank, NONE)  # -1 reads the last
        done_sym, done_owner = [], []
        while len(sym):
            found = ranks[at]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least, n = np.minimum.reduceat(found, starts), np.diff(np.r_[starts, len(sym)])
            over = least == NONE
            if over.any():
                gone = np.repeat(over, n)
                done_sym.append(sym[gone])
                done_owner.append(owner[gone])
                if over.all():
                    break
                keep = ~gone
                sym, owner, found, at, least, n = sym[keep], owner[keep], found[keep], at[keep], least[~over], n[~over]
            here = np.flatnonzero(found == np.repeat(least, n))
            if self.at_once:
                # in a run such as "aaa" every other pair merges, from the left
                first = np.r_[True, np.diff(here) != 1]
                run = np.maximum.accumulate(np.where(first, np.arange(len(here)), 0))
                here = here[(np.arange(len(here)) - run) % 2 == 0]
            else:
                here = here[np.r_[True, owner[here[1:]] != owner[here[:-1]]]]
            sym[here] = self.made[at[here]]
            keep = np.ones(len(sym), bool)
            keep[here + 1] = False
            at[here] = at[here + 1]  # for the word's end; the others are looked up
            sym, owner, at = sym[keep], owner[keep], at[keep]
            here -= np.arange(len(here))
            pairs = np.concatenate([here, here[here > 0] - 1])
            pairs = pairs[pairs + 1 < len(sym)]
            pairs = pairs[owner[pairs] == owner[pairs + 1]]
            at[pairs] = self._ranks(sym[pairs], sym[pairs + 1])
            last = here[np.r_[owner[1:] != owner[:-1], True][here]]
            at[last] = -1
        sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
        return sym[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids' bytes in one array, and the running end of each id's bytes."""
        n = self.bytes_len[ids]
        return self.bytes_flat[spread(self.bytes_at[ids], n)], np.cumsum(n)

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(np.asarray(list(ids), np.int64))[0].tobytes().decode("utf-8", "replace")


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indexes of all ranges (start, length), one after another."""
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total)


class Encoder:
    """Whole texts to ids. ``limit`` bounds the chunks that the cache holds; beyond it, those met once go.

    Texts are cut at white space into chunks. A mark that follows letters and precedes a blank becomes a
    chunk of its own, told by ``TIED`` before it, so that words are learned once and not with each mark. Where that
    doesn't hold (the mark stands after another mark), the text is cut at white space alone, and
    where ids depend on the white space itself, by the pattern.
    """

    def __init__(self, path: str, limit: int = 500_000):
        self.vocab = Vocabulary(path)
        self.word = self.vocab.kind == "word"
        self.pattern = regex.compile(WORD_PATTERN if self.word else BYTE_PATTERN)
        self.special = re.compile("(" + "|".join(map(re.escape, self.vocab.special)) + ")") if self.vocab.special else None
        self.marks = {s[:2] for s in self.vocab.special}
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.chunks: dict[str, int] = {}
        #: Ids of all rows; row i's are flat[at[i] : at[i + 1]].
        self.flat = np.zeros(1 << 16, np.uint16 if self.vocab.size <= 1 << 16 else np.uint32)
        self.at, self.rows = np.zeros(1 << 16, np.int64), 0
        #: How often each row was met; whether a tied mark may follow it; whether it is a tied mark.
        self.met, self.open, self.tied = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)

    def _add(self, ids: np.ndarray, lens: np.ndarray) -> int:
        """Keeps rows of ids; the number of the first."""
        used, n = int(self.at[self.rows]), len(lens)
        if used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), self.flat.dtype)])
        if self.rows + n >= len(self.at):
            more = max(len(self.at), n + 1)
            self.at, self.met, self.open, self.tied = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.at, self.met, self.open, self.tied))
        self.flat[used : used + len(ids)] = ids
        self.at[self.rows + 1 : self.rows + n + 1] = used + np.cumsum(lens)
        first, self.rows = self.rows, self.rows + n
        return first

    def _trim(self) -> None:
        """Forgets the chunks that were met once; all of them if that isn't enough."""
        keep = self.met[: self.rows] > 1
        if keep.sum() > self.limit // 2:
            return self._clear()
        old, at, ids = self.chunks, self.at, self.flat
        new = (np.cumsum(keep) - 1).tolist()
        kept, opened, tied = np.flatnonzero(keep), self.open, self.tied
        self._clear()
        self._add(ids[spread(at[kept], at[kept + 1] - at[kept])], at[kept + 1] - at[kept])
        self.open[: len(kept)], self.tied[: len(kept)] = opened[kept], tied[kept]
        keep = keep.tolist()
        self.chunks = {c: new[i] if i >= 0 else i for c, i in old.items() if i < 0 or keep[i]}

    def _normal(self, text: str) -> str:
        """As the vocabulary's normaliser: composed, then lower case letter by letter."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _learn(self, words: list[str], names: list[str]) -> None:
        """Pieces in full (``words``) under the chunks' names."""
        if words:
            first = self._add(*self.vocab.encode_words([w.encode("utf-8", "replace") for w in words]))
            self.chunks.update(zip(names, range(first, first + len(words)), strict=True))
            self.open[first : first + len(words)] = [w[-1].isalnum() for w in words]

    def _name(self, piece: str) -> str:
        """Letters alone, with what precedes them, are a chunk as they stand."""
        body = piece if self.word else piece[1:] if piece[0] == " " else ""
        return body if body.isalpha() else PIECE + piece if piece[0] != " " else piece

    def _learn_chunks(self, new: Iterable[str]) -> None:
        """New chunks; -1 where the ids depend on what stands beside the chunk.

        A name's first letter may tell what precedes the chunk: ``TIED`` or ``FIRST`` nothing, ``LINE`` a line feed; else it is white space (a blank
        for the byte vocabulary). ``PIECE`` names a piece that stands inside a chunk, right after another piece.
        """
        words, names, several = [], [], []
        for c in new:
            if c.isalpha():
                words.append(c if self.word else " " + c)
                names.append(c)
                continue
            lead = c[:1]
            if lead == TIED:
                words.append(c[1:])
                names.append(c)
                continue
            if self.word:
                found = self.pattern.findall(c)
            else:
                body = c[1:] if lead in (FIRST, LINE) else c
                if not body or body[0].isspace() or body[-1].isspace():
                    self.chunks[c] = -1
                    continue
                found = self.pattern.findall(body if lead in (FIRST, LINE) else " " + body)
                if lead == LINE:
                    found = ["\n", *found]
            several.append((c, [self._name(p) for p in found]))
        have = self.chunks
        for p in dict.fromkeys(p for _, found in several for p in found):
            if p not in have:
                words.append(p[1:] if p[0] == PIECE else p if self.word or p[0] == " " else " " + p)
                names.append(p)
        self._learn(words, names)
        if several:
            rows = np.fromiter((have[p] for _, found in several for p in found), np.int64)
            lens = self.at[rows + 1] - self.at[rows]
            ends = np.r_[0, np.cumsum(lens)][np.r_[0, np.cumsum([len(found) for _, found in several])]]
            first = self._add(self.flat[spread(self.at[rows], lens)], np.diff(ends))
            have.update(zip((c for c, _ in several), range(first, first + len(several)), strict=True))
            self.open[first : first + len(several)] = [c[-1].isalnum() for c, _ in several]
        for c in TIED_NAMES:
            if c in have:
                self.tied[have[c]] = True

    def _split(self, text: str, tie: bool) -> list[str]:
        if tie:
            for before, after in TIES:
                text = text.replace(before, after)
        if self.word:
            return text.split()
        parts = text.replace("\n", " " + LINE).split(" ")
        if parts[0]:
            parts[0] = FIRST + parts[0]
            return parts
        return parts[1:]

    def _found(self, split: list[list[str]]) -> list[np.ndarray]:
        """Rows of all chunks, new ones learned."""
        get, absent = self.chunks.get, repeat(-2)
        rows = [np.fromiter(map(get, s, absent), np.int64, len(s)) for s in split]
        late = [np.flatnonzero(r == -2) for r in rows]
        if any(len(x) for x in late):
            self._learn_chunks(dict.fromkeys(s[i] for s, x in zip(split, late, strict=True) for i in x.tolist()))
            for s, r, x in zip(split, rows, late, strict=True):
                if len(x):
                    r[x] = [get(s[k]) for k in x.tolist()]
        return rows

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without special tokens."""
        if len(self.chunks) > self.limit:
            self._trim()
        if self.word:
            texts = [self._normal(t) for t in texts]
        rows: list[np.ndarray | None] = [None] * len(texts)
        todo = [i for i, t in enumerate(texts) if not ODD.search(t)]
        for tie in (True, False):
            again = []
            for i, r in zip(todo, self._found([self._split(texts[i], tie) for i in todo]), strict=True):
                if tie and len(r) and (r.min() < 0 or self.tied[r[0]] or (self.tied[r[1:]] & ~self.open[r[:-1]]).any()):
                    again.append(i)
                elif self.word or not len(r) or r.min() >= 0:
                    rows[i] = r
            todo = again
        whole = {i: self.pattern.findall(re.sub(r"[^\S\x1c-\x1f]+", " ", texts[i]) if self.word else texts[i]) for i, r in enumerate(rows) if r is None}
        if whole:
            get = self.chunks
            new = [p for p in dict.fromkeys(p for found in whole.values() for p in found) if PIECE + p not in get]
            self._learn(new, [PIECE + p for p in new])
            for i, found in whole.items():
                rows[i] = np.fromiter((get[PIECE + p] for p in found), np.int64, len(found))
        if not rows:
            return []
        flat = np.concatenate(rows)
        self.met[: self.rows] += np.bincount(flat, minlength=self.rows)
        lens = self.at[flat + 1] - self.at[flat]
        ids = self.flat[spread(self.at[flat], lens)].astype(np.uint32)
        ends = np.r_[0, np.cumsum(lens)][np.r_[0, np.cumsum([len(r) for r in rows])]]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (uint32) of each text."""
        # very many lists and tuples come and go here, none in a cycle
        pause = gc.isenabled()
        gc.disable()
        try:
            return self._encoded(texts)
        finally:
            if pause:
                gc.enable()

    def _encoded(self, texts: list[str | None]) -> list[np.ndarray]:
        out, parts, owner = [[] for _ in texts], [], []
        for i, t in enumerate(texts):
            t = t or ""
            if self.special and any(m in t for m in self.marks):
                for k, part in enumerate(self.special.split(t)):
                    if part:
                        parts.append(np.array([self.vocab.special[part]], np.uint32) if k % 2 else part)
                        owner.append(i)
            elif t:
                parts.append(t)
                owner.append(i)
        todo = [k for k, p in enumerate(parts) if isinstance(p, str)]
        for k, ids in zip(todo, self._plain([parts[k] for k in todo]), strict=True):
            parts[k] = ids
        for i, p in zip(owner, parts, strict=True):
            out[i].append(p)
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, np.uint32) for x in out]


def portions(texts: list[str | None], most: int = 4_000_000) -> Iterable[tuple[int, int]]:
    """Ranges of rows of about ``most`` characters, at least one row each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file, so that its cache serves all its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
