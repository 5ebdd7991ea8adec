"""Byte-level BPE ids and counts for whole batches of texts.

A batch is cut into pre-tokens with numpy on code points, equal pre-tokens are
looked up once, and only pre-tokens that are not whole vocabulary entries are
merged.  Results equal those of ``tokenizers`` for the same ``.json`` file
(``add_special_tokens=False``): character classes are asked of that library,
special strings inside a text send this text to it, and a file of another kind
is served by it altogether.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np

from faultline.llm.arrow import trim

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 1, 2, 0, 3, 255
CHUNK = 1 << 18                   # code points worked on at a time
CACHE = 1 << 19                   # remembered pre-tokens of one worker, over CHUNK
ODD = np.uint64(0x9E3779B97F4A7C15)


def token_path(name: str) -> str:
    """A path as it is, or the name of one of the installed public files."""
    import os
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (wraps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = 0x2545F4914F6CDD1D) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    inv = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inv):
        p = np.empty(n, np.uint64)
        p[0] = 1
        k = 1
        while k < n:
            m = min(k, n - k)
            p[k:k + m] = p[:m] * np.uint64(pow(b, k, 1 << 64))
            k += m
        out.append(p)
    return out[0], out[1]


class ByteBpe:
    """Tokenizer of one worker; keeps at most ``CACHE`` pre-tokens between calls."""

    _made: dict[str, "ByteBpe"] = {}

    @classmethod
    def get(cls, path: str) -> "ByteBpe":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        vocab = model.get("vocab")
        alphabet = byte_alphabet()
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]] \
            if model.get("type") == "BPE" else []
        self.fast = bool(
            merged and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
            and not spec["normalizer"] and not model.get("dropout") and not model.get("ignore_merges")
            and merged == sorted(set(merged)) and all(set(v) <= alphabet.keys() for v in vocab if v not in self.specials))
        if not self.fast:
            return
        import tiktoken
        ranks = {bytes(alphabet[c] for c in v): i for v, i in vocab.items() if v not in self.specials}
        self.merger = tiktoken.Encoding(path, pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        # Proof, once, that a vocabulary string alone becomes one token; the
        # others that can be text are kept apart, as merging never reaches them.
        texts = {}
        for v, i in ranks.items():
            try:
                texts[v.decode()] = i
            except UnicodeDecodeError:
                pass
        keys = list(texts)
        self.whole = {k: texts[k] for k in keys if self.lib.encode(k, add_special_tokens=False).ids == [texts[k]]}
        self.apart = set(texts) - set(self.whole)
        del spec, pre, model, vocab, merged, ranks, texts, keys
        trim()
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.salt = mix(np.arange(1, 0x110001, dtype=np.uint64) * ODD)
        self.pow, self.inv = powers(CHUNK + 1)
        self._forget()

    def _forget(self) -> None:
        """An empty store: an open-addressing table of keys, and the ids of each entry."""
        self.keys, self.at = np.zeros(2 * CACHE, np.uint64), np.zeros(2 * CACHE, np.int32)
        self.n = self.used = 0
        self.off, self.cnt = np.zeros(CACHE, np.int64), np.zeros(CACHE, np.int32)
        self.merged, self.flat = np.zeros(CACHE, bool), np.zeros(1 << 20, np.uint32)

    # -- pre-tokens -------------------------------------------------------

    def _class(self, cps: np.ndarray) -> np.ndarray:
        got = self.kind[cps]
        if (got == UNKNOWN).any():
            for c in np.unique(cps[got == UNKNOWN]).tolist():
                ch, cut = chr(c), lambda s: len(self.lib.pre_tokenizer.pre_tokenize_str(s))
                self.kind[c] = (LETTER if cut("a" + ch) == 1 else NUMBER if cut("1" + ch) == 1
                                else OTHER if cut("!" + ch) == 1 else SPACE)
            got = self.kind[cps]
        return got

    def _starts(self, cps: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens start; ``first`` marks the starts of texts."""
        n, cls = len(cps), self._class(cps)
        run = first.copy()
        run[1:] |= cls[1:] != cls[:-1]
        start = run.copy()
        edge = np.flatnonzero(run)
        last = np.append(edge[1:], n) - 1
        ends = np.append(first[1:], True)                         # the text's last character
        space = last[(cls[edge] == SPACE) & ~ends[last]]          # last one of white space before a word
        start[space] = True
        start[space[cps[space] == 32] + 1] = False                # a blank joins what follows
        tick = np.flatnonzero(start & (cps == 39))
        for tail in ("s", "t", "m", "d", "re", "ve", "ll"):
            k = len(tail)
            at = tick[tick + k < n]
            for j, c in enumerate(tail, 1):
                at = at[(cps[at + j] == ord(c)) & ~first[at + j]]
            start[at + 1] = False
            nxt = at[at + k + 1 < n] + k + 1
            start[nxt[cls[nxt] == LETTER]] = True                 # text starts are marked anyway
        return np.flatnonzero(start)

    def _slots(self, key: np.ndarray) -> np.ndarray:
        """The slot that holds each key, or the empty one where it belongs."""
        slot = (key >> np.uint64(64 - (2 * CACHE).bit_length() + 1)).astype(np.int64)
        got = self.keys[slot]
        left = np.flatnonzero((got != key) & (got != 0))
        while len(left):
            slot[left] = (slot[left] + 1) % (2 * CACHE)
            got = self.keys[slot[left]]
            left = left[(got != key[left]) & (got != 0)]
        return slot

    def _entries(self, text: str, cps: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Entry of each pre-token in the store, merging those not met before."""
        h = np.zeros(len(cps) + 1, np.uint64)
        np.cumsum(self.salt[cps] * self.pow[:len(cps)], out=h[1:])
        e = np.append(s[1:], len(cps))
        key = mix((h[e] - h[s]) * self.inv[s] + (e - s).astype(np.uint64) * ODD) | np.uint64(1)
        slot = self._slots(key)
        new = np.flatnonzero(self.keys[slot] == 0)
        if len(new):
            fresh, one = np.unique(key[new], return_index=True)
            if self.n + len(fresh) > CACHE:
                self._forget()
                return self._entries(text, cps, s)
            one = new[one]
            self._add([text[a:b] for a, b in zip(s[one].tolist(), e[one].tolist(), strict=True)], fresh)
            slot = self._slots(key)
        return self.at[slot]

    def _add(self, pieces: list[str], key: np.ndarray) -> None:
        whole, apart, merge = self.whole.get, self.apart, self.merger.encode_ordinary
        ids, merged = [], np.zeros(len(pieces), bool)
        for i, p in enumerate(pieces):
            one = whole(p)
            if one is None:
                merged[i] = True
                ids.append(self.lib.encode(p, add_special_tokens=False).ids if p in apart else merge(p))
            else:
                ids.append((one,))
        cnt = np.array(list(map(len, ids)), np.int32)
        end = self.used + int(cnt.sum())
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        new = slice(self.n, self.n + len(pieces))
        self.flat[self.used:end] = np.fromiter(chain.from_iterable(ids), np.uint32, end - self.used)
        self.cnt[new], self.merged[new] = cnt, merged
        self.off[new] = self.used + np.cumsum(cnt) - cnt
        left, val = np.arange(len(key)), np.arange(self.n, self.n + len(key), dtype=np.int32)
        while len(left):                                          # equal slots: one key wins, the rest look on
            slot = self._slots(key[left])
            self.keys[slot] = key[left]
            won = self.keys[slot] == key[left]
            self.at[slot[won]] = val[left[won]]
            left = left[~won]
        self.used, self.n = end, self.n + len(pieces)

    # -- batches ----------------------------------------------------------

    def _parts(self, texts: list[str]):
        """Pieces of texts with at most CHUNK code points in all: lists of (text number, piece)."""
        group, size = [], 0
        for i, t in enumerate(texts):
            at = 0
            while at < len(t):
                cut = len(t) if len(t) - at <= CHUNK else safe_cut(t, at, CHUNK)
                if group and size + cut - at > CHUNK:
                    yield group
                    group, size = [], 0
                group.append((i, t[at:cut]))
                size += cut - at
                at = cut
        if group:
            yield group

    def _runs(self, texts: list[str]):
        """For each chunk: text number and entry of every pre-token."""
        for group in self._parts(texts):
            if sum(len(p) for _, p in group) > CHUNK:             # one text without a place to cut
                yield group[0][0], None, group[0][1]
                continue
            text = "".join(p for _, p in group)
            cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            begin = np.cumsum([0] + [len(p) for _, p in group[:-1]])
            first = np.zeros(len(cps), bool)
            first[begin] = True
            s = self._starts(cps, first)
            ent = self._entries(text, cps, s)
            owner = np.array([i for i, _ in group])[np.searchsorted(begin, s, "right") - 1]
            yield owner, ent, None

    def _special(self, text: str) -> bool:
        return not self.fast or any(x in text for x in self.specials)

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and how many of them were whole pre-tokens."""
        own = [self._special(t) for t in texts]
        n, whole = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for owner, ent, long in self._runs([("" if o else t) for t, o in zip(texts, own, strict=True)]):
            if ent is None:
                n[owner] += len(self.lib.encode(long, add_special_tokens=False).ids)
                continue
            n += np.bincount(owner, self.cnt[ent], len(texts)).astype(np.int64)
            whole += np.bincount(owner, ~self.merged[ent], len(texts)).astype(np.int64)
        for i in np.flatnonzero(own):
            n[i] = len(self.lib.encode(texts[i], add_special_tokens=False).ids)
        return n, whole

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text."""
        own = [self._special(t) for t in texts]
        got: list[list[np.ndarray]] = [[] for _ in texts]
        for owner, ent, long in self._runs([("" if o else t) for t, o in zip(texts, own, strict=True)]):
            if ent is None:
                got[owner].append(np.array(self.lib.encode(long, add_special_tokens=False).ids, np.uint32))
                continue
            c = self.cnt[ent]
            at = np.repeat(self.off[ent] - np.cumsum(c) + c, c)
            ids = self.flat[at + np.arange(len(at))]
            upto = np.cumsum(c)
            edge = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
            a = 0
            for k in edge.tolist():
                got[owner[k]].append(ids[a:upto[k]])
                a = upto[k]
        for i in np.flatnonzero(own):
            got[i] = [np.array(self.lib.encode(texts[i], add_special_tokens=False).ids, np.uint32)]
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.empty(0, np.uint32) for x in got]


def safe_cut(t: str, at: int, size: int) -> int:
    """A place in (at, at + size] where a pre-token always starts: a blank between
    a non-blank and an ASCII letter.  Without one, the end of the text."""
    import re
    for hi in range(at + size, at, -4096):
        lo = max(at + 1, hi - 4096)
        found = [m.start() for m in re.finditer(r"(?<=[!-~]) (?=[A-Za-z])", t[lo - 1:hi + 1])]
        if found:
            return lo - 1 + found[-1]
    return len(t)
