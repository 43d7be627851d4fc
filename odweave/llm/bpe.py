"""Vocabularies of public tokenizers in Python workers: built once in each, from a file's bytes."""

from __future__ import annotations

import base64
import hashlib
import json
import os

import numpy as np

#: Chunks whose ids a worker remembers before it forgets them all and begins anew.
REMEMBERED = 300_000
#: Characters of texts whose chunks are looked up together, and most new chunks that are encoded in one call.
TOGETHER, CALL = 1 << 20, 20_000

_built: dict[tuple, object] = {}


def _once(kind: type, *args):
    key = (kind.__name__, *(hashlib.sha1(a if isinstance(a, bytes) else a.encode()).hexdigest() for a in args))
    if key not in _built:
        _built[key] = kind(*args)
    return _built[key]


class ByteBpe:
    """A byte-level vocabulary given as ranks, and the pattern that splits texts into pieces."""

    def __init__(self, raw: bytes, pattern: str):
        import regex
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.split = regex.compile(pattern).findall
        self.encode_piece = self.library._core_bpe.encode_single_piece

    def token_bytes(self) -> list[bytes]:
        """The token-byte table."""
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            tokens[r] = t
        return tokens


class WordBpe:
    """A vocabulary of the tokenizers library that drops white space and never merges across it.

    Words are merged by tiktoken, which is several times faster on words that are new, and many of them in one
    call. Its input marks a word's end by a letter that lower-cased text lacks; that byte joins the one before it
    ahead of all merges, which gives the vocabulary's word-end symbols, and merges follow in the vocabulary's order.
    A merge's two sides are what earlier merges make of them, so that rank by result and rank by pair choose the
    same merges. A space between chunks is a word of its own here, whose rank tells where a chunk ends.
    """

    MARK, SPACE = "Z", 32

    def __init__(self, raw: bytes, specials: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(raw.decode())
        self.library.encode_special_tokens = specials == "text"
        spec = json.loads(raw)
        #: Texts with such a name go to the library, which knows what the name stands for.
        self.names = [t["content"] for t in spec.get("added_tokens", []) if specials != "text" or not t["special"]]
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        chars = byte_alphabet()
        back = {c: b for b, c in chars.items()}
        mark = self.MARK.encode()
        to_bytes = lambda t: bytes(back[c] for c in t.removesuffix(suffix)) + mark * t.endswith(suffix)
        ranks = {bytes([b]) + mark: b for b in range(256)} | {bytes([b]): 256 + b for b in range(256)}
        ids = [vocab[chars[b] + suffix] for b in range(256)] + [vocab[chars[b]] for b in range(256)]
        for m in spec["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            if self.MARK not in a + b:  # in lower-cased text none else occurs
                ranks[to_bytes(a + b)] = len(ids)
                ids.append(vocab[a + b])
        marked = f"[^{self.MARK}]+{self.MARK}"
        self.words = tiktoken.Encoding("own", pat_str=marked, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        self.ids = np.array(ids, "<u4")
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "| ").findall
        #: Characters beyond ASCII whose lower case and normal form are the same to Python and to the library
        #: aren't odd: Latin letters but those with an irregular case, and the punctuation around dashes.
        self.odd = regex.compile("[^\x21-\x7e\xa1-\xff\u0100-\u012f\u0131\u0139-\u0148\u014a-\u017e\u2010-\u2027]").search
        self.chunks: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """Remember the ids of chunks."""
        beyond = [c for c in new if not c.isascii()]
        odd = {c for c in beyond if self.odd(c)} if self.odd("".join(beyond)) else ()
        self.chunks.update((c, self._whole(c)) for c in odd)
        rest = [c for c in new if c not in odd] if odd else new
        for k in range(0, len(rest), CALL):
            part = rest[k : k + CALL]
            words = self.words(self.MARK.join(self.split(" ".join(part).lower())) + self.MARK, disallowed_special=())
            ends, data = [*np.flatnonzero(words == self.SPACE).tolist(), len(words)], self.ids[words].tobytes()
            self.chunks.update((c, data[4 * x + 4 : 4 * y]) for c, x, y in zip(part, [-1, *ends], ends, strict=False))

    def _join(self, out: list[bytes], held: list[tuple[int, list[str]]]) -> None:
        """Put the ids of texts, given as chunks, at their places."""
        if len(self.chunks) > REMEMBERED:
            self.chunks.clear()
        occur = set().union(*[c for _, c in held])
        self._learn([c for c in occur if c not in self.chunks])
        # a small table of what occurs here is looked up faster than the large one
        ids = {c: self.chunks[c] for c in occur}
        for at, chunks in held:
            out[at] = b"".join(map(ids.__getitem__, chunks))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        White space splits a text into chunks, and a worker remembers the ids of chunks. Python also splits
        at U+001C to U+001F, which the library takes for ordinary characters: texts that hold one go to the
        library whole, and so do those with a name of an added token.
        """
        out, held, size = [], [], 0
        for t in texts:
            if any(map(t.__contains__, ("\x1c", "\x1d", "\x1e", "\x1f", *self.names))):
                out.append(self._whole(t))
                continue
            held.append((len(out), t.split()))
            out.append(b"")
            size += len(t)
            if size >= TOGETHER:
                self._join(out, held)
                held, size = [], 0
        self._join(out, held)
        return out


class LevelBpe:
    """A byte-level vocabulary of the tokenizers library, with the ids that the library gives.

    tiktoken encodes most texts, several times faster: ids of such a vocabulary rise with the order of its merges,
    so that they serve as ranks. Texts with an added token's name, or with characters beyond ``PLAIN``, on whose
    class the two libraries' tables of Unicode may differ, go to the library. The pattern's lookahead only matters
    in texts with white space of two or more; the others are split by a pattern without it, which is faster.
    """

    #: The splitting pattern of the library's byte level, and the same without its lookahead.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    SHORT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
    #: Latin, Greek and Cyrillic letters, punctuation, kana, Han and Hangul that no version of Unicode has moved since.
    PLAIN = "\x00-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u045f\u2010-\u2027\u3001-\u3003\u3041-\u3096\u30a1-\u30fc\u4e00-\u9fa5\uac00-\ud7a3"

    def __init__(self, raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library, spec = Tokenizer.from_str(raw.decode()), json.loads(raw)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        back = {c: b for b, c in byte_alphabet().items()}
        ids = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        self.fast = bool(level and plain and spec["normalizer"] is None and ids == sorted(ids) and len(model["vocab"]) == len(ids) + 256)
        names = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.odd = regex.compile("|".join([f"[^{self.PLAIN}]", *names])).search
        self.spaces = regex.compile(r"\s\s").search
        if self.fast:
            ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items()}
            make = lambda p: tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
            self.long, self.short = make(self.PATTERN), make(self.SHORT)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers."""
        out = []
        for t in texts:
            if not self.fast or self.odd(t):
                out.append(np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32))
            else:
                out.append((self.long if self.spaces(t) else self.short)(t, disallowed_special=()))
        return out


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in sorted(plain)} | {b: chr(256 + i) for i, b in enumerate(rest)}


def byte_bpe(raw: bytes, pattern: str) -> ByteBpe:
    """The vocabulary of a rank file."""
    return _once(ByteBpe, raw, pattern)


def word_bpe(raw: bytes, specials: str = "ids") -> WordBpe:
    """The vocabulary of a tokenizers file. The names of its special tokens are their ids, or ordinary text."""
    if specials not in ("ids", "text"):
        raise ValueError("special tokens are ids or text")
    return _once(WordBpe, raw, specials)


def level_bpe(raw: bytes) -> LevelBpe:
    """The byte-level vocabulary of a tokenizers file."""
    return _once(LevelBpe, raw)


def vocabulary(path: str) -> bytes:
    """A vocabulary file's bytes, read on the driver (under 2 MB); tasks get them with their code."""
    with open(path, "rb") as f:
        return f.read()
