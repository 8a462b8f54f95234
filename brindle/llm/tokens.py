"""Token ids of whole texts with the tokenizers library, encoded once per distinct chunk.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so the ids of the chunks,
joined, are the ids of the text; each worker keeps the ids of chunks it has met. Cutting less often
than the tokenizer is always right, so any text with unusual white space is cut at fewer places.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks a worker keeps (about 200 bytes each); when reached, it starts anew. It bounds memory and
#: changes no result.
CHUNKS_KEPT = 1_000_000
#: Chunks encoded in one call, between two of the vocabulary's own separators.
RUN = 64
#: Code points of text that are cut and looked up together.
TOGETHER = 1 << 22

#: Python counts U+001C-U+001F as white space, the tokenizers do not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: In the words of Arrow's expressions: any white space of either kind but space and line feed, and for
#: byte-level vocabularies two of these in a row or one at an end.
_OTHER_SPACE = r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNUSUAL_FOR = {True: _OTHER_SPACE, False: _OTHER_SPACE + r"|[ \n][ \n]|\A[ \n]|[ \n]\z|\A\z"}
_BEFORE_WORD = re.compile(r"(?<=\S)(?= \S)")
#: Both pre-tokenizers cut between a letter and a following mark other than an apostrophe.
_MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
_WORD_THEN_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+)\Z")
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Stands between chunks in a run; a chunk that holds it, or white space, is encoded alone.
_BETWEEN = {True: "\x01", False: "\n"}
_ALONE = {True: re.compile(r"[\x01\s]"), False: re.compile(r"\s|\A\Z")}


class Encoder:
    """``word_ends``: the vocabulary drops white space (word ends are part of its tokens)."""

    def __init__(self, path: str, word_ends: bool):
        # a task has a core: threads of the library would only wait for each other
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = True  # control strings in a text are ordinary text
        self.word_ends = word_ends
        (self.between,) = self.tokenizer.encode(_BETWEEN[word_ends], add_special_tokens=False).ids
        # ids of tokens that begin with a space (byte-level vocabularies write it so)
        self.after_space = np.zeros(self.vocabulary, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.after_space[i] = token.startswith("\u0120")
        # of words of letters the normalizer lower-cases, and the pre-tokenizer cuts at white space only: a plain one does
        self.plain = Tokenizer.from_file(path)
        self.plain.no_padding()
        self.plain.no_truncation()
        self.plain.encode_special_tokens = True
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # ids of tokens that end a word (vocabularies with word ends write it so)
        self.word_end = np.zeros(self.vocabulary, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.word_end[i] = token.endswith("</w>")
        # chunk -> its ids as little-endian unsigned 32-bit bytes; those in ``spaced`` have a space before
        self.bare: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _plain(self, chunk: str) -> bytes:
        return np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, known: dict[str, bytes], prefix: str, chunks: set[str]) -> None:
        """Encodes new chunks, many in a call, and keeps their ids."""
        halves = {c: m.groups() for c in chunks if c[-1:] in _MARKS and (m := _WORD_THEN_MARKS.match(c))}
        heads = {h for h, _ in halves.values()}
        tails = {t for _, t in halves.values()}.difference(self.bare)
        for own, before, new in ((known, prefix, list(chunks.difference(halves).union(heads).difference(known))), (self.bare, "", list(tails))):
            if self.word_ends:
                new = self._learn_words(own, new)
            if "" in new or _ALONE[self.word_ends].search("\0".join(new)):
                alone = {c for c in new if _ALONE[self.word_ends].search(c)}
                for c in alone:
                    own[c] = self._plain(before + c)
                new = [c for c in new if c not in alone]
            groups = [new[k : k + RUN] for k in range(0, len(new), RUN)]
            if before:  # the space before each chunk begins its first token, and no other
                texts = [before + before.join(group) for group in groups]
            elif self.word_ends:
                texts = [f" {_BETWEEN[True]} ".join(group) for group in groups]
            else:
                texts = [_BETWEEN[False].join(group) for group in groups]
            for group, got in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.asarray(got.ids, "<u4")
                if before:
                    starts = np.flatnonzero(self.after_space[ids])
                    ends = np.r_[starts[1:], len(ids)]
                else:
                    ends = np.r_[np.flatnonzero(ids == self.between), len(ids)]
                    starts = np.r_[0, ends[:-1] + 1]
                data = ids.tobytes()
                own.update(zip(group, map(data.__getitem__, map(slice, (4 * starts).tolist(), (4 * ends).tolist())), strict=True))
        for c, (head, tail) in halves.items():
            known[c] = known[head] + self.bare[tail]

    def _learn_words(self, own: dict[str, bytes], new: list[str]) -> list[str]:
        """Encodes the words of letters among new chunks, for vocabularies with word ends; returns the others."""
        words = [c for c in new if _LETTERS.fullmatch(c)]
        groups = [words[k : k + RUN] for k in range(0, len(words), RUN)]
        for group, got in zip(groups, self.plain.encode_batch_fast([" ".join(group).lower() for group in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            ends = (4 * np.flatnonzero(self.word_end[ids]) + 4).tolist()
            data = ids.tobytes()
            own.update(zip(group, [data[a:b] for a, b in zip([0, *ends], ends)], strict=True))
        return [c for c in new if c not in own]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, little-endian unsigned 32-bit."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, about ``TOGETHER`` code points at a time."""
        out: list[bytes] = []
        first = size = 0
        for k, text in enumerate(texts, 1):
            size += len(text)
            if size >= TOGETHER or k == len(texts):
                if len(self.bare) + len(self.spaced) > CHUNKS_KEPT:
                    self.bare.clear()
                    self.spaced.clear()
                out += self._encode(texts[first:k])
                first, size = k, 0
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        unusual = pc.match_substring_regex(column, _UNUSUAL_FOR[self.word_ends]).to_numpy(zero_copy_only=False).astype(bool)
        if not unusual.any():
            return self._usual(column)
        out = [b""] * len(texts)
        for which, got in ((~unusual, self._usual(column.filter(pa.array(~unusual)))), (unusual, self._unusual([texts[i] for i in np.flatnonzero(unusual)]))):
            for i, ids in zip(np.flatnonzero(which).tolist(), got, strict=True):
                out[i] = ids
        return out

    def _usual(self, column: pa.Array) -> list[bytes]:
        """Of texts whose only white space are spaces and line feeds, for byte-level vocabularies single ones between other
        characters: each distinct chunk is looked up once, and the ids of all are taken by place."""
        words = pc.split_pattern(pc.replace_substring(column, "\n", " " if self.word_ends else " \n "), " ")
        ends = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        code, chunks = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.word_ends:
            self.bare[""] = b""
            ids = self._known(self.bare, "", chunks)
        else:  # a line's first chunk, and the line feed, have no space before them
            feed = next((i for i, c in enumerate(chunks) if c == "\n"), -1)
            bare = code == feed
            bare[1:] |= bare[:-1]
            bare[ends[:-1]] = True
            own = np.unique(code[bare])
            place = np.zeros(len(chunks), "i4")
            place[own] = np.arange(len(chunks), len(chunks) + len(own))
            there = np.zeros(len(chunks), bool)
            there[code[~bare]] = True
            spaced = np.flatnonzero(there)
            # chunks with a space before stand at their code, the others behind them
            ids = np.full(len(chunks) + len(own), b"", object)
            ids[spaced] = self._known(self.spaced, " ", [chunks[i] for i in spaced.tolist()])
            ids[len(chunks) :] = self._known(self.bare, "", [chunks[i] for i in own.tolist()])
            code = np.where(bare, place[code], code)
        taken = pa.array(ids, pa.large_binary()).take(pa.array(code))
        places = np.frombuffer(taken.buffers()[1], "i8")[ends].tolist() if len(code) else [0] * len(ends)
        data = memoryview(taken.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(places, places[1:])]

    def _known(self, known: dict[str, bytes], prefix: str, chunks: list[str]) -> list[bytes]:
        got = list(map(known.get, chunks))
        if None in got:
            self._learn(known, prefix, {c for c, ids in zip(chunks, got, strict=True) if ids is None})
            got = list(map(known.__getitem__, chunks))
        return got

    def _unusual(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if not self.word_ends:
                chunks = _BEFORE_WORD.split(text)
            else:
                chunks = re.split("[ \n\t\r]+", text) if _SEPARATORS.search(text) else text.split()
            if new := set(chunks).difference(self.bare):
                self._learn(self.bare, "", new)
            out.append(b"".join(map(self.bare.__getitem__, chunks)))
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, word_ends: bool) -> Encoder:
    """One per worker process, kept between tasks."""
    if (path, word_ends) not in _encoders:
        _encoders[path, word_ends] = Encoder(path, word_ends)
    return _encoders[path, word_ends]
