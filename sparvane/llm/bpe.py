"""Byte-pair encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of its last characters hits a fixed pattern, so a
passage that several documents share yields the same chunks wherever it stands.  A
worker encodes each such chunk once and keeps it in a store of bounded size.  A chunk
keeps the tokens of its inner words (white space on both sides: their tokens can not
depend on the neighbours) apart from its ragged head and tail.  Where two chunks join,
tail and head are encoded anew; the span grows over further chunks as long as no white
space closes it, and from there on stored and fresh tokens agree exactly.

Results equal the tokenizers library's for the word-level vocabularies that it describes
(white space dropped before the merges): words are independent of each other.  Words
of plain letters, digits and signs go straight to the library's merge model, piece by
piece; all others, and texts with the control characters U+001C to U+001F, go through the
library's full path.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import OrderedDict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparvane.llm.common import forgettable, map_batches

VOCABULARY = "word_bpe_49k.json"

#: Fixed values of the vocabulary's splitting rule, for texts of these characters only.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: White space for str.split() but not for the vocabulary's rule.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"\s")
_TO_LAST = re.compile(r"(?s).*\s")
#: Texts on which splitting by words must agree with the library, or the vocabulary is refused.
_PROBES = ("Hello  World's 12 we'll\n", "ab-c É1x!?(…)\tß", " the quick brown fox, 3.14 ")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a public vocabulary file on this machine (executors ask for their own)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """Letter that stands for each byte: itself if it prints, else the next from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


class WordEncoder:
    """Encodes words through the library and remembers them and their pieces.

    A piece is what the vocabulary's splitting rule leaves of a word: letters, a digit,
    signs or a contraction.  ``most`` bounds the words and the pieces in memory; a full
    table starts again.
    """

    def __init__(self, name: str = VOCABULARY, most: int = 500_000) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(name))
        self.model, self.most, self.letters = self.tokenizer.model, most, _byte_letters()
        self.pieces, self.known = _Table(self.piece), _Table(self.word)
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(True))]
        for text in _PROBES:
            ids = self.whole(text)
            if self.words(text) != ids or self.decode(ids) != self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False):
                raise ValueError(f"{name} is not a vocabulary of words split at white space: its ids would be wrong here")

    def whole(self, text: str) -> bytes:
        """The library's own ids."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def word(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word) or "<|" in word:
            return self.whole(word)
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(word.lower())))

    def words(self, text: str) -> bytes:
        """Ids of whole words with any white space around them."""
        for table in (self.known, self.pieces):
            if len(table) > self.most:
                table.clear()
        return b"".join(map(self.known.__getitem__, text.split()))

    def decode(self, ids: bytes) -> str:
        """The library's decoding: the ids' tokens, joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Table(dict):
    """Remembers what ``make`` returns for a key, unless the key is long."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        ids = self.make(key)
        if len(key) <= 64:
            self[key] = ids
        return ids


@lru_cache(maxsize=4)
def encoder(name: str = VOCABULARY) -> WordEncoder:
    return WordEncoder(name)


forgettable(encoder.cache_clear)


def cuts(text: str, bits: int = 10) -> list[int]:
    """Ends of the content-defined chunks: 2**bits characters apart on average.

    The hash covers the 16 characters before a cut and nothing else.
    """
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = chars * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    for width in (1, 2, 4, 8):  # sums over 2, 4, 8, 16 characters
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h = wider
    h *= np.uint32(0x85EBCA6B)
    ends = (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist()
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    return ends


class ChunkStore:
    """Encoded chunks by their text, least recently used out first; bounded in characters."""

    def __init__(self, words: WordEncoder, most_chars: int = 16_000_000) -> None:
        self.words, self.most, self.held = words, most_chars, 0
        self.chunks: OrderedDict[str, tuple] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, chunk: str) -> tuple:
        """(head, tail, ids of the words between) of a chunk; tail None: no white space in it."""
        known = self.chunks.get(chunk)
        if known is not None:
            self.chunks.move_to_end(chunk)
            self.hits += 1
            return known
        self.misses += 1
        space = _SPACE.search(chunk)
        if space is None:
            known = (chunk, None, b"")
        else:
            last = len(_TO_LAST.match(chunk)[0])
            known = (chunk[: space.start()], chunk[last:], self.words.words(chunk[space.start() : last]))
        self.chunks[chunk] = known
        self.held += len(chunk)
        while self.held > self.most and len(self.chunks) > 1:
            self.held -= len(self.chunks.popitem(last=False)[0])
        return known


def encode_text(text: str, store: ChunkStore) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    if not text:
        return b""
    if _ODD.search(text):
        return store.words.whole(text)
    ids, start, span = [], 0, ""
    for end in cuts(text):
        head, tail, inner = store.get(text[start:end])
        start = end
        span += head
        if tail is None:  # no white space yet: the span to encode anew grows
            continue
        ids.append(store.words.words(span))
        ids.append(inner)
        span = tail
    ids.append(store.words.words(span))
    return b"".join(ids)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, ids array<int>, decoded`` of every row's whole text.

    A null text counts as empty (no ids, decoded text empty); null or repeated doc_ids
    and repeated rows keep a row each; other columns are ignored.
    """
    return _encode(docs, vocabulary, digest=False)


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """As :func:`encode`, with SHA-256 digests in place of the ids and the decoded text."""
    return _encode(docs, vocabulary, digest=True)


def _encode(docs: DataFrame, vocabulary: str, digest: bool) -> DataFrame:
    def work():
        words = encoder(vocabulary)
        store = ChunkStore(words)

        def step(batch: dict) -> dict:
            out = {"doc_id": batch["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for text in batch["text"]:
                ids = encode_text(text.as_py() or "", store)
                decoded = words.decode(ids)
                out["n_tokens"].append(len(ids) // 4)
                if digest:
                    out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    out["ids"].append(np.frombuffer(ids, "<u4").astype(np.int32))
                    out["decoded"].append(decoded)
            return out

        return step

    columns = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, f"doc_id long, n_tokens long, {columns}")


def decode(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, decoded`` of rows with ``ids array<int>``: each id's token, joined by spaces.

    Null ids: null. Ids beyond the vocabulary are left out, as the library does.
    """

    def work():
        tokenizer = encoder(vocabulary).tokenizer

        def step(batch: dict) -> dict:
            ids = [x.as_py() for x in batch["ids"]]
            texts = iter(tokenizer.decode_batch([x for x in ids if x is not None], skip_special_tokens=False))
            return {"doc_id": batch["doc_id"], "decoded": [None if x is None else next(texts) for x in ids]}

        return step

    return map_batches(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), work, "doc_id long, decoded string")
