"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding, with a public byte-level vocabulary.

A token sequence is the encoding of its bytes exactly if each token is the encoding of its own bytes and each two
neighbours are compatible: while both are merged together, no merge reaches across their boundary. So the encoding of a
prefix ends in one token that does not depend on what follows, and it is the only token that is a suffix of the prefix
and compatible with the last token of the prefix before it. An automaton over the vocabulary gives at every place all
tokens that end there; the last token of each prefix is stored, and back-pointers give the ids.

Texts are cut into pieces as the tokenizer's own pattern cuts them; equal pieces are encoded once for each worker, in a
memory that is emptied when it is full. Work and memory are linear in a text, also in one without any blank.

Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded each; an empty table gives no
rows. Other columns pass through untouched, whatever their names; columns called like an output are replaced. A
vocabulary that this method can't encode exactly (a normaliser, dropout, merges out of order ...) raises ValueError.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import need, numbered, numbered_schema, quoted, slices, texts
from .tokens import byte_letters

#: Distinct pieces kept per Python worker, and the longest that is kept; they bound memory, never what is encoded.
MOST_PIECES, LONGEST_KEPT = 400_000, 64
NEVER = 1 << 62
#: White space, and the pieces that byte-level vocabularies cut texts into (fixed values).
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^{BLANK}\w]|_)+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


def check_vocabulary(config: dict) -> None:
    """Raises ValueError unless the vocabulary is byte-level BPE without anything that changes texts or merges."""
    model, pre, decoder = config.get("model") or {}, config.get("pre_tokenizer") or {}, config.get("decoder") or {}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in odd) and not config.get("normalizer")
    level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and decoder.get("type") == "ByteLevel"
    flags = any(t.get(k) for t in config.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized"))
    if not plain or not level or flags or config.get("truncation") or config.get("padding"):
        raise ValueError("the vocabulary is not plain byte-level BPE")


class Tokens:
    """Tokens as bytes: all that decoding needs, some megabytes."""

    def __init__(self, path: str):
        self.read(path)

    def read(self, path: str) -> dict:
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        check_vocabulary(config)
        self.byte_of = {letter: b for b, letter in byte_letters().items()}
        ids: dict[str, int] = config["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in config.get("added_tokens", [])}
        as_bytes = lambda token: bytes(self.byte_of[c] for c in token) if all(c in self.byte_of for c in token) else token.encode()
        #: token id -> bytes, for decoding; a number without token is empty
        self.bytes_of = [b""] * (1 + max([*ids.values(), *self.added.values()], default=-1))
        for token, i in [*ids.items(), *self.added.items()]:
            self.bytes_of[i] = as_bytes(token)
        return config

    def decode(self, ids: list[int]) -> str:
        """The bytes of all tokens as a text; what is not UTF-8 becomes U+FFFD, numbers without token are left out."""
        n = len(self.bytes_of)
        if ids and not (0 <= min(ids) and max(ids) < n):
            ids = [i for i in ids if 0 <= i < n]
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Vocabulary(Tokens):
    """Tokens as bytes, when each is made, and which two tokens may stand side by side."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        config = self.read(path)
        ids, added, byte_of = config["model"]["vocab"], self.added, self.byte_of
        self.rank: dict[tuple[int, int], int] = {}
        self.made = {i: -1 for i in ids.values() if len(self.bytes_of[i]) == 1}
        parts: dict[int, tuple[int, int]] = {}
        for at, merge in enumerate(config["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, whole = ids[left], ids[right], ids[left + right]
            if a not in self.made or b not in self.made or whole in self.made:
                raise ValueError("the vocabulary's merges are not in the order in which tokens are made")
            self.rank[a, b], self.made[whole], parts[whole] = at, at, (a, b)
        if len({self.bytes_of[i] for i in self.made if i not in parts}) < 256 or not self.made.keys() >= set(ids.values()):
            raise ValueError("the vocabulary does not hold all bytes, or a token that no merge makes")
        #: for each token, what stands at its right and left end from the last merge back, each with the merge that ends it
        self.right_end: dict[int, tuple[tuple[int, int], ...]] = {}
        self.left_end: dict[int, tuple[tuple[int, int], ...]] = {}
        usable = set()
        for token in sorted(self.made, key=self.made.__getitem__):
            left, right = parts.get(token, (None, None))
            at = self.made[token]
            ended = lambda spine: tuple((t, min(until, at)) for t, until in spine)  # noqa: B023, E731
            self.right_end[token] = ((token, NEVER), *(ended(self.right_end[right]) if right is not None else ()))
            self.left_end[token] = ((token, NEVER), *(ended(self.left_end[left]) if left is not None else ()))
            # a token is the encoding of its bytes if nothing but its own last merge crosses the boundary of its parts
            if left is None or left in usable and right in usable and list(self.crossings(left, right)) == [(left, right)]:
                usable.add(token)
        self.known: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.exact = {}
        for token in usable:
            key = self.bytes_of[token].decode("latin-1")
            self.automaton.add_word(key, (token, len(key)))
            self.exact[key] = token
        self.automaton.make_automaton()
        self.sizes = [len(b) for b in self.bytes_of]
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")").split if added else None
        self.pre, self.letters = Tokenizer.from_file(path).pre_tokenizer, str.maketrans({letter: chr(b) for letter, b in byte_of.items()})
        self.alike: set[str] = set()
        self.pieces = Pieces(self)

    def crossings(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """Merges across the boundary of a and b that fire while a and b are put together.

        Of merges with one rank the leftmost comes first: one inside a before the boundary, the boundary before b's.
        """
        for x, x_until in self.right_end[a]:
            for y, y_until in self.left_end[b]:
                at = self.rank.get((x, y))
                if at is not None and at < x_until and at <= y_until:
                    yield x, y

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can follow token a in an encoding."""
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) > MOST_PIECES:
                self.known.clear()
            found = self.known[a, b] = next(self.crossings(a, b), None) is None
        return found

    def encode_bytes(self, data: str) -> list[int]:
        """Ids of one piece, its bytes written as Latin-1 letters."""
        if (whole := self.exact.get(data)) is not None:
            return [whole]
        last = [-1] * (len(data) + 1)
        known, fits, done = self.known, self.fits, -1
        for end, (token, size) in self.automaton.iter(data):
            if end == done:
                continue
            if end + 1 != size:
                pair = last[end + 1 - size], token
                if not (known[pair] if pair in known else fits(*pair)):
                    continue
            last[end + 1], done = token, end
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= self.sizes[last[at]]
        return out[::-1]

    def cut(self, text: str) -> list[str]:
        """The tokenizer's pieces. Code points that its pattern puts into another class than ours are left to the library."""
        if not text.isascii():
            for c in set(text) - self.alike:
                probe = f"a{c}b  {c}1{c}!"
                if [m.span() for m in PIECES.finditer(probe)] != [span for _, span in self.pre.pre_tokenize_str(probe)]:
                    return [p.translate(self.letters).encode("latin-1").decode() for p, _ in self.pre.pre_tokenize_str(text)]
                self.alike.add(c)
        return PIECES.findall(text)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if len(self.pieces) > MOST_PIECES:
            self.pieces.clear()
        look, out = self.pieces.__getitem__, []
        for k, part in enumerate(self.split(text) if self.split else [text]):
            out += [self.added[part].to_bytes(4, "little")] if k % 2 else map(look, self.cut(part))
        return b"".join(out)


class Pieces(dict):
    """Piece -> its ids as bytes; a missing piece is encoded when it is asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        data = piece if piece.isascii() else piece.encode().decode("latin-1")
        ids = np.asarray(self.vocabulary.encode_bytes(data), "<i4").tobytes()
        if len(piece) <= LONGEST_KEPT:
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker and file."""
    return Vocabulary(path)


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    """Likewise, where nothing is encoded."""
    return Tokens(path)


def replaced(df: DataFrame, name: str) -> DataFrame:
    """df without columns called `name`, in upper or lower case."""
    return df.select(*quoted(*[c for c in df.columns if c.lower() != name.lower()]))


def encode_texts(df: DataFrame, path: str, column: str = "text", output: str = "ids") -> DataFrame:
    """df with `column` replaced by `output`, an array of the ids of its whole text, as the tokenizers library gives them."""
    need(df, column)
    others = replaced(df, output) if output.lower() != column.lower() else df
    plain, names = numbered(others)
    at = names.index(column)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(path).encode
        for batch in slices(batches, f"c{at}"):
            found = [encode(t) for t in texts(batch, f"c{at}")]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
            yield batch.set_column(at, f"c{at}", pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4"))))

    schema = numbered_schema(others.schema)
    schema.fields[at] = T.StructField(f"c{at}", T.ArrayType(T.IntegerType()))
    return plain.mapInArrow(ids, T.StructType(schema.fields)).toDF(*[output if k == at else n for k, n in enumerate(names)])


def decode_ids(df: DataFrame, path: str, column: str = "ids", output: str = "text") -> DataFrame:
    """df with `column` (an array of ids; null is empty) replaced by `output`, the decoded text, special tokens kept."""
    need(df, column)
    others = replaced(df, output) if output.lower() != column.lower() else df
    others = others.withColumn(column, F.coalesce(quoted(column)[0].cast("array<int>"), F.array().cast("array<int>")))
    plain, names = numbered(others)
    at = names.index(column)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = tokens(path).decode
        for batch in batches:
            for part in parts_of(batch, f"c{at}"):
                found = [decode(ids) for ids in id_lists(part.column(f"c{at}"))]
                yield part.set_column(at, f"c{at}", pa.array(found, pa.string()))
        pa.default_memory_pool().release_unused()

    schema = numbered_schema(others.schema)
    schema.fields[at] = T.StructField(f"c{at}", T.StringType())
    return plain.mapInArrow(decoded, T.StructType(schema.fields)).toDF(*[output if k == at else n for k, n in enumerate(names)])


def id_lists(column: pa.ListArray) -> Iterator[list[int]]:
    """The ids of each row without its nulls."""
    if column.values.null_count or column.null_count:
        yield from ([i for i in ids or () if i is not None] for ids in column.to_pylist())
        return
    values, ends = column.values.to_numpy(), column.offsets.to_numpy().tolist()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield values[a:b].tolist()


def parts_of(batch: pa.RecordBatch, column: str, most: int = 250_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that `column` holds at most about `most` ids in each."""
    sizes = pa.compute.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += n
    if first < batch.num_rows:
        yield batch.slice(first)
