"""Byte-pair encoding with tree concatenation, and decoding.

A text is cut where a cut can change nothing: before a blank, tab or line break
that follows another kind of character.  Such units repeat a lot, so a worker
keeps the ids of those it has met, up to a bound.

A text with no such place for long is encoded in halves.  Each join is mended by
encoding a growing window around it again, until the window's first token is the
left side's own and its last token the right side's own.  Two canonical token
sequences that share a token join to a canonical one, so that agreement makes
the result exact.  Documents above ``split_chars`` are cut into such pieces as
rows, encoded by different tasks, and joined again by the same windows.

Rows: a null text counts as empty and has no ids; repeated rows are encoded
each; an empty table gives an empty result; input columns other than the key and
the text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read, record_batch, text_or_empty

#: Units a worker remembers in each of two generations; the older is forgotten when the younger is full.
REMEMBERED = 200_000
#: Longest unit that is remembered.
UNIT_CHARS = 200
#: Units above this are encoded as a tree, from leaves of this many characters.
LEAF_CHARS = 2048
#: Documents above this are encoded by several tasks, in pieces of this size.
SPLIT_CHARS = 65_536

UNIT = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: White space of any other kind: a blank after it is no safe place.
ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
SAFE_CUT = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n\t\r])")


def vocabulary(path: str) -> str:
    """The vocabulary file's content, read on the driver and sent with the tasks.

    A file of another kind than byte-level BPE with the pre-tokens of ``PRE_TOKEN`` is an error.
    """
    with open(path, encoding="utf-8") as file:
        content = file.read()
    kind = json.loads(content)
    before, model = kind.get("pre_tokenizer") or {}, kind["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    changed = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
    if kind.get("normalizer") or not plain or model.get("type") != "BPE" or changed:
        raise ValueError(f"{path}: only plain byte-level BPE vocabularies are known here")
    return content


#: The pre-token pattern of byte-level vocabularies of this family.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Remembered(dict):
    """Values of units by a function, kept up to a bound."""

    def __init__(self, value: Callable[[str], object]):
        super().__init__()
        self.value, self.older = value, {}

    def __missing__(self, unit: str) -> object:
        found = self.older.get(unit)
        if found is None:
            found = self.value(unit)
        if len(unit) <= UNIT_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[unit] = found
        return found


@functools.lru_cache(maxsize=4)
def codec(content: str) -> Codec:
    """The worker's codec of a vocabulary."""
    return Codec(content)


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes texts with one vocabulary file of the tokenizers library."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pattern = regex.compile(PRE_TOKEN)
        self.units = Remembered(self._unit)
        self.parts = Remembered(self.pre_token)
        self.added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.specials = [t for t in self.added.values() if t]
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        alphabet = _byte_of_char()
        self.alphabet = {b: c for c, b in alphabet.items()}
        size = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.pieces = [b""] * size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.pieces[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        for i, token in self.added.items():
            self.pieces[i] = token.encode()
        self.piece_of = np.array([*self.pieces, None], object)[:-1]

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids, for texts of moderate length."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.int32) for x in found]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as the library gives them."""
        return np.frombuffer(b"".join(map(self.units.__getitem__, self._units(text))), np.int32)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encode(text) for text in texts]

    def _units(self, text: str) -> list[str]:
        if any(special in text for special in self.specials) or ODD_SPACE.search(text):
            return [text]
        return UNIT.findall(text)

    def _unit(self, unit: str) -> bytes:
        """The ids of a unit, as bytes."""
        if len(unit) > LEAF_CHARS:
            return self.tree(unit).tobytes()
        if any(special in unit for special in self.specials):
            return self.direct([unit])[0].tobytes()
        return b"".join(map(self.parts.__getitem__, self.pattern.findall(unit)))

    def pre_token(self, piece: str) -> bytes:
        """The ids of one pre-token, as bytes."""
        if len(piece) > LEAF_CHARS:
            return self.tree(piece).tobytes()
        spelled = piece.encode().decode("latin-1").translate(self.alphabet)
        return array("i", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()

    def tree(self, text: str) -> np.ndarray:
        """Ids of one long text: both halves, joined.  Special strings are cut out first."""
        if len(text) <= LEAF_CHARS:
            return self.direct([text])[0]
        if self.special and self.special.search(text):
            stretches = self.special.split(text)
            return np.concatenate([self.direct([s])[0] if s in self.specials else self.tree(s) for s in stretches])
        half = len(text) // 2
        near = SAFE_CUT.search(text, half, min(len(text), half + LEAF_CHARS))
        if near:
            at = near.start()
            return np.concatenate((self.tree(text[:at]), self.tree(text[at:])))
        return self.join(self.tree(text[:half]), self.tree(text[half:]))

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of two neighbouring texts as one, from the ids of each.

        The place between them must not be inside a special string.
        The window starts at two tokens on either side and doubles on the sides
        that do not agree yet.
        """
        if not len(left) or not len(right):
            return np.concatenate((left, right))
        a = b = 2
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            raw = self.bytes_of([*left[len(left) - a :], *right[:b]])
            try:
                middle = self.direct([raw.decode("utf-8")])[0]
            except UnicodeDecodeError:
                if a == len(left) and b == len(right):
                    raise
                a, b = a + 1, b + 1
                continue
            left_agrees = a == len(left) or middle[0] == left[len(left) - a] and self._anchors(middle[0])
            right_agrees = b == len(right) or middle[-1] == right[b - 1] and self._anchors(middle[-1])
            if left_agrees and right_agrees and len(middle) > 1 or a == len(left) and b == len(right):
                return np.concatenate((left[: len(left) - a], middle, right[b:]))
            a, b = (a if left_agrees and len(middle) > 1 else 2 * a), (b if right_agrees and len(middle) > 1 else 2 * b)

    def _anchors(self, token: int) -> bool:
        """Whether a window may end at this token: white space is cut by what follows it."""
        return bool(self.pieces[token].decode("utf-8", "ignore").strip())

    def bytes_of(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.piece_of[np.asarray(ids, np.int64)].tolist())

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        return self.bytes_of(ids).decode("utf-8", "replace")


def _ids_array(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32, copy=False)))


def _id_rows(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a column of ids; a null row is an empty one."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    valid = column.is_valid().to_pylist()
    return [flat[a:b] if ok else flat[:0] for a, b, ok in zip(offsets, offsets[1:], valid, strict=False)]


def _pieces(text: str, size: int, specials: list[str]) -> list[str]:
    """Consecutive pieces of about ``size``, cut at safe places where there are any.

    No cut is inside a special string.
    """
    out, at = [], 0
    while len(text) - at > size:
        near = SAFE_CUT.search(text, at + size // 2, at + size)
        end = near.start() if near else at + size
        for special in specials:
            found = text.find(special, max(at, end - len(special) + 1), end + len(special) - 1)
            end = found if found > at else end + len(special) if found == at else end
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def encode(docs: DataFrame, path: str, key: str = "doc_id", split_chars: int = SPLIT_CHARS) -> DataFrame:
    """``key, ids`` of every row: the token ids of its whole text."""
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(vocabulary(path))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), text_or_empty().alias("_text"))

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = codec(content.value).encode_all(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), _ids_array(ids)], names=[key, "ids"])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = [_pieces(t, split_chars, codec(content.value).specials) for t in batch.column(2).to_pylist()]
        index = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(index)),
                batch.column(1).take(pa.array(index)),
                pa.array([i for p in pieces for i in range(len(p))], pa.int32()),
                pa.array([x for p in pieces for x in p], pa.string()),
            ],
            names=["_row", "_key", "_piece", "_text"],
        )

    def leaf(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = codec(content.value).encode_all(batch.column(3).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns[:3], _ids_array(ids)], names=["_row", "_key", "_piece", "ids"])

    def together(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.asarray(x, np.int32) for x in group.sort_values("_piece")["ids"]]
        while len(parts) > 1:  # neighbours in pairs, as a tree
            joined = [codec(content.value).join(*parts[i : i + 2]) for i in range(0, len(parts) - 1, 2)]
            parts = joined + parts[len(parts) // 2 * 2 :]
        return pd.DataFrame({key: group["_key"].iloc[:1], "ids": [parts[0]]})

    short = map_batches(rows.where(F.length("_text") <= split_chars), whole, f"`{key}` {kind}, ids array<int>")
    long = rows.where(F.length("_text") > split_chars).select(F.monotonically_increasing_id().alias("_row"), "_key", "_text")
    pieces = map_batches(long, cut, f"_row bigint, _key {kind}, _piece int, _text string").repartition("_row", "_piece")
    leaves = map_batches(pieces, leaf, f"_row bigint, _key {kind}, _piece int, ids array<int>")
    return short.union(leaves.groupBy("_row").applyInPandas(together, f"`{key}` {kind}, ids array<int>"))


def decode(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text`` of every row: the text of its token ids (null ids: empty)."""
    content = rows.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = rows.schema[key].dataType.simpleString()

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [codec(content.value).decode(x) for x in _id_rows(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return map_batches(rows.select(key, ids), per_batch, f"`{key}` {kind}, text string")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded rows."""
    content = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = _decimals(len(codec(content.value).pieces))
        sizes, spelled, decoded = [], [], []
        for ids in _id_rows(batch.column(1)):
            sizes.append(len(ids))
            spelled.append(hashlib.sha256(b",".join(names[ids].tolist())).hexdigest())
            decoded.append(hashlib.sha256(codec(content.value).decode(ids).encode()).hexdigest())
        made = record_batch(n=(sizes, pa.int64()), a=(spelled, pa.string()), b=(decoded, pa.string()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *made.columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        )

    return map_batches(
        encoded.select("doc_id", "ids"),
        per_batch,
        f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )


@functools.lru_cache(maxsize=2)
def _decimals(n: int) -> np.ndarray:
    return np.array([*(b"%d" % i for i in range(n)), None], object)[:-1]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole document, decode it again, and give digests of both."""
    path = default_path()
    return digests(encode(read(spark, sf_dir, "documents"), path), path)
