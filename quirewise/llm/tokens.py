"""Token counts with a whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once, on the driver
before any counting, by encoding every one of them; the set, at most as large as
the vocabulary, is sent with the tasks.  A pre-token in that set counts one at
once; only the others are merged.  A pre-token's count does not depend on its neighbours,
so the counts of a text's pre-tokens add up to the text's.

Rows: a null text counts as empty, with no tokens; repeated rows are counted
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ODD_SPACE, UNIT, Remembered, codec, default_path, vocabulary
from .common import map_batches, read, record_batch, text_or_empty


def proved(content: str) -> frozenset[str]:
    """Vocabulary strings that are whole texts, one pre-token, and encode alone as one token."""
    codes, texts = codec(content), []
    for i, raw in enumerate(codes.pieces):
        if i in codes.added or not raw:
            continue
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if codes.pattern.fullmatch(text):
            texts.append(text)
    return frozenset(t for t, x in zip(texts, codes.direct(texts), strict=True) if len(x) == 1)


class Counter:
    """Counts tokens of texts for one vocabulary, of which ``single`` are proved."""

    def __init__(self, content: str, single: frozenset[str]):
        self.codec = codec(content)
        self.single = single
        self.units = Remembered(self._unit)

    def _unit(self, unit: str) -> int:
        """Tokens of a unit: one for each proved pre-token, and those of the merged others."""
        pieces = self.codec.pattern.findall(unit)
        others = [p for p in pieces if p not in self.single]
        return len(pieces) - len(others) + sum(len(self.codec.parts[p]) // 4 for p in others)

    def count_all(self, texts: list[str]) -> list[int]:
        return [sum(map(self.units.__getitem__, self._units(text))) + self._specials(text) for text in texts]

    def _specials(self, text: str) -> int:
        return sum(text.count(s) for s in self.codec.specials)

    def _units(self, text: str) -> list[str]:
        """Units of a text without its special strings, each of which is one token."""
        if any(s in text for s in self.codec.specials):
            stretches = regex.split("|".join(map(regex.escape, self.codec.specials)), text)
            return [u for s in stretches if s for u in self._units(s)]
        return [text] if ODD_SPACE.search(text) else UNIT.findall(text)


@functools.lru_cache(maxsize=4)
def counter(content: str, single: frozenset[str]) -> Counter:
    """The worker's counter of a vocabulary."""
    return Counter(content, single)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id") -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every row's whole text."""
    content = vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast((content, proved(content)))
    kind = docs.schema[key].dataType.simpleString()

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = counter(*shared.value).count_all(batch.column(2).to_pylist())
        made = record_batch(n=(counts, pa.int64()), o=([n > limit for n in counts], pa.bool_()))
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:2], *made.columns], names=[key, "n_bytes", "n_tokens", "over_limit"]
        )

    text = text_or_empty()
    rows = docs.select(F.col(key), F.octet_length(text).cast("bigint").alias("_bytes"), text.alias("_text"))
    return map_batches(rows, per_batch, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of the whole documents table."""
    return count_tokens(read(spark, sf_dir, "documents"), default_path())
