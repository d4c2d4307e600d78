"""Token counts by the whole-token shortcut.

Offline, each vocabulary string is merged from its bytes once: those that end as
one token are proven to be whole. In a text, a pre-token found among the proven
strings counts one at once; only the rest go through merges (batched matrices,
see bpe). A special token's string inside a text counts one and splits the text
around it, as the library does by default.

Null and empty texts have no tokens and no bytes. Texts may be of any length.
Repeated rows give repeated results; extra columns are not carried.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import MEMORY_PIECES, Bpe, read_file
from .common import keyed_text, map_batches


def whole_tokens(bpe: Bpe) -> list[bytes]:
    """The vocabulary strings that merging their own bytes gives back as one token."""
    strings = [*bpe.tokens.values()]
    return [t for t, ids in zip(strings, bpe.merge(strings)) if len(ids) == 4]


class Counter:
    """Counts tokens of texts; a piece met before is not merged again."""

    def __init__(self, spec: dict, proven: list[bytes], pattern: str):
        self.bpe = Bpe.from_merges(spec["model"]["vocab"], spec["model"]["merges"])
        self.pattern = regex.compile(pattern)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.whole = {t.decode(): 1 for t in proven if is_text(t)}
        self.seen: dict[str, int] = dict(self.whole)

    def __call__(self, texts: list[str]) -> list[int]:
        extra, pieces = [], []
        for text in texts:
            parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
            extra.append(len(parts) - 1)
            pieces.append([p for part in parts for p in self.pattern.findall(part)] if len(parts) > 1 else self.pattern.findall(text))
        needed = set().union(*pieces)
        if len(self.seen) > len(self.whole) + MEMORY_PIECES:
            self.seen = dict(self.whole)
        if new := [*(needed - self.seen.keys())]:
            self.seen.update(zip(new, (len(ids) // 4 for ids in self.bpe.merge([p.encode() for p in new]))))
        return [n + sum(map(self.seen.__getitem__, own)) for n, own in zip(extra, pieces)]


def is_text(token: bytes) -> bool:
    try:
        return bool(token.decode())
    except UnicodeDecodeError:
        return False


def count_tokens(df: DataFrame, spec_path: str, pattern: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) under a byte-level BPE specification file.

    The proof runs once on the driver; file and proof are broadcast, both bounded by the vocabulary.
    """
    raw = read_file(df, spec_path)
    spec = json.loads(raw)
    proven = whole_tokens(Bpe.from_merges(spec["model"]["vocab"], spec["model"]["merges"]))
    shipped = df.sparkSession.sparkContext.broadcast((raw, proven))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(json.loads(shipped.value[0]), shipped.value[1], pattern)
            counts = pa.array(counter(batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], ["doc_id", "n_bytes", "n_tokens"])

    texts = keyed_text(df, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = map_batches(texts, run, f"doc_id {texts.dtypes[0][1]}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
