"""Token counts with the whole-token shortcut.

A byte-level BPE splits a text into pre-tokens and merges the bytes of each of them. Many
vocabulary strings, standing alone, come out as the one token that they are. `whole_tokens` proves
offline, with a Spark job over the vocabulary, which do. `count_tokens` then counts each pre-token
that is such a string as one, at the price of one look-up, and merges only the rest.
"""

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .bpe import SAFE, Merger, byte_of_symbol
from .common import Memo

#: How a byte-level tokenizer of this family cuts a text into pre-tokens (a fixed value of the format).
PRE_TOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: The same for texts of SAFE characters, where it is faster.
SAFE_PRE_TOKEN = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
#: A vocabulary larger than this is refused: the proved strings are sent to every executor.
LARGEST_VOCABULARY = 1_000_000


def whole_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The vocabulary strings that are one pre-token and encode alone as one token: (piece)."""
    symbols = byte_of_symbol()
    pieces = []
    for token in Tokenizer.from_file(path).get_vocab(with_added_tokens=False):
        try:
            pieces.append(bytes(symbols[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character: never a whole pre-token
    if len(pieces) > LARGEST_VOCABULARY:
        raise ValueError(f"{len(pieces)} vocabulary strings; at most {LARGEST_VOCABULARY} can be broadcast")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.from_file(path)
        for batch in batches:
            own = [p for p in batch.column(0).to_pylist() if (m := PRE_TOKEN.match(p)) and m.end() == len(p)]
            alone = tokenizer.encode_batch_fast(own, add_special_tokens=False) if own else []
            yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, e in zip(own, alone, strict=True) if len(e.ids) == 1], pa.string())})

    listed = spark.createDataFrame([(p,) for p in pieces], T.StructType([T.StructField("piece", T.StringType(), False)]))
    return listed.mapInArrow(prove, "piece string")


def count_tokens(docs: DataFrame, path: str, text: str = "text", tokens: str = "n_tokens") -> DataFrame:
    """docs with one more column: how many tokens the tokenizer at `path` makes of each whole text.

    A null or empty text has 0 tokens. Added tokens of the vocabulary that stand in a text count
    as one token each, which is the library's default. All other columns pass through, whatever
    their names; a column that is called like `tokens` already is replaced. Repeated rows are
    counted each. No shuffle: every task counts its own rows, batch by batch.
    """
    spark = docs.sparkSession
    proved = spark.sparkContext.broadcast(frozenset(r.piece for r in whole_tokens(spark, path).collect()))
    added = [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]
    special = regex.compile("|".join(regex.escape(t) for t in added)) if added else None

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = Tokenizer.from_file(path)
        merger = Merger(path)

        def merge(piece: str) -> int:
            return len(merger.ids(piece) if SAFE.fullmatch(piece) else tokenizer.encode(piece, add_special_tokens=False).ids)

        counted = Memo(merge, fixed=dict.fromkeys(proved.value, 1))

        def of(value: str | None) -> int:
            if not value:
                return 0
            pattern = SAFE_PRE_TOKEN if SAFE.fullmatch(value) else PRE_TOKEN
            parts = special.split(value) if special is not None else [value]
            return len(parts) - 1 + sum(sum(map(counted.__getitem__, pattern.findall(part))) for part in parts)

        for series in batches:
            yield pd.Series([of(x) for x in series], dtype="int64")

    return docs.withColumn(tokens, count(F.col(text)))
