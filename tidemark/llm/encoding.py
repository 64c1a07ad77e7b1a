"""Problem 8: the token ids of every document by a public byte-level tokenizer.

The most frequent words of the whole corpus are compiled, with their ids, into a minimal acyclic transducer that the
workers map from the shared folder. A batch of texts is cut into words, distinct words take the transducer's steps all at
once, and only words it does not hold are merged, exactly, by the tokenizer's ranks.
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.transducer import Transducer
from tidemark.session import local_file, shared_path
from tidemark.tables import need

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEXICON_WORDS = 50_000
LONGEST_WORD = 64
CHARS_AT_ONCE = 1_000_000

#: Fixed: how byte_bpe_50k cuts text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _merger(ranks_path: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _words():
    import regex

    return regex.compile(PATTERN).findall


@dataclass(frozen=True)
class Lexicon:
    """Where the workers find the transducer: mapped from a folder they share, else from a broadcast of at most
    LEXICON_WORDS words of at most LONGEST_WORD characters, a few MB."""

    ranks_path: str
    folder: str | None
    spare: object | None

    def load(self) -> Transducer:
        return _mapped(self.folder) if self.folder else pickle.loads(self.spare.value)


@lru_cache(maxsize=4)
def _mapped(folder: str) -> Transducer:
    return Transducer.mapped(folder)


def build_lexicon(df: DataFrame, text: str, ranks_path: str = BYTE_BPE_50K, words: int = LEXICON_WORDS) -> Lexicon:
    """The transducer of the corpus's most frequent words, counted over all texts. The count only decides which words are
    looked up rather than merged; ids do not depend on it."""
    found = F.regexp_extract_all(F.col(f"`{text}`"), F.lit("(?U)" + PATTERN), F.lit(0))
    counted = df.filter(F.col(f"`{text}`").isNotNull()).select(F.explode(found).alias("word")).filter(F.length("word") <= LONGEST_WORD).groupBy("word").count()
    top = counted.orderBy(F.desc("count"), "word").limit(words).collect()  # at most `words` rows
    merge = _merger(ranks_path)._encode_single_piece
    lexicon = Transducer.compile({w: list(merge(w)) for w in (r["word"].encode("utf-8", "surrogatepass") for r in top)})
    spark = df.sparkSession
    path = shared_path(spark, "lexicon")
    plain = path.startswith("/") and spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")  # else Spark means another file system
    if (plain or path.startswith("file:")) and local_file(path):
        lexicon.save(local_file(path))
        return Lexicon(ranks_path, local_file(path), None)
    return Lexicon(ranks_path, None, spark.sparkContext.broadcast(pickle.dumps(lexicon)))


def encode_texts(texts: list[str | None], lexicon: Transducer, ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids): text i has ids[offsets[i] : offsets[i + 1]]."""
    cut, merge = _words(), _merger(ranks_path)._encode_single_piece
    per_text = [cut(t) if t else [] for t in texts]
    occurring = np.array([w for ws in per_text for w in ws], dtype=object)
    if not len(occurring):
        return np.zeros(len(texts) + 1, dtype=np.int64), np.zeros(0, dtype=np.int32)
    codes, distinct = pd.factorize(occurring)
    as_bytes = [w.encode("utf-8", "replace") for w in distinct]
    ranks = lexicon.ranks(as_bytes)
    unseen = np.flatnonzero(ranks < 0)
    merged = [merge(as_bytes[i]) for i in unseen]
    sizes, begins = np.empty(len(distinct), dtype=np.int64), np.empty(len(distinct), dtype=np.int64)
    known = ranks >= 0
    begins[known] = lexicon.starts[ranks[known]]
    sizes[known] = lexicon.starts[ranks[known] + 1] - begins[known]
    sizes[unseen] = [len(m) for m in merged]
    begins[unseen] = len(lexicon.ids) + np.concatenate(([0], np.cumsum(sizes[unseen])[:-1])) if len(unseen) else []
    pool = np.concatenate([lexicon.ids, np.array([i for m in merged for i in m], dtype=np.int32)])
    token_sizes = sizes[codes]
    ends = np.cumsum(token_sizes)
    flat = pool[np.repeat(begins[codes] - (ends - token_sizes), token_sizes) + np.arange(ends[-1])]
    words_upto = np.cumsum([0, *map(len, per_text)])
    return np.concatenate(([0], ends))[words_upto], flat


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > CHARS_AT_ONCE:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def encode(df: DataFrame, doc_id: str, text: str, lexicon: Lexicon | None = None, ranks_path: str = BYTE_BPE_50K, lengths_only: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of each row, or (doc_id, n_tokens int) with lengths_only.

    Null and empty texts have no ids, as an empty array. No special tokens; what looks like one is ordinary text. Texts
    are read whole whatever their length. Rows are kept one by one, repeated ones and null doc_ids too; an empty table
    gives an empty result; other columns are ignored.
    """
    need(df, doc_id, text)
    lexicon = lexicon or build_lexicon(df, text, ranks_path)
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = T.StructField("n_tokens", T.IntegerType()) if lengths_only else T.StructField("ids", T.ArrayType(T.IntegerType(), False))
    schema = T.StructType([rows.schema["doc_id"], kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = lexicon.load()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _chunks(texts):
                offsets, ids = encode_texts(texts[a:b], transducer, lexicon.ranks_path)
                if lengths_only:
                    out = pa.array(np.diff(offsets).astype(np.int32))
                else:
                    out = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, type=pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), out], [schema[0].name, schema[1].name])

    return rows.mapInArrow(run, schema)
