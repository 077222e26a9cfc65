"""Token counts by an exact length histogram.

Documents are encoded whole and counted by their number of tokens; every task adds up its own histogram before anything is shuffled. Suffix
sums over the lengths then answer, for every context limit, how many documents and tokens reach it and what truncation leaves. The sums
are taken in blocks of BLOCK lengths and over the blocks, so no window runs over all lengths.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricerank.llm.common import pieces, stored

#: The vocabulary's file and the pattern that parts its texts.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1024


def encoding(vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _lengths(vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts = None, Counter()
        for batch in pieces(batches, 1_000):
            encoder = encoder or encoding(vocabulary)
            counts.update(len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["length", "n_docs"])

    return run


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """length, n_docs: documents of each number of tokens. Null and empty texts have none; repeated rows count each; an empty table gives no rows.
    Columns other than text are not read. The vocabulary file must be at that path on every executor."""
    return docs.select("text").mapInArrow(_lengths(vocabulary), "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length that occurs: n_docs, docs_at_least and tokens_at_least (of that length or more), truncated_total (tokens left if
    every document is cut to it), share_up_to (share of documents no longer). truncated_total and share_up_to are the answers at any limit
    up to the next length that occurs, the former plus (limit - length) for each longer document. The histogram is stored first, so that texts are encoded once."""
    h = stored(hist).withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    later, everything = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    blocks = blocks.select("block", *[F.coalesce(F.sum(f"block_{c}").over(later), F.lit(0)).alias(f"later_{c}") for c in ("docs", "tokens")], *[F.sum(f"block_{c}").over(everything).alias(f"all_{c}") for c in ("docs", "tokens")])
    inside = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.join(blocks, "block").select("length", "n_docs", (F.sum("n_docs").over(inside) + F.col("later_docs")).alias("docs_at_least"), (F.sum("tokens").over(inside) + F.col("later_tokens")).alias("tokens_at_least"), "all_docs", "all_tokens")
    kept = F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")
    share = (F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")
    return h.select("length", "n_docs", "docs_at_least", "tokens_at_least", kept.alias("truncated_total"), share.alias("share_up_to"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row, length: the least one that a share q of the documents does not exceed (null for an empty table)."""
    return sums.where(F.col("share_up_to") >= q).agg(F.min("length").alias("length"))


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, total: the tokens left if every document is cut to the limit."""
    lengths = sums.agg(*[F.coalesce(F.sum(F.least("length", F.lit(x)) * F.col("n_docs")), F.lit(0)).alias(str(x)) for x in limits])
    return lengths.select(F.explode(F.array(*[F.struct(F.lit(x).alias("limit"), F.col(str(x)).alias("total")) for x in limits])).alias("x")).select("x.*")
