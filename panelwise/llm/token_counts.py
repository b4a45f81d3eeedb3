"""Token counts through a digest cache: every distinct text is encoded once, and never again."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm import tokenizing
from panelwise.llm.common import any_names, utf8
from panelwise.session import cut

CACHE = "content binary, tokenizer string, n_tokens long"


def stored_counts(docs: DataFrame, cache: str, version: str) -> DataFrame:
    """The cache's rows of one tokenizer version; none where there is no cache yet."""
    spark = docs.sparkSession
    try:
        found = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        found = spark.createDataFrame([], CACHE)
    # two runs that fill a cache at the same time may both store a text
    return found.filter(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


@any_names
def count_tokens(
    docs: DataFrame, cache: str, text: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 1024,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (all columns, or those in ``keep``) plus ``n_bytes``, ``n_tokens`` and ``over_limit``.

    The vocabulary has no normaliser, so the normalised content is the text's UTF-8 bytes, with null as the
    empty text (0 tokens). Contents whose digest has no row in ``cache`` (a folder in shared storage) for this
    vocabulary's digest are encoded, once per distinct content, and appended to it; a job that is run
    again finds them there. Equal texts meet through partial aggregation, so a text with very many copies is
    no hot key. Columns of ``docs`` with the new names are replaced; an empty table gives an empty result.
    """
    path = tokenizing.path_of(vocabulary)
    version = tokenizing.digest_of(path)
    new = ["n_bytes", "n_tokens", "over_limit"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    data = utf8(text)
    content = F.unhex(F.sha2(data, 256))

    def encode(batches):
        pieces = tokenizing.pieces_of(path, words=False)
        for batch in batches:
            counts = [len(pieces.ids(tokenizing.text_of(t.as_py()))) // 4 for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array([version] * batch.num_rows, pa.string()), pa.array(counts, pa.int64())],
                names=["content", "tokenizer", "n_tokens"],
            )

    texts = docs.select(content.alias("content"), data.alias("_text"))
    misses = texts.join(stored_counts(docs, cache, version), "content", "left_anti").dropDuplicates(["content"])
    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    # small rows are written once, so that the join can split a content with very many copies
    keyed = docs.select(
        *[F.col(f"`{c}`") for c in kept], F.octet_length(data).cast("long").alias("n_bytes"), content.alias("content")
    )
    counts = cut(stored_counts(docs, cache, version))
    return keyed.join(counts, "content").select(
        *kept, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
