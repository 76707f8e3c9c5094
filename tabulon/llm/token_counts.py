"""Token counts by a two-tier lookup in the map tasks.

A bounded table of frequent pre-tokens and their numbers of tokens goes to every worker; what it
misses is encoded once and kept in a bounded cache of the worker. No pre-token is shuffled: the
frequent ones are found by mergeable summaries, one bounded row per task, merged in a tree.
"""

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulon.llm.shared import small_batches, text_of
from tabulon.llm.tokens import LATIN_SPLIT, encoder, ids_of, latin, tokenizer

# The table has at most this many pre-tokens of at most this many characters: under 8 MB.
FREQUENT, LONGEST = 32_768, 48
# Entries of a summary in a task, and of one that is sent on.
SUMMARY, SENT = 400_000, 16_384
FAN_IN = 24
WORKER_CACHE = 500_000
# Beyond this many characters the pre-tokens of a text are not held as a list.
LONG_TEXT = 4_000_000


def _keep_top(counts: Counter, size: int) -> Counter:
    """Drop all but ``size`` entries and take the largest dropped count from the rest.

    This is the merge step of a frequent-items summary: an entry is undercounted by at most its
    share of what was dropped, so a pre-token that is frequent overall stays.
    """
    if len(counts) <= size:
        return counts
    ranked = counts.most_common(size + 1)
    floor = ranked[-1][1]
    return Counter({w: n - floor for w, n in ranked[:-1] if n > floor})


def pre_tokens(text: str) -> Iterator[str]:
    if len(text) <= LONG_TEXT:
        return LATIN_SPLIT.findall(text)
    return (m.group() for m in LATIN_SPLIT.finditer(text))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if latin(text):
                counts.update(pre_tokens(text))
                if len(counts) > SUMMARY:
                    counts = _keep_top(counts, SUMMARY // 2)
    yield _row({w: n for w, n in counts.items() if n > 1})


def _row(counts: dict) -> pa.RecordBatch:
    top = _keep_top(Counter({w: n for w, n in counts.items() if len(w) <= LONGEST}), SENT)
    return pa.record_batch({"words": pa.array([list(top)], pa.list_(pa.string())), "counts": pa.array([list(top.values())], pa.list_(pa.int64()))})


def _merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total: Counter = Counter()
    for words, counts in zip(rows["words"], rows["counts"]):
        total.update(dict(zip(words, (int(n) for n in counts))))
    total = _keep_top(total, SENT)
    return pd.DataFrame({"grp": [int(key[0]) // FAN_IN], "words": [list(total)], "counts": [list(total.values())]})


def frequent_pre_tokens(docs: DataFrame, text_col: str = "text", size: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens of all texts: at most ``size``, which come to the driver."""
    texts = docs.select(text_of(text_col).alias("text"))
    parts = texts.rdd.getNumPartitions()
    tree = texts.mapInArrow(_summaries, "words array<string>, counts array<long>")
    tree = tree.withColumn("grp", F.floor(F.spark_partition_id() / FAN_IN)).select("grp", "words", "counts")
    while True:
        tree = tree.groupBy("grp").applyInPandas(_merged, "grp long, words array<string>, counts array<long>")
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    total: Counter = Counter()
    for row in tree.collect():  # one row of at most SENT entries
        total.update(dict(zip(row["words"], row["counts"])))
    return [w for w, _ in total.most_common(size)]


class Lengths(dict):
    """Number of tokens by pre-token: the frequent ones, and those this worker has met."""

    def __init__(self, frequent: dict[str, int], path: str, room: int = WORKER_CACHE):
        super().__init__(frequent)
        self.frequent, self.encode, self.most = frequent, encoder(path).encode_ordinary, len(frequent) + room

    def __missing__(self, word: str) -> int:
        n = len(self.encode(word))
        if len(self) >= self.most:
            self.clear()
            self.update(self.frequent)
        if len(word) <= LONGEST:
            self[word] = n
        return n


def _special(path: str) -> list[str]:
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def _length_counter(frequent: dict[str, int], path: str):
    lengths, special = Lengths(frequent, path), _special(path)

    def count(text: str) -> int:
        if latin(text) and not any(s in text for s in special):
            return sum(map(lengths.__getitem__, pre_tokens(text)))
        return len(ids_of(path, text))

    return count


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, frequent: int = FREQUENT
) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts are those of the vocabulary file's library for the whole text, without added tokens.
    Null and empty texts have no tokens; ids are passed on as they are, null or repeated. A text
    with characters beyond U+024F or a special string is encoded whole, without the table. Other
    columns are not read. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    words = frequent_pre_tokens(docs, text_col, frequent)
    table = {w: len(encoder(path).encode_ordinary(w)) for w in words}
    shipped = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = _length_counter(shipped.value, path)
        for texts in batches:
            yield texts.map(count).astype("int64")

    rows = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    counted = rows.select(id_col, F.octet_length("_text").cast("long").alias("n_bytes"), n_tokens("_text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
