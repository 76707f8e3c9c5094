"""Group spelling variants: words one edit apart, and the common form that a rare one stands for.

Every word is marked with a terminator at its end and rotated at every place (permuterm). A
rotation without its last character begins with all of the word but one character: rotations that
are alike up to there belong to words that differ by that one character, and the rotation of a word
that lacks it is that beginning itself. So an edit of any kind is a range of rotations with one
prefix. The rotations are sorted by range over the whole table and scanned range by range. A range
holds one word for each character that can stand at the skipped place, and one shorter word.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.llm.shared import UPPER, small_batches, stored, text_of

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans(UPPER, UPPER.lower())
# One run of letters in so many loses a letter, by the hash of its document and itself.
DELETE_EVERY = 97
LEAST_LETTERS, LEAST_COUNT = 5, 3
# A form has at least so many times the occurrences of the word it stands for.
FORM_RATIO = 2
END = "$"
# Up to here a rotation is sorted as text; longer ones are sorted by a hash of linear cost, and the edit is then checked.
TEXT_KEY = 64
_PRIME, _BASE = (1 << 127) - 1, 0x5DEECE66D1CE4E5B9F31
# Words that a task counts before it passes them on, and rotations of a batch.
_HELD, _SENT = 200_000, 10_000


def runs_of(doc_id: int | None, text: str) -> Counter[str]:
    """Runs of letters with A-Z lower-cased, and one letter taken out of some; no id counts as empty."""
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    runs: Counter[str] = Counter()
    for run, n in Counter(RUN.findall(text)).items():
        runs[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    out: Counter[str] = Counter()
    for run, n in runs.items():
        if not (h := zlib.crc32(run.encode(), head)) % DELETE_EVERY:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        out[run] += n
    return out


def _counts(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in runs_of(doc, text).items():
                    if len(word) >= least:
                        held[word] += n
                if len(held) >= _HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


def count_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT
) -> DataFrame:
    """word, n: the words of all texts with enough letters and occurrences."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    # Counted in each task first, so a frequent word costs a row per task.
    counts = texts.mapInArrow(_counts(least_letters), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least_count)


def _rotation_hashes(word: str) -> tuple[list[int], list[int]]:
    """Hashes of the word's rotations at every place, whole and without their last character, in linear time."""
    n, prefix, power = len(word), [0], [1]
    for c in word:
        prefix.append((prefix[-1] * _BASE + ord(c)) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)

    def joined(a: int, b: int) -> int:
        """Of word[a:], the terminator and word[:b]."""
        tail = (prefix[n] - prefix[a] * power[n - a]) % _PRIME
        return ((tail * _BASE + ord(END)) * power[b] + prefix[b]) % _PRIME

    return [joined(i, i) for i in range(n + 1)], [joined(i + 1, i) for i in range(n)]


# How a word stands in a range: it is the shorter word; it has one more character there; that
# character repeats the one before it, so that the same shorter word is met at the one before.
SHORTER, FIRST, REPEAT = 0, 1, 2


def word_rotations(word: str) -> Iterator[tuple[str, int]]:
    """Key of every range that the word stands in, and how."""
    n = len(word)
    role = [REPEAT if i and word[i] == word[i - 1] else FIRST for i in range(n)]
    if n > TEXT_KEY - 1:
        whole, skipped = _rotation_hashes(word)
        yield from ((f"{END}{n + 1}:{h:x}", SHORTER) for h in whole)
        if n > TEXT_KEY:
            yield from zip((f"{END}{n}:{h:x}" for h in skipped), role)
    else:
        yield from ((word[i:] + END + word[:i], SHORTER) for i in range(n + 1))
    if n <= TEXT_KEY:
        yield from ((word[i + 1 :] + END + word[:i], role[i]) for i in range(n))


def _name(word: str) -> str:
    """What stands for a word in its rotations: itself, or a digest if it is long, so that rows stay short."""
    return word if len(word) <= TEXT_KEY else f"{len(word)}:{sha256(word.encode()).hexdigest()}"


_ROTATIONS = "key string, role int, word string, n long"


def _rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "role", "word", "n"])

    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            name = _name(word)
            for key, role in word_rotations(word):
                rows.append((key, role, name, n))
                if len(rows) >= _SENT:
                    yield out()
                    rows.clear()
    if rows:
        yield out()


def _neighbours(group: list[tuple[int, str, int]]) -> Iterator[tuple[str, str, int]]:
    """word, near word and its n, for all members of one range; only the shorter word is no neighbour of a repeat."""
    for role, word, _ in group:
        for other_role, other, n in group:
            if word != other and {role, other_role} != {SHORTER, REPEAT}:
                yield word, other, n


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of a sorted task. A range may run on into the next batch; it is as short as the alphabet."""
    rows: list[tuple[str, str, int]] = []
    key, group = None, []

    def out() -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["word", "near", "near_n"])

    for batch in batches:
        for k, *member in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if k != key:
                if len(group) > 1:
                    rows.extend(_neighbours(group))
                key, group = k, []
            group.append(tuple(member))
        if len(rows) >= _SENT:
            yield out()
            rows.clear()
    if len(group) > 1:
        rows.extend(_neighbours(group))
    if rows:
        yield out()


def one_edit(a: Column, b: Column) -> Column:
    """Whether two texts differ by exactly one inserted, deleted or replaced character, by halving the longest common beginning."""

    @F.pandas_udf("boolean")
    def check(left, right):
        return left.combine(right, is_one_edit)

    return check(a, b)


def is_one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    low, high = 0, len(a)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: every ordered pair of words (word, n) that are one edit apart, once."""
    rotations = words.select("word", "n").mapInArrow(_rotations, _ROTATIONS)
    # Stored before the sort, which samples its input and would otherwise make the rotations twice.
    ranges = stored(rotations, "rotations").repartitionByRange("key").sortWithinPartitions("key")
    pairs = stored(ranges.mapInArrow(_scan, "word string, near string, near_n long"), "near")
    is_text = ~F.col("word").contains(":") & ~F.col("near").contains(":")
    # Long words met by hash: fetch their texts and look at them.
    name = F.udf(_name, "string", useArrow=True)
    long_words = words.filter(F.char_length("word") >= TEXT_KEY).select(name("word").alias("name"), F.col("word").alias("text"))
    left = long_words.withColumnsRenamed({"name": "word", "text": "a"})
    right = long_words.withColumnsRenamed({"name": "near", "text": "b"})
    checked = pairs.filter(~is_text).join(left, "word").join(right, "near").filter(one_edit(F.col("a"), F.col("b")))
    return pairs.filter(is_text).unionByName(checked.select(F.col("a").alias("word"), F.col("b").alias("near"), "near_n"))


def _roots(links: DataFrame) -> DataFrame:
    """word, root of links (word, form) that end: each round doubles how far a word looks ahead."""
    reach = links.select("word", F.col("form").alias("root"))
    while True:
        ahead = reach.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        moved = reach.join(ahead, F.col("root") == F.col("_at"), "left")
        moved = stored(moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_at").isNotNull().alias("moved")), "roots")
        reach = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return reach


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the runs of letters of whole texts with A-Z lower-cased (one run in DELETE_EVERY
    loses a letter) that have ``least_letters`` letters and ``least_count`` occurrences. ``form``
    is the near word of largest n (ties: the smallest in code-point order) if it has FORM_RATIO
    times the word's n, ``root`` the last of the forms from there on; a form has twice the
    occurrences of the one before, so they end. Null and empty texts have no words; a null id
    counts as empty, and ids are cast to long; rows of one id and repeated rows all count; very
    long words are compared by hashes of their rotations and then letter by letter; an empty table
    gives no rows. Other columns are not read.
    """
    words = stored(count_words(docs, id_col, text_col, least_letters, least_count), "words", compact=True)
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    out = words.join(near, "word", "left")
    good = -F.col("best.m") >= FORM_RATIO * F.col("n")
    out = out.select(
        "word", F.when(good, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(good, -F.col("best.m")).alias("form_n"),
    )
    out = stored(out, "forms", compact=True)
    roots = _roots(out.filter("form is not null").select("word", "form"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
