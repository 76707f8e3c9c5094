"""Exact copies: local dedup, salted merge, then one winner for each text."""

from pyspark.sql import DataFrame, functions as F

from tabulon.llm.shared import ascii_lower, stored, text_of

SALTS = 16


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, normalised text, its digest and a mark of the text itself; no other column goes on, so no name can clash."""
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(text_of(text_col)).alias("norm"), F.xxhash64(text_of(text_col)).alias("mark"))
    return rows.select("id", "norm", F.unhex(F.sha2("norm", 256)).alias("digest"), "mark")


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: digest, norm, keep_id (largest id), group_size.

    Every step groups by the whole text beside its digest. The first aggregate is partial in each
    task (local dedup) and merges within a salt of the id, so a text that a third of all rows
    share arrives as at most one row per task and is spread over the salts; the second combines
    the winners of the salts.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("byte")
    salted = (
        _texts(docs, id_col, text_col)
        .groupBy("digest", salt.alias("salt"), "norm")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    return salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest id stays. A
    null text is an empty one; a null id stays only where no row of the group has an id. Repeated
    rows (same id, same text) are one document and share their decision. An empty table gives no
    rows. Other columns are not read.
    """
    return _groups(docs, id_col, text_col, salts).drop("text_mark")


def _groups(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """The groups, beside a hash of each row's text as it is."""
    texts = text_classes(docs, id_col, text_col, salts)
    digests = stored(
        texts.groupBy("digest").agg(
            F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
        ),
        "digests",
    )
    rows = _texts(docs, id_col, text_col)
    found = rows.select("id", "digest", "mark").join(digests.filter("texts = 1").drop("texts"), "digest")
    shared_digests = digests.filter("texts > 1").select("digest")
    if not shared_digests.isEmpty():
        # Different texts under one digest: these few are matched by their whole text.
        among = rows.join(shared_digests, "digest", "left_semi")
        each = texts.join(shared_digests, "digest", "left_semi")
        found = found.unionByName(among.join(each, ["digest", "norm"]).drop("norm"))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("mark").alias("text_mark"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: exactly one of equal texts.

    It has the largest id. Of several rows with that id, or of rows that all lack one, the one whose
    text has the smallest 64-bit mark stays, and of rows with that id and text any one. Only the ids
    and marks of rows that have copies are written and joined; where they are few the planner
    broadcasts them and no text moves again.
    """
    copies = _groups(docs, id_col, text_col, salts).filter("group_size > 1").select(F.col(id_col).alias("_gone"), "text_mark", "kept", "text_sha256")
    copies = stored(copies, "copies")
    # More rows than one with the id that stays; mostly there are none.
    firsts = copies.filter("kept")
    ties = firsts.groupBy("text_sha256").agg(F.min("text_mark").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    tied = stored(firsts.join(ties, "text_sha256").groupBy("_gone", "text_mark", "keep").agg(F.count(F.lit(1)).alias("n")), "tied")
    gone = copies.filter("not kept").unionByName(tied.filter("text_mark <> keep"), allowMissingColumns=True).select("_gone", "text_mark").distinct()
    gone = stored(gone, "dropped")
    repeated = tied.filter("text_mark = keep and n > 1").select("_gone", "text_mark")
    mark = F.xxhash64(text_of(text_col))

    def among(rows: DataFrame, how: str) -> DataFrame:
        return docs.join(rows, docs[id_col].eqNullSafe(rows["_gone"]) & (mark == rows["text_mark"]), how)

    if repeated.isEmpty():
        return among(gone, "left_anti")
    # Any one of equal rows: an aggregate that is partial in each task.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = among(repeated, "left_semi").groupBy(F.col(id_col), mark).agg(F.first(whole).alias("_row")).select("_row.*")
    return among(gone.unionByName(repeated), "left_anti").unionByName(one)
