"""Find license names, notices and texts by ordered signature rules.

A text is brought to lower-case words with one blank between them. Texts without any rule's keyword
are passed over by one prefilter. In the others, the rules of a keyword are tried around each place
where it stands, on a window as wide as any rule; so a rule gives at most one detection a place,
and hundreds of rules cost little where few keywords are. Detections overlap, since a rule for a
version also contains the bare name: one that lies within another of at least its priority is
suppressed. Everything happens inside a row: nothing is shuffled.
"""

import json
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.llm import license_rules
from tabulon.llm.license_rules import BASE, LEFT, RIGHT, Rule
from tabulon.llm.shared import ascii_lower, text_of

# What stands between words: ASCII other than letters and digits.
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def keyword_filter(keywords: Sequence[str]) -> str:
    """One expression that finds any of the words between blanks, branching on the first letter."""
    by_letter = defaultdict(list)
    for word in sorted(set(keywords)):
        by_letter[word[0]].append(word[1:])
    return " (?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by_letter.items()) + ") "


def word_text(text: Column) -> Column:
    """Lower-case words of a text with one blank between them."""
    return F.trim(F.regexp_replace(ascii_lower(text), GAPS, " "))


def _blanks(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" ")))


def _rule_map(rules: Sequence[Rule]) -> Column:
    """Rules by keyword, as one constant."""
    by_word: dict[str, list[dict]] = defaultdict(list)
    for order, r in enumerate(rules):
        by_word[r.keyword].append({"pattern": r.pattern, "priority": r.priority, "place": order, "label": r.label, "weight": r.weight})
    kind = "map<string,array<struct<pattern:string,priority:int,place:int,label:string,weight:double>>>"
    return F.from_json(F.lit(json.dumps(by_word)), kind)


def _detections(words: Column, rules: Sequence[Rule]) -> Column:
    """All detections of a text's words, by start, then longest, highest and first."""
    keywords, table = sorted({r.keyword for r in rules}), _rule_map(rules)
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(keywords))

    def window(i: Column) -> Column:
        n = F.least(i, F.lit(LEFT))
        before = F.transform(F.slice(words, i - n + 1, n), lambda w: F.concat(w, F.lit(" ")))
        return F.concat(F.lit(" "), F.array_join(before, ""), F.lit("@"), F.array_join(F.slice(words, i + 1, F.lit(RIGHT + 1)), " "), F.lit(" "))

    around = F.transform(places, lambda i: F.struct(i.alias("i"), F.get(words, i).alias("word"), window(i).alias("text")))
    # Rule by rule, so that each expression is prepared once a text and not once a place.
    present = F.array_distinct(F.transform(around, lambda p: p["word"]))
    by_word = F.transform(present, lambda w: F.struct(F.element_at(table, w).alias("rules"), F.filter(around, lambda p: p["word"] == w).alias("at")))

    def tried(g: Column, r: Column) -> Column:
        cut = F.transform(g["at"], lambda p: F.struct(p["i"].alias("i"), F.call_function("regexp_extract", p["text"], r["pattern"], F.lit(0)).alias("m")))
        return F.transform(F.filter(cut, lambda c: c["m"] != ""), lambda c: _detection(c["i"], r, c["m"]))

    return F.sort_array(F.flatten(F.transform(by_word, lambda g: F.flatten(F.transform(g["rules"], lambda r: tried(g, r))))))


def _detection(i: Column, rule: Column, match: Column) -> Column:
    """Sorts by start, then the longest, the highest priority and the first rule."""
    start = i - _blanks(F.substring_index(match, "@", 1)) + 1
    return F.struct(
        start.alias("start"), (-(start + _blanks(match) - 1)).alias("minus_end"), (-rule["priority"]).alias("minus_priority"), rule["place"].alias("place"),
        rule["label"].alias("label"), rule["weight"].alias("weight"),
    )


def _kept(detections: Column) -> Column:
    """Labels that are left, their number and their largest weight.

    Whatever contains a detection sorts before it, so one pass will do that knows, for each
    priority, how far detections of at least that priority have reached.
    """
    levels = range(BASE + 1)

    def step(state: Column, d: Column) -> Column:
        end, priority = -d["minus_end"], -d["minus_priority"]
        free = F.get(state["reach"], priority) < end
        reach = F.array(*[F.when(priority >= p, F.greatest(F.get(state["reach"], F.lit(p)), end)).otherwise(F.get(state["reach"], F.lit(p))) for p in levels])
        label = F.when(free & ~F.array_contains(state["labels"], d["label"]), F.concat(state["labels"], F.array(d["label"]))).otherwise(state["labels"])
        top = F.when(free, F.greatest(state["score"], d["weight"])).otherwise(state["score"])
        return F.struct(reach.alias("reach"), label.alias("labels"), (state["n"] + free.cast("long")).alias("n"), top.alias("score"))

    none = F.array().cast("array<string>")
    start = F.struct(
        F.array(*[F.lit(-1) for _ in levels]).alias("reach"), none.alias("labels"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("score")
    )
    return F.aggregate(detections, start, step)


def _listed(labels: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(labels)), ",")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections.

    ``n_base`` counts the places of base phrases (rules of the highest priority), ``first_word`` and
    ``last_word`` are their smallest and largest start in words from 0, or null. ``labels`` are
    those of detections that lie within no other of at least their priority (of equals the first
    rule's stays), and the base labels; both lists are distinct, sorted and joined by commas.
    ``score`` is the largest weight of a detection that stays, 0 without one. Whole texts of any
    length are read. Null and empty texts have no words and no labels; null or repeated ids and
    repeated rows are passed on; other columns are not read; an empty table gives no rows.
    """
    rules = license_rules.rules() if rules is None else rules
    body = F.col("_body")
    hot = F.concat(F.lit(" "), body, F.lit(" ")).rlike(keyword_filter([r.keyword for r in rules]))
    found = docs.select(F.col(id_col).alias("_id"), word_text(text_of(text_col)).alias("_body"))
    n_words = F.when(body == "", 0).otherwise(_blanks(body) + 1).cast("long")
    found = found.select("_id", n_words.alias("n_words"), F.when(hot, F.split(body, " ")).alias("_words"))
    detections = F.when(F.col("_words").isNotNull(), _detections(F.col("_words"), rules))
    found = found.select("_id", "n_words", detections.alias("_all"))
    base = F.filter("_all", lambda d: d["minus_priority"] == -BASE)
    found = found.select("_id", "n_words", base.alias("_base"), F.when(F.col("_all").isNotNull(), _kept(F.col("_all"))).alias("_kept"))
    starts = F.transform("_base", lambda d: d["start"].cast("long"))
    base_labels, none = F.transform("_base", lambda d: d["label"]), F.array().cast("array<string>")
    return found.select(
        F.col("_id").alias(id_col), "n_words", F.when(F.col("_base").isNull(), 0).otherwise(F.size("_base")).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.coalesce(_listed(base_labels), F.lit("")).alias("base_labels"),
        _listed(F.concat(F.coalesce(base_labels, none), F.coalesce("_kept.labels", none))).alias("labels"),
        F.coalesce("_kept.score", F.lit(0.0)).alias("score"), F.coalesce("_kept.n", F.lit(0).cast("long")).alias("n_detections"),
    )
