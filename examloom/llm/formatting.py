"""Problem 2: records that are the same but for formatting, collapsed into one with its number of copies.

Method: a hash of each (field name, normalised value) pair, combined by addition modulo a prime in two lanes (so the
order of fields does not matter and nothing is sorted), grouping by that fingerprint, then comparison of the fields
themselves with those of the group's first row.

Defined cases: blanks, invisible characters, letter case and punctuation do not count. Marks that carry a value do: a
point, comma, colon, slash, dash or tilde between digits, a sign before a number or alone in brackets, and + < > = % and
other symbols. The options are a set: their letters, order and repetitions do not count, an option that is null or
empty after normalising is as no option. Rows with null question or options are no records. Fields that normalise to
nothing are equal. The first row is the smallest id; rows repeated with the same id count as copies of one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examloom.llm._common import hot_keys, salted_join
from examloom.session import materialize

#: Width forms and look-alikes of the marks that may carry a value, and what they stand for.
MARKS_FROM = "．，：／～〜－−‐‑–＋＜＞＝％（）"
MARKS_TO = ".,:/~~-----+<>=%()"
#: Below 2^61, so that a sum of two residues never overflows.
PRIME = (1 << 61) - 1


#: Stands between the fields of a record while they are normalised together; removed from the texts themselves.
SEPARATOR = "\ue000"
#: A dash counts between digits, alone in brackets, or before a digit after anything but a letter or digit (a Han
#: character is no letter here); other marks count between digits; all other punctuation goes.
_DROP = (
    r"-(?!(?<=\p{N}-)\p{N}|(?<=\(-)\)|(?<![\p{L}\p{N}&&[^\p{IsHan}]]-)\p{N})"
    r"|(?<!\p{N})[.,:/~]|[.,:/~](?!\p{N})|[\p{P}`&&[^.,:/\-%‰]]"
)


def normalized(text: Column) -> Column:
    """Text without what is only formatting. The blanks go first, so that marks see their neighbours."""
    t = F.lower(F.translate(text, MARKS_FROM, MARKS_TO))
    return F.regexp_replace(F.regexp_replace(t, r"[\p{Z}\p{Cc}\p{Cf}]+", ""), _DROP, "")


def normalized_fields(question: Column, options: Column, text: str) -> Column:
    """[question, option, ...] normalised in one go, which costs two scans of a record whatever its number of options."""
    clean = lambda c: F.translate(F.coalesce(c, F.lit("")), SEPARATOR, "")
    parts = F.concat(F.array(clean(question)), F.transform(options, lambda o: clean(o[text])))
    return F.split(normalized(F.array_join(parts, SEPARATOR)), SEPARATOR)


def multiset_hash(lane: int, question: Column, options: Column) -> Column:
    """Sum of the pairs' hashes modulo a prime; commutative, so fields and options need no order."""
    pair = lambda name, value: F.pmod(F.xxhash64(F.lit(f"{lane}:{name}"), value), F.lit(PRIME))
    return F.aggregate(options, pair("question", question), lambda acc, x: F.pmod(acc + pair("option", x), F.lit(PRIME)))


def fingerprints(rows: DataFrame, key: str, question: str, options: str, text: str = "text") -> DataFrame:
    d = rows.filter(F.col(question).isNotNull() & F.col(options).isNotNull())
    d = d.select(F.col(key).alias("id"), normalized_fields(F.col(question), F.col(options), text).alias("all"))
    others = F.filter(F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0))), lambda x: x != "")
    d = d.select("id", F.col("all")[0].alias("q"), F.array_distinct(others).alias("o"))
    return d.select("id", "q", "o", multiset_hash(1, F.col("q"), F.col("o")).alias("f1"), multiset_hash(2, F.col("q"), F.col("o")).alias("f2"))


def formatting_members(rows: DataFrame, key: str = "row_id", question: str = "question", options: str = "options", text: str = "text") -> DataFrame:
    """(first, id) of every row whose fields another row has too, apart from formatting; first is the smallest such id.

    Texts move once, to their fingerprint's partition, where each row is compared with the first one of its group. The
    rows of the groups with the most copies (a thousand at most, see hot_keys) are spread over many tasks, to each of which
    the group's first row is sent; only fingerprints are broadcast.
    """
    base = materialize(fingerprints(rows, key, question, options, text), "fingerprints")
    pair = ["f1", "f2"]
    groups = base.groupBy(*pair).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    hot = materialize(hot_keys(groups, pair, "n"), "hot")
    large = base.join(F.broadcast(hot), pair, "left_semi")
    heads = groups.join(F.broadcast(hot), pair, "left_semi").join(large.select("id", F.col("q").alias("hq"), F.col("o").alias("ho"), *[F.col(c).alias("_" + c) for c in pair]), (F.col("id") == F.col("first")) & (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")))
    heads = heads.groupBy(*pair, "first", "n").agg(F.first("hq").alias("hq"), F.first("ho").alias("ho"))
    large = salted_join(large, heads, pair, "n", F.col("id"))
    group = Window.partitionBy(*pair)
    upto = group.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    small = base.join(F.broadcast(hot), pair, "left_anti").withColumn("n", F.count("*").over(group))
    for new, old in (("first", "id"), ("hq", "q"), ("ho", "o")):
        small = small.withColumn(new, F.first(old).over(upto))
    small = small.filter("n > 1")
    same = (F.col("q") == F.col("hq")) & (F.size("o") == F.size("ho")) & (F.size(F.array_except("o", "ho")) == 0)
    checked = materialize(large.select(*pair, "id", "first", same.alias("same")).union(small.select(*pair, "id", "first", same.alias("same"))), "members")
    good, other = checked.filter("same").select("first", "id"), checked.filter("not same")
    if other.isEmpty():
        return good
    # rows that only share the fingerprint (none are expected) form their own exact groups
    texts = base.join(other.select("id", *pair), ["id", *pair], "left_semi").withColumn("s", F.array_sort("o"))
    exact = texts.groupBy(*pair, "q", "s").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = texts.join(exact, [*pair, "q", "s"]).select("first", "id")
    twice = good.groupBy("first").agg(F.count("*").alias("n")).filter("n > 1").select("first")
    return good.join(twice, "first", "left_semi").union(again)


def collapse_formatting(rows: DataFrame, key: str = "row_id", question: str = "question", options: str = "options", text: str = "text") -> DataFrame:
    """One row a record: its first id and its number of copies (1 where no other row has the same fields)."""
    members = formatting_members(rows, key, question, options, text)
    many = members.groupBy("first").agg(F.count("*").alias("copies"))
    single = rows.filter(F.col(question).isNotNull() & F.col(options).isNotNull()).select(F.col(key).alias("first"))
    single = single.join(members.select(F.col("id").alias("first")), "first", "left_anti").select("first", F.lit(1).cast("long").alias("copies"))
    return many.union(single)
