"""Names that may mean the same, in groups of bounded size, so that a model can be asked about any number of them.

Names of a book and type are linked where they share a word that is no title, or words a letter apart; linked ones are a component, and a
component is cut into groups of ``most`` names in order of their words, so that those that share more lie together.

Links are never pairs of names: each name has *keys* (its words, its longer words with a letter left open, and with one left out where that is a word
as well), and a round takes the least label of a key's names, then of a name's keys, until none changes. Both steps are combined map-side, so a word in a
third of all names is one row a task. Rounds are at most as many as the longest chain of names; each is a table of its own, so none repeats another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.numbering import running_sums
from quire.sources.store import scratch

#: Words of names that say nothing of who is meant.
TITLES = "mr mrs ms miss dr sir lady lord st the of and de du la le von van der den captain colonel count king queen prince princess father mother uncle aunt".split()
LEAST_LETTERS = 5
MOST = 200


def words(name: Column | str) -> Column:
    """A name's words in small letters, without titles; all of them where there is nothing else."""
    every = F.filter(F.split(F.lower(F.col(name) if isinstance(name, str) else name), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    told = F.filter(every, lambda w: ~w.isin(TITLES))
    return F.array_distinct(F.when(F.size(told) > 0, told).otherwise(every))


def _letters(found: Column, key) -> Column:
    """key(before, behind) of each longer word and each of its letters: what stands before it and behind it."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: key(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.array_distinct(F.flatten(F.transform(F.filter(found, lambda w: F.length(w) >= LEAST_LETTERS), one)))


def keys(found: Column) -> Column:
    """What names with a word in common, or words that differ in one letter, have in common."""
    return F.concat(F.transform(found, lambda w: F.concat(F.lit("+"), w)), _letters(found, lambda a, b: F.concat(F.lit("-"), a, F.lit("."), b)))


def shorter(found: Column) -> Column:
    """The words, as keys, that lack one letter of a longer word."""
    return F.filter(_letters(found, lambda a, b: F.concat(F.lit("+"), a, b)), lambda k: F.length(k) > LEAST_LETTERS)


def components(names: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(book_id, name, type, component) of distinct names; a component is named by its least name."""
    rows = names.select("book_id", "name", "type").where("name IS NOT NULL").distinct()
    unit = ["book_id", "type"]
    held = scratch(rows.select(*unit, "name", F.explode(keys(words("name"))).alias("key")))
    # two words that lack different letters of a third are only linked where that one is a word itself
    less = rows.select(*unit, "name", F.explode(shorter(words("name"))).alias("key")).join(held.select(*unit, "key").distinct(), [*unit, "key"], "left_semi")
    linked = scratch(held.unionByName(less))
    label = scratch(rows.withColumn("component", F.col("name")))
    for _ in range(most_rounds):
        of_key = linked.join(label, [*unit, "name"]).groupBy(*unit, "key").agg(F.min("component").alias("least"))
        of_name = linked.join(of_key, [*unit, "key"]).groupBy(*unit, "name").agg(F.min("least").alias("least"))
        after = scratch(label.join(of_name, [*unit, "name"], "left").select(*unit, "name", F.least("component", F.coalesce("least", "component")).alias("component"), (F.col("least") < F.col("component")).alias("changed")))
        label = after.drop("changed")
        if after.where("changed").isEmpty():
            return label.select("book_id", "name", "type", "component")
    raise RuntimeError(f"names are linked in chains of more than {most_rounds}")


def groups(names: DataFrame, most: int = MOST) -> DataFrame:
    """(book_id, name, type, component, part): each name with its component and its part of it, of ``most`` names at most."""
    found = components(names)
    shown = F.array_join(F.array_sort(words("name")), " ")
    # numbers in order of words: whole numbers that running_sums can cut into ranges
    ordered = scratch(found.repartitionByRange("book_id", "component", shown, "name").sortWithinPartitions("book_id", "component", shown, "name").withColumn("__no", F.monotonically_increasing_id()))
    numbered = running_sums(ordered, ["book_id", "type", "component"], "__no", {"__n": F.lit(1)})
    return numbered.select("book_id", "name", "type", "component", F.floor((F.col("__n") - 1) / most).cast("int").alias("part"))
