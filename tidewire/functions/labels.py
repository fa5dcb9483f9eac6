"""Action labels: mapping of ids, canonical names, transcripts, and probabilities by canonical name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of movements that count as one action, and names with a canonical one.
MOVEMENTS = ["back", "backward", "forword", "forward", "right", "left"]
MOVE = "move"
CANONICAL = {"step": "moonwalk"}

# Words of transcripts and the actions that they stand for.
ALIASES = {"站立": "stand", "趴下": "stand", "蹲下": "stand", "起立": "stand", "前进": "step", "向前": "step", "移动": "step", "打招呼": "hello", "招手": "hello", "太空步": "moonwalk", "扭身体": "twistBody", "扭身": "twistBody"}


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def mapped_label(raw: Column, names: dict[str, str]) -> Column:
    """The name of a label id; ids like 3, "3" and "3.0" are one; a label without a name stays as it is (whole numbers without their .0)."""
    text = F.trim(raw.cast("string"))
    number = text.try_cast("double")
    whole = F.when(number == F.floor(number), number.cast("long").cast("string"))
    return F.coalesce(_lookup(names, text), _lookup(names, whole), whole, text)


def canonical_label(label: Column) -> Column:
    """Movements as move, names with a canonical one as that; others trimmed."""
    own = F.trim(label.cast("string"))
    return F.when(F.lower(own).isin(*MOVEMENTS), MOVE).otherwise(F.coalesce(_lookup(CANONICAL, F.lower(own)), own))


def canonical_probabilities(probabilities: Column) -> Column:
    """A map of labels to probabilities with those of one canonical name added up, in the order of the names."""
    entries = F.transform(F.map_entries(probabilities), lambda e: F.struct(canonical_label(e["key"]).alias("k"), e["value"].cast("double").alias("v")))
    keys = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["k"])))
    total = lambda k: F.aggregate(F.filter(entries, lambda e: e["k"] == k), F.lit(0.0), lambda a, e: a + e["v"])
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), total(k).alias("value"))))


def transcript_labels(words: Column) -> Column:
    """An array of transcript words as actions: known words by their action, others trimmed, blank ones left out."""
    own = F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != "")
    return F.transform(own, lambda w: F.coalesce(_lookup(ALIASES, w), w))
