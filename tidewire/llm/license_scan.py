"""License scans by diagonal voting.

All rolling hashes of 2 and 3 consecutive words of a text are joined to the places where templates hold them. A match votes for
the diagonal (place in the text minus place in the template) on which the whole template would lie; votes are counted by
text, template and diagonal, and neighbouring diagonals are merged to runs. A run can hold several tries at a template, so its
votes are put in order, and of all spans of the template's length and a quarter more that begin at a vote the one that
holds most of the template is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, buffers, grams, steps, word_hash

# Phrases of the scan's contract, found wherever their words stand consecutively.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Notices and bodies of public licenses, as words.
TEMPLATES = [
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
]

# Identifiers of the tag "SPDX-License-Identifier:" and their labels.
SPDX = {"agpl 3 0": "agpl", "apache 2 0": "apache-2.0", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd-3-clause", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc0 1 0": "cc0", "gpl 2 0": "gpl", "gpl 3 0": "gpl", "isc": "isc", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "mit": "mit", "mpl 2 0": "mpl-2.0", "unlicense": "unlicense"}
TEMPLATES += [(label, f"spdx license identifier {name}") for name, label in SPDX.items()]

#: A place in every text that always matches, so that a text without matches has a row.
_MARK = 0x5EED


def template_grams(spark: SparkSession, phrases: dict[str, str], templates: list[tuple[str, str]]) -> DataFrame:
    """hash, template, label, base, t_at, t_grams, t_words: a row for each gram of each phrase and template, and the mark."""
    rows = [(_MARK, -1, "", False, 0, 1, 0)]
    for i, (label, text, base) in enumerate([(v, k, True) for k, v in phrases.items()] + [(a, b, False) for a, b in templates]):
        words = text.split()
        k = 3 if len(words) >= 3 else 2
        own = grams(np.array([word_hash(w) for w in words], dtype=np.uint64), k).view(np.int64).tolist()
        rows += [(h, i, label, base, at, len(own), len(words)) for at, h in enumerate(own)]
    return spark.createDataFrame(rows, "hash long, template int, label string, base boolean, t_at int, t_grams int, t_words int")


def _emit(names: list[str]):
    """A text's hashes: the mark, those of each 2 words, those of each 3 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("_text"))
            for lo, hi in steps(offsets, 4 << 20):
                words = Words(data, offsets, lo, hi)
                n = words.count
                two, three = np.maximum(n - 1, 0), np.maximum(n - 2, 0)
                out = np.full(int((1 + two + three).sum()), _MARK, dtype=np.int64)
                begin = np.cumsum(1 + two + three) - (1 + two + three)
                first = np.cumsum(n) - n
                for k, size, skip in ((2, two, 1), (3, three, 1 + two)):
                    row = np.repeat(np.arange(hi - lo), size)
                    within = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                    out[begin[row] + (skip if k == 2 else skip[row]) + within] = grams(words.hash, k).view(np.int64)[first[row] + within]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(out)].astype(np.int32)), pa.array(out))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in names], pa.array(n.astype(np.int64)), lists], names=[*names, "n_words", "hashes"])

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, least: float = 0.6, drift: int = 3) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    A phrase is found where all its grams vote for one diagonal; n_base counts all places, first_word and last_word are
    the smallest and largest of their starts (null if none). A template is found where diagonals at most `drift` apart
    hold at least the share `least` of its grams within a span of at most its words plus a quarter; of a run the best such span
    counts, the first of equal ones. score is the largest
    share found (1 for a phrase), 0 without labels; spans are (label, first word, last word + 1). Null texts are
    empty; repeated rows come back as often as they came; null ids are ids; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    known = template_grams(spark, PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text")).withColumn("digest", F.unhex(F.md5("_text")))
    kind = base.schema["id"].dataType.simpleString()
    lists = base.select("id", "digest", "_text").mapInArrow(_emit(["id", "digest"]), f"id {kind}, digest binary, n_words long, hashes array<long>")
    votes = lists.select("id", "digest", "n_words", F.posexplode("hashes").alias("i", "hash")).join(F.broadcast(known), "hash")
    # The 2-grams follow the mark, the 3-grams follow them.
    at = F.when(F.col("t_words") == 0, 0).otherwise(F.col("i") - 1 - F.when(F.col("t_words") >= 3, F.greatest(F.col("n_words") - 1, F.lit(0))).otherwise(0))
    key = ["id", "digest", "n_words"]
    # Few places match anything, and they go on as the votes of a diagonal. A text's places are listed once, however often its row came.
    diagonal = votes.groupBy(*key, "template", "label", "base", "t_grams", "t_words", (at - F.col("t_at")).alias("diagonal")).agg(F.count(F.lit(1)).alias("rows"), F.collect_set(F.struct(at.alias("at"), F.col("t_at").alias("t"))).alias("votes"))
    own = Window.partitionBy("id", "digest", "n_words", "template").orderBy("diagonal")
    near = diagonal.withColumn("run", F.sum(F.when((F.col("diagonal") - F.lag("diagonal").over(own) <= drift) & ~F.col("base"), 0).otherwise(1)).over(own))
    runs = near.groupBy(*key, "template", "label", "base", "t_grams", "t_words", "run").agg(F.max("rows").alias("rows"), F.array_sort(F.flatten(F.collect_list("votes"))).alias("votes"), F.min("diagonal").alias("diagonal"))
    gram = F.when(F.col("t_words") >= 3, 3).otherwise(2)
    # The votes of a span that begins at the i-th are among the next ones: at each place no more than one for each of the run's diagonals.
    reach = (1.25 * F.col("t_words") - gram).cast("int")
    ahead = lambda v, i: F.filter(F.slice("votes", i + 1, (reach + 1) * F.col("t_grams")), lambda x: x["at"] - v["at"] <= reach)
    spans = F.transform("votes", lambda v, i: F.struct(F.size(F.array_distinct(F.transform(ahead(v, i), lambda x: x["t"]))).alias("n"), (-v["at"]).alias("first"), F.array_max(F.transform(ahead(v, i), lambda x: x["at"])).alias("last")))
    runs = runs.withColumn("best", F.when(F.col("template") >= 0, F.array_max(spans))).withColumns({"n": F.col("best.n"), "first": -F.col("best.first"), "last": F.col("best.last")})
    share = F.col("n") / F.col("t_grams")
    found = runs.withColumn("share", F.when(F.col("template") < 0, None).when(F.col("base"), F.when(F.col("n") == F.col("t_grams"), 1.0)).when(share >= least, share))
    is_base = F.col("base") & F.col("share").isNotNull()
    label = F.when(F.col("share").isNotNull(), F.col("label"))
    rows = found.groupBy(*key).agg(
        F.max(F.when(F.col("template") < 0, F.col("rows"))).alias("copies"), F.count_if(is_base).cast("long").alias("n_base"), F.min(F.when(is_base, F.col("diagonal"))).cast("long").alias("first_word"), F.max(F.when(is_base, F.col("diagonal"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("share").isNotNull(), F.struct("label", "first", (F.col("last") + gram).alias("end"))))).alias("spans"),
    )
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
