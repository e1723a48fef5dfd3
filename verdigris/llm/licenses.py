"""License notices by diagonal voting.

All rolling word k-grams of every text are joined with the positions of the templates'
k-grams on a 64-bit hash (and on the words themselves): pairs of words for phrases and short
notices, four words for full licence texts, whose pairs are too common to tell anything. A
match votes for the diagonal text position - template position. Votes of neighbouring
diagonals are merged, which bridges single inserted or missing words; a template counts where
the merged votes cover enough of its places within a span that is not much longer. A base
phrase stands where every one of its pairs votes for one diagonal.

The templates are a fixed, small table, so that side is broadcast; its size does not grow
with the data, and a template may have any length. Only matches are shuffled, with partial
sums per diagonal before that.

Defined cases: a null or empty text has no words, no places and no labels, and score 0; a
text of any length is read whole; of tied labels each is named once; repeated rows and ids
are told apart by row; extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The phrases whose places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Notices in common use, lower-cased, with their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
)

# Full licence texts, lower-cased, without punctuation, with their labels.
TEXTS = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
        "zlib",
    ),
)

#: Share of a template's k-grams that the merged votes must cover, and diagonals merged with the first.
COVERAGE, SHIFT = 0.85, 2
#: Words of a k-gram of short templates and of full texts; a template of so many words is a full text.
SHORT, LONG, FULL = 2, 4, 20
#: Marks the one match that every text has.
_TEXT = -1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of letters, digits and anything beyond ASCII; A-Z are lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def grams_of(words: str) -> list[str]:
    """The rolling k-grams of a template; k follows from its length."""
    w = words.split()
    k = LONG if len(w) >= FULL else SHORT
    return [" ".join(w[j : j + k]) for j in range(len(w) - k + 1)]


def positions(spark: SparkSession, templates) -> DataFrame:
    """template, at, first to fourth: the k-grams of each (words, label, is_phrase); pairs have no third and fourth."""
    rows = [(k, at, *([*gram.split(" "), None, None][:4])) for k, (words, *_) in enumerate(templates) for at, gram in enumerate(grams_of(words))]
    return spark.createDataFrame([*rows, (_TEXT, 0, "", "", None, None)], "template int, at int, first string, second string, third string, fourth string")


def rolled(words: Column) -> Column:
    """Array of the four words from each place on, null past the end; an empty gram stands in front.

    With it every text has a match, so that the one join also brings back texts without another.
    """
    from_ = lambda k: F.slice(words, F.lit(k), F.greatest(F.size(words) - (k - 1), F.lit(0)))
    return F.arrays_zip(*(F.concat(F.array(F.lit("")), from_(k)).alias(name) for k, name in enumerate("abcd", 1)))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES + TEXTS, coverage: float = COVERAGE, shift: int = SHIFT) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    known = [(*x, True) for x in phrases] + [(*x, False) for x in templates]
    size = [len(grams_of(words)) for words, *_ in known]
    of = lambda values, kind: F.create_map(*(F.lit(x) for k, v in enumerate(values) for x in (k, v)))[F.col("template")].cast(kind)

    # The key is the hash of a gram's first two words, so that one join serves both lengths; the words themselves decide.
    table = positions(spark, known).withColumn("hash", F.xxhash64("first", "second"))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    grams = texts.select("row", "doc_id", F.size("words").alias("n_words"), F.posexplode(rolled(F.col("words"))).alias("pos", "g")).select("row", "doc_id", "n_words", (F.col("pos") - 1).alias("pos"), "g.*").withColumn("hash", F.xxhash64("a", "b"))
    same = (F.col("a") == F.col("first")) & (F.col("b") == F.col("second")) & (F.col("third").isNull() | ((F.col("c") == F.col("third")) & (F.col("d") == F.col("fourth"))))
    hits = grams.join(F.broadcast(table), "hash").filter(same).select("row", "doc_id", "n_words", "template", "at", (F.col("pos") - F.col("at")).alias("diagonal"), "pos")

    # A vote counts for its own diagonal and, in templates, for the neighbours below that it may belong to.
    spread = hits.select("row", "doc_id", "n_words", "template", "at", "pos", F.explode(F.when((F.col("template") == _TEXT) | of([x[2] for x in known], "boolean"), F.array("diagonal")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(shift)), lambda d: F.col("diagonal") - d))).alias("diagonal"))
    votes = spread.groupBy("row", "doc_id", "n_words", "template", "diagonal").agg(F.size(F.collect_set("at")).alias("seen"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    share = F.col("seen") / of(size, "double")
    whole = (F.col("seen") == of(size, "int")) & of([x[2] for x in known], "boolean")
    noted = ~of([x[2] for x in known], "boolean") & (share >= coverage) & (F.col("high") - F.col("low") < of(size, "int") + shift)
    label = of([x[1] for x in known], "string")

    found = votes.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(whole).alias("n_base"),
        F.min(F.when(whole, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("diagonal"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(whole, label))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(whole | noted, label))), ",").alias("labels"),
        F.coalesce(F.max(F.when(whole, F.lit(1.0)).when(noted, share)), F.lit(0.0)).alias("score"),
    )
    return found.select("doc_id", F.col("n_words").cast("long"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
