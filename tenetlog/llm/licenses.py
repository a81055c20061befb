"""License scans: ordered signature rules over normalised words, in DataFrame functions only.

A text becomes its words in lower case with single spaces. A keyword gate lets few texts
through; each keyword a text holds brings its rules by a join with the rule table (a few
hundred rows). A rule's matches become intervals. Among the intervals of a text, one that
lies inside another is suppressed; of two equal ones the rule of the smaller priority
number stays. The surviving rules give labels and score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenetlog.llm import common

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Signatures: (keyword, label, priority, confidence, pattern over lower-case words with single spaces).
# Families with versions are written once and filled in from their versions.
FAMILIES = [
    ("gpl", ["1", "2", "3"], "gnu", [
        (10, 1.0, r"gnu general public license (?:as published by the free software foundation )?(?:either )?v(?:ersion)? ?{v}(?: 0)?(?: or (?:at your option )?(?:any )?later(?: version)?)?"),
        (20, 0.95, r"gnu gpl ?v(?:ersion)? ?{v}(?: 0)?(?: or later)?"),
        (20, 0.95, r"terms of the gnu (?:gpl|general public license) (?:version )?{v}(?: 0)?"),
        (30, 0.9, r"gnu general public license {v}(?: 0)?")]),
    ("gpl", ["1", "2", "3"], "gpl", [
        (20, 0.95, r"gpl ?v ?{v}(?: 0)?(?: or later)?(?: only)?"),
        (20, 0.95, r"gpl {v} 0(?: or later| only)?"),
        (30, 0.9, r"gpl version {v}(?: 0)?"),
        (25, 0.95, r"gplv{v}(?: or later)?")]),
    ("lgpl", ["2", "2 1", "3"], "lesser", [
        (10, 1.0, r"gnu lesser general public license (?:as published by the free software foundation )?(?:either )?v(?:ersion)? ?{v}(?: 0)?(?: or (?:at your option )?(?:any )?later(?: version)?)?"),
        (30, 0.9, r"lesser general public license {v}(?: 0)?")]),
    ("lgpl", ["2", "2 1", "3"], "lgpl", [
        (20, 0.95, r"lgpl ?v? ?{v}(?: 0)?(?: or later| only)?"),
        (30, 0.9, r"lgpl version {v}(?: 0)?")]),
    ("agpl", ["1", "3"], "affero", [
        (10, 1.0, r"gnu affero general public license (?:as published by the free software foundation )?v(?:ersion)? ?{v}(?: 0)?(?: or (?:at your option )?(?:any )?later(?: version)?)?"),
        (30, 0.9, r"affero general public license {v}(?: 0)?")]),
    ("agpl", ["1", "3"], "agpl", [
        (20, 0.95, r"agpl ?v? ?{v}(?: 0)?(?: or later| only)?")]),
    ("apache", ["1 0", "1 1", "2 0"], "apache", [
        (10, 1.0, r"(?:licensed under the )?apache license v(?:ersion)? ?{v}(?: the license)?"),
        (15, 1.0, r"apache software license v(?:ersion)? ?{v}"),
        (20, 0.95, r"apache ?{v}(?: license)?"),
        (20, 0.95, r"apache license {v}"),
        (30, 0.9, r"asl ?{v} apache")]),
    ("bsd", ["2", "3", "4"], "bsd", [
        (10, 1.0, r"bsd {v} clause(?: license)?"),
        (10, 1.0, r"{v} clause bsd(?: license)?")]),
    ("bsd", ["simplified", "modified", "revised", "new", "original", "free"], "bsd", [
        (15, 0.95, r"{v} bsd(?: license)?"),
        (20, 0.9, r"bsd license {v}")]),
    ("mpl", ["1 0", "1 1", "2 0"], "mozilla", [
        (10, 1.0, r"mozilla public license v(?:ersion)? ?{v}"),
        (20, 0.95, r"mozilla public license {v}")]),
    ("mpl", ["1 0", "1 1", "2 0"], "mpl", [(20, 0.95, r"mpl ?v? ?{v}")]),
    ("epl", ["1 0", "2 0"], "eclipse", [
        (10, 1.0, r"eclipse public license v(?:ersion)? ?{v}"),
        (20, 0.95, r"eclipse public license {v}")]),
    ("epl", ["1 0", "2 0"], "epl", [(20, 0.95, r"epl ?v? ?{v}")]),
    ("cddl", ["1 0", "1 1"], "cddl", [(20, 0.95, r"cddl ?v? ?{v}")]),
    ("cddl", ["1 0", "1 1"], "distribution", [
        (10, 1.0, r"common development and distribution license v(?:ersion)? ?{v}")]),
    ("eupl", ["1 0", "1 1", "1 2"], "eupl", [(20, 0.95, r"eupl ?v? ?{v}")]),
    ("artistic", ["1 0", "2 0"], "artistic", [(10, 1.0, r"artistic license v?(?:ersion)? ?{v}")]),
    ("osl", ["1 0", "2 0", "2 1", "3 0"], "osl", [(20, 0.95, r"osl ?v? ?{v}")]),
    ("afl", ["2 0", "2 1", "3 0"], "academic", [(10, 1.0, r"academic free license v(?:ersion)? ?{v}")]),
    ("gfdl", ["1 1", "1 2", "1 3"], "documentation", [
        (10, 1.0, r"gnu free documentation license v(?:ersion)? ?{v}(?: or (?:any )?later(?: version)?)?")]),
    ("gfdl", ["1 1", "1 2", "1 3"], "gfdl", [(20, 0.95, r"gfdl ?v? ?{v}")]),
    ("php", ["3 0", "3 01"], "php", [(10, 1.0, r"php license v?(?:ersion)? ?{v}")]),
    ("python", ["2", "2 0", "2 1 1"], "python", [(10, 1.0, r"python (?:software foundation )?license v?(?:ersion)? ?{v}")]),
    ("zpl", ["1 1", "2 0", "2 1"], "zope", [(10, 1.0, r"zope public license v?(?:ersion)? ?{v}")]),
    ("bsl", ["1 0"], "boost", [(10, 1.0, r"boost software license v?(?:ersion)? ?{v}")]),
    ("busl", ["1 0", "1 1"], "business", [(10, 1.0, r"business source license v?(?:ersion)? ?{v}")]),
    ("sspl", ["1"], "sspl", [(20, 0.95, r"sspl ?v? ?{v}(?: 0)?")]),
    ("sspl", ["1"], "server", [(10, 1.0, r"server side public license v(?:ersion)? ?{v}")]),
    ("odbl", ["1 0"], "odbl", [(20, 0.95, r"odbl ?v? ?{v}")]),
    ("cc-by", ["1 0", "2 0", "2 5", "3 0", "4 0"], "cc", [(10, 1.0, r"cc by {v}(?: international| unported)?")]),
    ("cc-by-sa", ["1 0", "2 0", "2 5", "3 0", "4 0"], "cc", [(10, 1.0, r"cc by sa {v}(?: international| unported)?")]),
    ("cc-by-nc", ["1 0", "2 0", "2 5", "3 0", "4 0"], "cc", [(10, 1.0, r"cc by nc {v}(?: international| unported)?")]),
    ("cc-by-nd", ["1 0", "2 0", "2 5", "3 0", "4 0"], "cc", [(10, 1.0, r"cc by nd {v}(?: international| unported)?")]),
    ("cc-by-nc-sa", ["1 0", "2 0", "2 5", "3 0", "4 0"], "cc", [(10, 1.0, r"cc by nc sa {v}(?: international| unported)?")]),
    ("cc-by-nc-nd", ["1 0", "2 0", "2 5", "3 0", "4 0"], "cc", [(10, 1.0, r"cc by nc nd {v}(?: international| unported)?")]),
    ("cc-by", ["1 0", "2 0", "2 5", "3 0", "4 0"], "creative", [
        (10, 1.0, r"creative commons attribution {v}(?: international| unported)?(?: license)?")]),
    ("cc-by-sa", ["1 0", "2 0", "2 5", "3 0", "4 0"], "creative", [
        (10, 1.0, r"creative commons attribution share ?alike {v}(?: international| unported)?(?: license)?")]),
    ("cc-by-nc", ["1 0", "2 0", "2 5", "3 0", "4 0"], "creative", [
        (10, 1.0, r"creative commons attribution non ?commercial {v}(?: international| unported)?(?: license)?")]),
    ("cc-by-nc-sa", ["1 0", "2 0", "2 5", "3 0", "4 0"], "creative", [
        (10, 1.0, r"creative commons attribution non ?commercial share ?alike {v}(?: international| unported)?(?: license)?")]),
    ("cc-by-nd", ["1 0", "2 0", "2 5", "3 0", "4 0"], "creative", [
        (10, 1.0, r"creative commons attribution no ?deriv(?:ative|ative work)?s {v}(?: international| unported)?(?: license)?")]),
]
SINGLE = [
    ("mit", "mit", 10, 1.0, r"(?:released |licensed |distributed )?under (?:the )?(?:terms of the )?mit license"),
    ("mit", "mit", 30, 0.9, r"(?:the )?mit license"),
    ("mit", "mit", 30, 0.9, r"spdx license identifier mit"),
    ("permission", "mit", 5, 1.0, r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?"),
    ("permission", "isc", 5, 1.0, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "isc", 30, 0.9, r"isc license"),
    ("redistribution", "bsd", 5, 1.0, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "bsd", 40, 0.8, r"bsd licen[sc]e"),
    ("apache", "apache", 40, 0.8, r"(?:(?:released |licensed )?under (?:the )?)?apache license"),
    ("gnu", "gpl", 40, 0.8, r"(?:(?:released |licensed |distributed )?under (?:the )?(?:terms of the )?)?gnu general public license"),
    ("gnu", "gpl", 50, 0.7, r"gnu gpl"),
    ("lesser", "lgpl", 40, 0.8, r"gnu lesser general public license"),
    ("library", "lgpl", 40, 0.8, r"gnu library general public license"),
    ("affero", "agpl", 40, 0.8, r"gnu affero general public license"),
    ("documentation", "gfdl", 40, 0.8, r"gnu free documentation license"),
    ("mozilla", "mpl", 40, 0.8, r"mozilla public license"),
    ("eclipse", "epl", 40, 0.8, r"eclipse public license"),
    ("cc", "cc-by", 40, 0.8, r"(?:(?:released |licensed |available )?under (?:a |the )?)?cc by"),
    ("cc", "cc-by-sa", 30, 0.9, r"cc by sa"),
    ("cc", "cc-by-nc", 30, 0.9, r"cc by nc"),
    ("cc", "cc-by-nd", 30, 0.9, r"cc by nd"),
    ("cc", "cc-by-nc-sa", 25, 0.9, r"cc by nc sa"),
    ("cc", "cc-by-nc-nd", 25, 0.9, r"cc by nc nd"),
    ("cc", "cc0", 20, 0.95, r"cc ?0(?: 1 0)?(?: universal)?"),
    ("cc0", "cc0", 20, 0.95, r"cc0(?: 1 0)?(?: universal)?"),
    ("creative", "cc-by", 50, 0.7, r"creative commons attribution(?: license)?"),
    ("creative", "cc", 60, 0.6, r"creative commons license"),
    ("unlicense", "unlicense", 20, 0.9, r"(?:the )?unlicense(?: org)?"),
    ("public", "public-domain", 30, 0.8, r"(?:released|dedicated|placed) (?:in|in to|into|to) the public domain"),
    ("zlib", "zlib", 30, 0.9, r"zlib(?: libpng)? license"),
    ("boost", "bsl", 40, 0.8, r"boost software license"),
    ("artistic", "artistic", 40, 0.8, r"artistic license"),
    ("wtfpl", "wtfpl", 20, 0.9, r"wtfpl"),
    ("beerware", "beerware", 20, 0.9, r"beerware(?: license)?"),
    ("openssl", "openssl", 30, 0.9, r"openssl license"),
    ("postgresql", "postgresql", 30, 0.9, r"postgresql license"),
    ("sleepycat", "sleepycat", 30, 0.9, r"sleepycat license"),
    ("proprietary", "proprietary", 40, 0.7, r"proprietary and confidential"),
    ("rights", "all-rights-reserved", 70, 0.4, r"all rights reserved"),
    ("spdx", "spdx", 60, 0.6, r"spdx license identifier [0-9a-z]+"),
]

LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def rules() -> list[tuple[int, str, str, int, float, str]]:
    """(rule, keyword, label, priority, confidence, pattern); label of a version family: name and version."""
    found = []
    for name, versions, keyword, patterns in FAMILIES:
        for v in versions:
            tail = v.replace(" ", ".")
            label = f"{name}-{tail}-clause" if name == "bsd" and v.isdigit() else f"{name}-{tail}"
            found += [(keyword, label, priority, sure, pattern.replace("{v}", v)) for priority, sure, pattern in patterns]
    found += SINGLE
    return [(k, *row) for k, row in enumerate(found)]


def words(text: Column) -> Column:
    """'#' and the words, each with a space before and after it: '# w1 w2 '."""
    lower = F.translate(F.coalesce(text, F.lit("")), *LOWER)
    return F.concat(F.lit("#"), F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), BETWEEN, " "))


def scan(docs: DataFrame) -> DataFrame:
    """One row per input row: counts and places of base phrases, labels and score.

    Null or empty texts have no words, no labels and score 0. Repeated rows are judged
    one by one; an empty table gives no rows. ``score``: the greatest confidence of a
    surviving rule, at least 0.5 with a base phrase.
    """
    spark = docs.sparkSession
    norm = words(F.col("text"))
    any_base = "|".join(BASE)
    keywords = sorted({r[1] for r in rules()})
    table = F.broadcast(spark.createDataFrame(rules(), "rule int, keyword string, label string, priority int, "
                                              "confidence double, pattern string"))
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" ")))
    gate = f" (?:{'|'.join(keywords)})(?: |v?[0-9])"
    rows = (common.keyed(docs).withColumn("norm", norm)
            .select("doc_id", (spaces(F.col("norm")) - 1).cast("long").alias("n_words"),
                    F.when(F.col("norm").rlike(gate), F.col("norm")).alias("norm"),
                    F.monotonically_increasing_id().alias("row")))
    pieces = F.split("norm", f"(?= (?:{any_base}) )")
    placed = rows.withColumn("pieces", pieces).withColumn(
        "n_base", F.when(F.col("norm").isNotNull(), F.size("pieces") - 1).otherwise(0))
    first = spaces(F.element_at("pieces", 1))
    last = F.col("n_words") - (spaces(F.element_at("pieces", -1)) - 1)
    held = [F.when(F.col("norm").rlike(f" {phrase} "), F.lit(label)) for phrase, label in BASE.items()]
    based = placed.select(
        "doc_id", "n_words", F.col("n_base").cast("long").alias("n_base"),
        F.when(F.col("n_base") > 0, first).cast("long").alias("first_word"),
        F.when(F.col("n_base") > 0, last).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*held))).alias("base"), "norm", "row")
    based = common.stored(based, "license-rows")
    labels = surviving(based.where(F.col("norm").isNotNull()).select("row", "norm"), keywords, table)
    both = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return (based.drop("norm").join(labels, "row", "left")
            .select("doc_id", "n_words", "n_base", "first_word", "last_word",
                    F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
                    F.greatest(F.coalesce("sure", F.lit(0.0)), F.when(F.size("base") > 0, F.lit(0.5)).otherwise(0.0)).alias("score")))


def intervals(texts: DataFrame, keywords: list[str], table: DataFrame) -> DataFrame:
    """(row, rule, label, priority, confidence, start, end): every place where a rule matches, in characters."""
    here = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.col("norm"), F.concat(F.lit(" "), k)))
    hits = (texts.select("row", "norm", F.explode(here).alias("keyword")).join(table, "keyword")
            .where(F.expr("norm rlike concat(' ', pattern, ' ')")))
    # Each match is put between two marks; a piece then begins with a match, up to its second mark.
    pieces = hits.withColumn("pieces", F.expr(
        "split(regexp_replace(norm, concat('( ', pattern, ')(?= )'), '\u0001$1\u0002'), '\u0001')"))
    each = pieces.select("row", "rule", "label", "priority", "confidence", F.posexplode("pieces").alias("k", "piece"))
    before = Window.partitionBy("row", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return (each.withColumn("size", F.instr("piece", "\u0002") - 1)
            .withColumn("start", F.sum(F.length("piece") - F.when(F.col("size") >= 0, 1).otherwise(0)).over(before))
            .where("k > 0")
            .select("row", "rule", "label", "priority", "confidence", "start", (F.col("start") + F.col("size")).alias("end")))


def surviving(texts: DataFrame, keywords: list[str], table: DataFrame) -> DataFrame:
    """(row, found, sure): distinct labels and greatest confidence of intervals that no other contains."""
    earlier = Window.partitionBy("row").orderBy("start", F.desc("end"), "priority", "rule").rowsBetween(
        Window.unboundedPreceding, -1)
    return (intervals(texts, keywords, table)
            .withColumn("reach", F.max("end").over(earlier))
            .where("reach is null or reach < end")
            .groupBy("row").agg(F.collect_set("label").alias("found"), F.max("confidence").alias("sure")))
