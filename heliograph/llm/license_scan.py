"""License detection with ordered signature rules; DataFrame functions only.

A text becomes its lower-case words, each between spaces of its own, so that neighbouring matches share no character. A keyword
look gates the text; each keyword found brings the rules filed under it (a fixed table, built below from families of licenses);
each rule is a regular expression over words. A detection inside another one of the same or better priority is suppressed.

Defined results: a null text is empty; repeated rows are scanned each; extra columns are ignored; an empty table gives an
empty result. Of two equal intervals the better priority stays, then the label that sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from heliograph.llm.shared import written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Priorities: base phrases and full references first, then names with a version, then bare names.
FULL, NAMED, BARE = 1, 2, 3
CONFIDENCE = {FULL: 1.0, NAMED: 0.75, BARE: 0.5}

_GNU = (("gpl", "general public"), ("lgpl", "(lesser|library) general public"), ("agpl", "affero general public"))
_GNU_VERSIONS = {"gpl": ("1", "2", "3"), "lgpl": ("2", "2 1", "3"), "agpl": ("1", "3")}
_CC = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
_CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?derivatives", "nc": "non ?commercial"}
_VERSIONED = (
    ("apache", "apache( software)?", ("1 0", "1 1", "2 0")),
    ("mpl", "mozilla public", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse public", ("1 0", "2 0")),
    ("eupl", "european union public", ("1 0", "1 1", "1 2")),
    ("cddl", "common development and distribution", ("1 0", "1 1")),
    ("cpl", "common public", ("1 0",)),
    ("osl", "open software", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", "artistic", ("1 0", "2 0")),
    ("zpl", "zope public", ("1 1", "2 0", "2 1")),
    ("lppl", "latex project public", ("1 0", "1 2", "1 3")),
    ("ofl", "open font", ("1 0", "1 1")),
    ("ms-pl", "microsoft public", ("1 0",)),
    ("odbl", "open database", ("1 0",)),
    ("gfdl", "gnu free documentation", ("1 1", "1 2", "1 3")),
    ("boost", "boost software", ("1 0",)),
    ("upl", "universal permissive", ("1 0",)),
    ("ecl", "educational community", ("1 0", "2 0")),
    ("cecill", "cecill( free software)?", ("1 0", "2 0", "2 1")),
    ("mulan", "mulan( permissive software)?", ("1 0", "2 0")),
    ("bsl", "business source", ("1 0", "1 1")),
    ("sspl", "server side public", ("1 0",)),
)
_PLAIN = (
    ("isc", "isc license"), ("isc", "permission to use copy modify and( or)? distribute this software for any purpose with or without fee"),
    ("zlib", "zlib( libpng)? license"), ("zlib", "this software is provided as is without any express or implied warranty in no event"),
    ("unlicense", "the unlicense"), ("unlicense", "free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck you want to public license"), ("wtfpl", "wtfpl( license)?"),
    ("public-domain", "(dedicated to|released into|placed in) the public domain"), ("cc0", "cc0( 1 0)?( universal)?"), ("cc0", "creative commons zero"),
    ("psf", "(psf|python software foundation) license"), ("postgresql", "postgresql license"), ("ncsa", "(ncsa|university of illinois) open source license"),
    ("openssl", "openssl license"), ("php", "php license"), ("ruby", "ruby license"), ("vim", "vim license"), ("json", "json license"), ("json", "the software shall be used for good not evil"),
    ("x11", "x11 license"), ("curl", "curl license"), ("beerware", "(beer ?ware|beer ware) license"), ("proprietary", "all rights reserved"), ("proprietary", "proprietary license"),
    ("mit", "mit license"), ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"), ("mit", "expat license"), ("mit-0", "mit no attribution license"),
    ("bsd", "bsd license"), ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"), ("bsd-3-clause", "neither the name of"),
    ("gpl", "gnu gpl"), ("gpl", "gnu general public license"), ("lgpl", "gnu lgpl"), ("agpl", "gnu agpl"), ("cc", "creative commons license"),
)


def _rx(phrase: str) -> str:
    """A phrase as a regular expression over spaced words: ``( w)?`` is optional, ``(a|b)`` a choice, ``a ?b`` one word or two."""
    out, i, word = "", 0, ""

    def flush() -> str:
        nonlocal word
        w, word = word, ""
        return f" {w} " if w else ""

    while i < len(phrase):
        ch = phrase[i]
        if phrase[i : i + 2] == " ?":
            word += "(?:  )?"
            i += 2
            continue
        if ch in " ()|":
            out += flush()
            out += {"(": "(?:", ")": ")", "|": "|", " ": ""}[ch]
        elif ch == "?":
            out += "?"
        else:
            word += ch
        i += 1
    return out + flush()


def rules() -> list[tuple[str, int, str, str]]:
    """``(label, priority, keyword, pattern)``, best first. A keyword is a word that any match contains."""
    out: list[tuple[str, int, str, str]] = [(label, FULL, _keyword(phrase), _rx(phrase)) for phrase, label in BASE]

    def add(label: str, priority: int, phrase: str, keyword: str | None = None) -> None:
        out.append((label, priority, keyword or _keyword(phrase), _rx(phrase)))

    for short, name in _GNU:
        for v in _GNU_VERSIONS[short]:
            label = f"{short}-{v.replace(' ', '.')}"
            add(label, FULL, f"(gnu)? {name} license( as published by the free software foundation)?( either)? version {v}( 0)?", "public")
            add(f"{label}-or-later", FULL, f"(gnu)? {name} license( as published by the free software foundation)?( either)? version {v}( 0)?( of the license)? or( at your option)? any later version", "public")
            add(f"{label}-or-later", FULL, f"(gnu)? {name} license( version)? {v}( 0)? or later", "public")
            add(f"{label}-only", FULL, f"(gnu)? {name} license( version)? {v}( 0)? only", "public")
            add(label, NAMED, f"(gnu )?{short}( version| v)? {v}( 0)?".replace("(gnu )?", ""), short)
            add(label, NAMED, f"{short}v{v.split()[0]}" + "".join(f" {x}" for x in v.split()[1:]), f"{short}v{v.split()[0]}")
        add(short, BARE, f"{name} license", "public")
    for parts in _CC:
        label = "cc-" + parts.replace(" ", "-")
        long = " ".join(_CC_WORDS[p] for p in parts.split())
        for v in _CC_VERSIONS:
            add(f"{label}-{v.replace(' ', '.')}", FULL, f"cc {parts} {v}", "cc")
            add(f"{label}-{v.replace(' ', '.')}", FULL, f"creative commons {long} {v}", "commons")
            add(f"{label}-{v.replace(' ', '.')}", FULL, f"creative commons {long} {v}( international| unported| generic) license", "commons")
        add(label, NAMED, f"cc {parts}", "cc")
        add(label, NAMED, f"creative commons {long}( license)?", "commons")
    for n, name in ((0, "zero|0"), (1, "one|1"), (2, "two|2|simplified|freebsd"), (3, "three|3|new|revised|modified"), (4, "four|4|original")):
        add(f"bsd-{n}-clause", FULL, f"({name})( clause)? bsd( license)?", "bsd")
        add(f"bsd-{n}-clause", FULL, f"bsd {n} clause( license)?", "bsd")
    for short, name, versions in _VERSIONED:
        for v in versions:
            label = f"{short}-{v.replace(' ', '.')}"
            add(label, FULL, f"{name} license( version| v)? {v}", "license")
            add(label, FULL, f"{name} license version {v} or later", "license")
            if "-" not in short:
                add(label, NAMED, f"{short}( version| v| license)? {v}", short)
            if v.endswith(" 0"):
                add(label, NAMED, f"{name} license( version| v)? {v[0]}", "license")
        add(short, BARE, f"{name} license", "license")
    for label, phrase in _PLAIN:
        add(label, BARE if phrase.count(" ") < 4 else NAMED, phrase)
    return list(dict.fromkeys(out))


def _keyword(phrase: str) -> str:
    """The rarest-looking word that every form of the phrase has."""
    plain, depth = "", 0
    for ch in phrase.replace(" ?", "\x00"):
        depth += (ch == "(") - (ch == ")")
        plain += " " if ch in "()?" or depth else ch
    whole = [w for w in plain.split() if "\x00" not in w]
    return max(whole, key=lambda w: (w in ("license", "public", "software") and -1 or 0, len(w)))


RULES = rules()
KEYWORDS = sorted({k for _, _, k, _ in RULES})


def spaced(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z, each as `` word ``."""
    low = F.translate(text, UPPER, LOWER)
    return F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(low, rf"^{SEPARATORS}|{SEPARATORS}$", ""), SEPARATORS, "  "), F.lit(" "))


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as rows; a fixed, bounded table."""
    schema = T.StructType([T.StructField("rule", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("priority", T.IntegerType()), T.StructField("keyword", T.StringType()), T.StructField("pattern", T.StringType())])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], schema)


def places(text: Column, pattern: Column) -> Column:
    """``array<struct<gap,size>>``: of each match of a rule in a spaced text, the words since the last match and its own."""
    words_in = lambda x: ((F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))) / 2).cast("long")
    zipped = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, 0).alias("all")), lambda x: x["all"].isNotNull())
    return F.transform(zipped, lambda x: F.struct(words_in(x["gap"]).alias("gap"), words_in(x["all"]).alias("size")))


def scan_licenses(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """A row for each document: ``carry``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    ``score`` is the confidence of the best detection that stays: 1 for a full reference, 0.75 for a name with its version or
    a long notice, 0.5 for a bare name, 0 for none. Only texts that pass the keyword gate are rewritten as words and matched.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    apart = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    df = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), body.alias("body"))
    # other letters' lower case doesn't matter to the gate, which only decides who is looked at closely
    df = df.select("row", "body", F.array_remove(F.split(F.lower("body"), apart, -1), "").alias("tokens"))
    gate = F.arrays_overlap("tokens", F.array(*[F.lit(k) for k in KEYWORDS]))
    df = df.select("row", F.size("tokens").cast("long").alias("n_words"), F.when(gate, spaced(F.col("body"))).alias("spaced"))
    df = written(df.withColumn("row_id", F.monotonically_increasing_id()), "spaced")

    gated = df.where("spaced is not null")
    keys = F.array_distinct(F.transform(F.regexp_extract_all("spaced", F.lit(" (" + "|".join(KEYWORDS) + ") "), 1), lambda x: x))
    hits = gated.select("row_id", "spaced", F.explode(keys).alias("keyword")).join(F.broadcast(rule_table(spark)), "keyword")
    hits = hits.where(F.rlike("spaced", F.col("pattern"))).select("row_id", "rule", "label", "priority", F.posexplode(places(F.col("spaced"), F.col("pattern"))).alias("i", "p")).repartition("row_id")
    upto = Window.partitionBy("row_id", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("stop", F.sum(F.col("p.gap") + F.col("p.size")).over(upto)).withColumn("first", F.col("stop") - F.col("p.size")).drop("i", "p")
    hits = hits.withColumn("base", F.col("rule") < len(BASE))

    before = Window.partitionBy("row_id").orderBy("first", F.col("stop").desc(), "priority", "label", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lit(0).cast("long")
    for level in sorted(CONFIDENCE):
        reach = F.when(F.col("priority") == level, F.max(F.when(F.col("priority") <= level, F.col("stop"))).over(before)).otherwise(reach)
    stays = hits.withColumn("inside", F.coalesce(reach >= F.col("stop"), F.lit(False)))
    confidence = F.lit(0.0)
    for level, c in CONFIDENCE.items():
        confidence = F.when(F.col("priority") == level, F.lit(c)).otherwise(confidence)
    shown = F.col("base") | ~F.col("inside")
    per_doc = stays.groupBy("row_id").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(shown, F.col("label")))), ",").alias("labels"),
        F.max(F.when(shown, confidence)).alias("score"),
    )
    out = df.select("row_id", "row", "n_words").join(per_doc, "row_id", "left")
    return out.select(
        *[F.col("row")[c].alias(c) for c in carry],
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
