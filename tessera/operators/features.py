"""Prose features and findings of documents: no shuffle, one row in, one row out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.lexicons import PROFILE_NAMES, PROFILE_VALUES, RUSSIAN, Pack
from tessera.functions.measures import measured
from tessera.plans.session import checked_broadcast

FAMILIES = ("road", "hype", "jargon", "nominal", "bureau", "pivots", "fillers")
#: Feature of each family's rate.
RATES = {"road": "road_per_1000", "hype": "hype_per_1000", "jargon": "jargon_per_1000", "nominal": "nominal_per_1000", "bureau": "bureau_per_1000", "pivots": "pivot_per_1000", "fillers": "filler_per_1000"}
METRICS = ("words", "sentences", "paragraphs", "sentence_mean_words", "sentence_cv", "sentence_p90_words", "sentence_p95_words", "sentence_max_words", "one_sentence_paragraph_ratio", "dash_per_1000", "colon_per_1000", *RATES.values(), "ellipsis_per_1000")
DASH = r"—|(?<=\s)–(?=\s)"
COLON = r"(?<!\d):|:(?!\d)"
ELLIPSIS = r"\.\.\.|…"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row, however often later expressions read them."""
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode(F.array(packed)).alias("__once")).select("*", "__once.*").drop("__once")


def patterns(pack: Pack, family: str) -> list[str]:
    own = getattr(pack, family)
    return [T.literal(p) for p in own] if family in pack.phrase_families else list(own)


def profiles(spark: SparkSession) -> DataFrame:
    """The built-in profile table, one row for each profile."""
    names = list(PROFILE_VALUES)
    return spark.createDataFrame([(p, *[PROFILE_VALUES[n][i] for n in names]) for i, p in enumerate(PROFILE_NAMES)], ["profile", *names])


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """A profile table from a JSON object of profiles, each an object of settings; what one leaves out is as in the first built-in profile."""
    said = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("profile", "given"))
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
    of = lambda name, values: F.coalesce(F.col("given")[name].cast(kinds[type(values[0])]), F.lit(values[0])).alias(name)
    return said.select("profile", *[of(name, values) for name, values in PROFILE_VALUES.items()])


def _measured(docs: DataFrame, pack: Pack, text: str, include_quotes: bool, most: dict[str, int] | None = None) -> DataFrame:
    """Adds ``style``, ``n_<family>``, ``mean`` and ``__m``, what ``measures.measured`` has; phrases are read there, patterns here."""
    phrases = {f: tuple(getattr(pack, f)) for f in FAMILIES if f in pack.phrase_families}
    df = docs.withColumn("__m", measured(F.col(text), phrases, most, include_quotes))
    n = F.size("__m.lengths")
    mean = F.when(n > 0, F.aggregate("__m.lengths", F.lit(0).cast("long"), lambda a, x: a + x) / n).otherwise(0.0)
    df = once(df, style=F.coalesce("__m.style", F.col(text), F.lit("")), mean=mean)
    counts = {f: F.col(f"__m.n_{f}") if f in phrases else _pattern_count(F.col("style"), pack, f) for f in FAMILIES}
    return once(df, **{f"n_{f}": c for f, c in counts.items()})


def compute_features(docs: DataFrame, pack: Pack = RUSSIAN, text: str = "text", include_quotes: bool = False) -> DataFrame:
    """Adds the features of ``METRICS``, ``n_<family>`` counts, ``n_dashes, n_colons, n_ellipses`` and the masked ``style`` text.

    A null text counts as empty.  Rates and ratios are rounded to four places, half to even.
    """
    df = _measured(docs, pack, text, include_quotes)
    return df.select(*docs.columns, *_features())


def _features() -> list[Column]:
    """The columns of ``compute_features`` over ``_measured`` rows."""
    n, paras = F.size("__m.lengths"), F.col("__m.paragraphs")
    spread = F.sqrt(F.aggregate("__m.lengths", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / n)
    words = F.col("__m.words")
    return [
        F.col("style"), words.alias("words"), n.cast("long").alias("sentences"), paras.alias("paragraphs"),
        F.bround("mean", 4).alias("sentence_mean_words"),
        F.bround(F.when((n > 0) & (F.col("mean") > 0), spread / F.col("mean")).otherwise(0.0), 4).alias("sentence_cv"),
        F.bround(T.percentile_of(F.col("__m.lengths"), 0.90), 4).alias("sentence_p90_words"),
        F.bround(T.percentile_of(F.col("__m.lengths"), 0.95), 4).alias("sentence_p95_words"),
        F.coalesce(F.array_max("__m.lengths"), F.lit(0)).cast("long").alias("sentence_max_words"),
        F.bround(F.when(paras > 0, F.col("__m.single") / paras).otherwise(0.0), 4).alias("one_sentence_paragraph_ratio"),
        T.per_thousand(F.col("__m.dashes"), words).alias("dash_per_1000"), T.per_thousand(F.col("__m.colons"), words).alias("colon_per_1000"),
        *[T.per_thousand(F.col(f"n_{f}"), words).alias(r) for f, r in RATES.items()],
        T.per_thousand(F.col("__m.ellipses"), words).alias("ellipsis_per_1000"),
        *[F.col(f"n_{f}") for f in FAMILIES], F.col("__m.dashes").alias("n_dashes"), F.col("__m.colons").alias("n_colons"), F.col("__m.ellipses").alias("n_ellipses"),
    ]


def _pattern_count(style: Column, pack: Pack, family: str) -> Column:
    total = F.lit(0).cast("long")
    for p in patterns(pack, family):
        total = total + T.count(style, p, T.UI)
    return total


#: What the rules say; ``{}`` is filled with a number.
MESSAGES = {
    "nominalization": "An action may be hidden in a noun or a passive; check whether the register needs it.",
    "bureaucratic-density": "Office connectives are dense for this profile; that alone is no mistake.",
    "rhetorical-pivot": "A rhetorical turn repeats; keep it where there is a real contrast.",
    "road-sign-density": "Signposts carry the text; check whether things and actions could link it.",
    "hype-density": "Promotional words repeat; check what each says here.",
    "context-jargon-density": "Abstract professional words are dense; check for actors, actions and results.",
    "dash-density": "Dashes are frequent; the sign is right, its monotony may not be.",
    "colon-density": "Colons are frequent; the sign is right, its monotony may not be.",
    "sentence-uniformity": "Sentences are of rather even length; the threshold is the profile's and no norm.",
    "long-sentence": "A sentence is long for the profile; check its order before shortening it.",
    "one-sentence-paragraphs": "Many paragraphs have one sentence; check whether the genre asks for it.",
    "filler-density": "Spoken particles are frequent; check whether they do anything.",
}


#: Places of each family that findings name: all (0), or the first few.
PLACES = {"nominal": 0, "bureau": 8, "pivots": 8, "road": 10, "hype": 5, "jargon": 1, "fillers": 1}


def _judged(docs: DataFrame, profile_table: DataFrame, pack: Pack, mode: str, most: dict[str, int] | None = None, how: str = "inner") -> DataFrame:
    """Features of documents next to the settings of their profiles."""
    measured_docs = _measured(docs, pack, "text", False, most)
    df = measured_docs.select(*docs.columns, "__m", *_features())
    return df.join(checked_broadcast(profile_table.withColumnRenamed("profile", "__profile")), F.col(mode) == F.col("__profile"), how)


def _speaks(mode: str) -> dict[str, Column]:
    """When each rule speaks."""
    c = F.col
    enough = c("words") >= c("punctuation_min_words")
    return {
        "nominal": c("n_nominal") > 0,
        "bureau": (c("n_bureau") >= c("min_bureau_hits")) & (c("bureau_per_1000") >= c("bureau_per_1000_warn")),
        "pivots": (c("n_pivots") >= c("min_pivot_hits")) & (c("pivot_per_1000") >= c("pivot_per_1000_warn")),
        "road": (c("n_road") >= c("min_road_hits")) & (c("road_per_1000") >= c("road_per_1000_warn")),
        "hype": (c("hype_level") != "off") & (c("n_hype") >= c("min_hype_hits")) & (c("hype_per_1000") >= c("hype_per_1000_emit")),
        "jargon": (c("n_jargon") >= c("min_jargon_hits")) & (c("jargon_per_1000") >= c("jargon_per_1000_info")),
        "fillers": (c(mode) == "oral") & (c("n_fillers") >= c("min_filler_hits")) & (c("filler_per_1000") >= c("filler_per_1000_info")),
        "dash": (c("dash_level") != "off") & enough & (c("n_dashes") > 0) & (c("dash_per_1000") >= c("dash_per_1000_info")),
        "colon": (c("colon_level") != "off") & enough & (c("n_colons") > 0) & (c("colon_per_1000") >= c("colon_per_1000_info")),
        "cv": c("rhythm_checks") & (c("sentences") >= c("min_sentences_for_cv")) & (c("sentence_cv") < c("sentence_cv_min_info")),
        "long": c("sentence_max_words") >= c("long_sentence_words_info"),
        "para": c("rhythm_checks") & (c("paragraphs") >= c("min_paragraphs_for_ratio")) & (c("one_sentence_paragraph_ratio") >= c("one_sentence_paragraph_ratio_info")),
    }


def finding_counts(docs: DataFrame, profile_table: DataFrame, pack: Pack = RUSSIAN, mode: str = "mode") -> DataFrame:
    """The columns of ``docs``, ``words`` and ``found``: ``array<struct<code, level, n>>``, how many rows ``prose_findings`` has of each.

    Counts alone, so no place is looked up; documents without findings or
    without a profile in the table stay, with an empty array.
    """
    df, speaks, c = _judged(docs, profile_table, pack, mode, how="left"), _speaks(mode), F.col
    info, warning, one = F.lit("info"), F.lit("warning"), F.lit(1)
    first = lambda family: F.least(c(f"n_{family}"), F.lit(PLACES[family])) if PLACES[family] else c(f"n_{family}")
    long = F.size(F.filter("__m.lengths", lambda n: n >= c("long_sentence_words_info")))
    rules = (
        ("nominal", "nominalization", c("nominalization_level"), first("nominal")), ("bureau", "bureaucratic-density", warning, first("bureau")),
        ("pivots", "rhetorical-pivot", warning, first("pivots")), ("road", "road-sign-density", warning, first("road")),
        ("hype", "hype-density", c("hype_level"), one), ("jargon", "context-jargon-density", info, one),
        ("dash", "dash-density", c("dash_level"), one), ("colon", "colon-density", c("colon_level"), one),
        ("cv", "sentence-uniformity", info, one), ("long", "long-sentence", info, long),
        ("para", "one-sentence-paragraphs", info, one), ("fillers", "filler-density", info, one),
    )
    rows = [F.when(c("__profile").isNotNull() & speaks[k], F.struct(F.lit(code).alias("code"), level.alias("level"), n.cast("long").alias("n"))) for k, code, level, n in rules]
    return df.select(*docs.columns, "words", F.filter(F.array_compact(F.array(*rows)), lambda x: x["n"] > 0).alias("found"))


def prose_findings(docs: DataFrame, profile_table: DataFrame, pack: Pack = RUSSIAN, mode: str = "mode") -> DataFrame:
    """One row for each finding: the columns of ``docs``, then ``level, code, line, message, excerpt``.

    ``mode`` names the column that holds a document's profile; profiles without a row in
    the table give no findings.
    """
    df = _judged(docs, profile_table, pack, mode, PLACES)
    style, speaks = F.col("style"), _speaks(mode)
    c, info, warning, empty = F.col, F.lit("info"), F.lit("warning"), F.lit("")
    # places are looked up only where a rule speaks
    place, matched = lambda x: F.shiftright(x, 32).cast("int"), lambda x: F.substring(style, F.shiftright(x, 32).cast("int") + 1, x.bitwiseAND(F.lit(2**32 - 1)).cast("int"))
    packed = lambda at: F.transform(at, lambda x: F.struct(place(x).alias("pos"), matched(x).alias("matched")))
    places = {f: packed(F.col(f"__m.at_{f}")) if f in pack.phrase_families else T.family_hits(style, patterns(pack, f)) for f in FAMILIES} | {"dash": T.hits(style, DASH), "colon": T.hits(style, COLON)}
    no_hits = F.array().cast("array<struct<pos:int,matched:string>>")
    spans = F.filter(F.arrays_zip("__m.spans", "__m.lengths"), lambda s: s["lengths"] >= c("long_sentence_words_info"))
    long = F.transform(spans, lambda s: F.struct(place(s["spans"]).alias("pos"), F.translate(matched(s["spans"]), T.DOT, ".").alias("matched"), s["lengths"].alias("n")))
    df = once(
        df, **{f"h_{f}": F.when(speaks[f], h).otherwise(no_hits) for f, h in places.items()},
        h_long=F.when(speaks["long"], long).otherwise(F.array().cast("array<struct<pos:int,matched:string,n:bigint>>")),
        h_para=F.when(speaks["para"] & (c("__m.first") >= 0), c("__m.first").cast("int")),
    )
    none = F.array().cast("array<struct<level:string,code:string,pos:int,sample:string>>")
    row = lambda level, code, pos, sample: F.struct(level.alias("level"), F.lit(code).alias("code"), pos.cast("int").alias("pos"), sample.cast("string").alias("sample"))
    each = lambda found, level, code, most: F.transform(F.slice(found, 1, most) if most else found, lambda h: row(level, code, h["pos"], h["matched"]))
    alone = lambda condition, level, code, pos, sample: F.when(condition, F.array(row(level, code, pos, sample))).otherwise(none)
    examples = F.array_join(F.array_distinct(F.transform(F.slice("h_hype", 1, 5), lambda h: h["matched"])), ", ")
    first = lambda name: F.coalesce(F.get(name, F.lit(0))["pos"], F.lit(0))
    rules = F.concat(
        each(c("h_nominal"), c("nominalization_level"), "nominalization", 0),
        each(c("h_bureau"), warning, "bureaucratic-density", 8),
        each(c("h_pivots"), warning, "rhetorical-pivot", 8),
        each(c("h_road"), warning, "road-sign-density", 10),
        alone(speaks["hype"], c("hype_level"), "hype-density", first("h_hype"), examples),
        alone(speaks["jargon"], info, "context-jargon-density", first("h_jargon"), empty),
        alone(speaks["dash"], c("dash_level"), "dash-density", first("h_dash"), empty),
        alone(speaks["colon"], c("colon_level"), "colon-density", first("h_colon"), empty),
        alone(speaks["cv"], info, "sentence-uniformity", F.lit(0), empty),
        each(c("h_long"), info, "long-sentence", 0),
        alone(speaks["para"], info, "one-sentence-paragraphs", F.coalesce("h_para", F.lit(0)), empty),
        alone(speaks["fillers"], info, "filler-density", first("h_fillers"), empty),
    )
    found = df.withColumn("f", F.explode(rules))
    said = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    text = F.coalesce(F.col("text"), F.lit(""))
    return found.select(*docs.columns, F.col("f.level").alias("level"), F.col("f.code").alias("code"), T.line_of(text, F.col("f.pos")).alias("line"), said[F.col("f.code")].alias("message"), T.excerpt(F.col("f.sample")).alias("excerpt"))
