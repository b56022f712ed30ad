"""Text fields of a legal corpus: token counts, prefixes, defined terms, references, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Readable names of model features.
FEATURE_LABELS = {
    "complaints_count": "311 rodent complaints this week",
    "complaints_lag_1w": "311 complaints 1 week ago",
    "complaints_lag_4w": "311 complaints 4 weeks ago",
    "complaints_lag_12w": "311 complaints 12 weeks ago",
    "rest_pest_violations_count": "Restaurant pest violations this week",
    "permits_active_count": "Active construction permits",
    "demolitions_count": "Demolition permits this week",
    "weather_tavg_c": "Average temperature (°C)",
    "weather_prcp_mm": "Weekly precipitation (mm)",
    "weather_hdd": "Heating degree days",
    "weather_cdd": "Cooling degree days",
    "units_total": "Total residential + commercial units",
    "year_built_median": "Median building year",
    "landuse_residential_pct": "Residential land use fraction",
    "landuse_commercial_pct": "Commercial land use fraction",
    "neighbor_active_rat_signs_rate_lag_1w": "Neighboring NTA infestation rate (1 wk ago)",
    "neighbor_complaints_count_lag_4w": "Neighboring NTA complaints (4 wks ago)",
    "regime_covid": "COVID-era regime",
    "regime_8pm_setout": "8 PM set-out policy active",
    "regime_commercial_containerization": "Commercial containerization active",
    "regime_residential_containerization": "Residential containerization active",
    "regime_rmz_active": "Rat Mitigation Zone active",
    "borough": "Borough",
}

#: Fixed patterns: a quoted term that is given a meaning, and references to sections, articles and titles.
DEFINED_TERM = r'(?i)"([^"]{2,60})"\s+(?:means?|shall\s+mean)\s+([^\.]{5,200})'
CROSS_REFERENCE = r"(?i)(§\s*\d+[.\-]\w+(?:\([a-z\d]+\))*|Article\s+\d+|Title\s+\d+)"
SECTION_REFERENCE = r"§\s*\d+[.\-]\d+[\w.]*(?:\([a-z\d]+\))*"


#: The wording of search queries and of prompts.
QUERY_WORDS = {
    "area": "NYC rat risk NTA ",
    "score": ": risk score ",
    "factors": ". Top risk factors: ",
    "question": ". What are the relevant health code regulations, seasonal patterns, and mitigation actions?",
}
PROMPT_WORDS = {
    "area": "NTA: ",
    "week": "Week: ",
    "score": "Current risk score: ",
    "decile": " (decile ",
    "of_ten": "/10)",
    "factors": "Top contributing factors:",
    "up": " increases",
    "down": " decreases",
    "contribution": " risk (SHAP=",
    "forecast": "12-week forecast trend (p50 risk score):",
    "last_week": "  - … → ",
    "passages": "Relevant context (from NYC policy and public health sources):",
    "task": "Please write a 2–3 sentence risk summary for this NTA that a resident or building owner would find useful.",
}


#: Any Unicode space, and the four separators that count as spaces too.
SPACES = r"(?U)[\s\x1C-\x1F]+"


def words(text: Column) -> Column:
    """What stands between spaces, no-break and ideographic ones included."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.when(text.isNotNull(), F.size(words(text)))


def token_count(text: Column, factor: float = 1.3) -> Column:
    """Words times a factor, rounded down."""
    return F.floor(word_count(text) * F.lit(factor)).cast("int")


def contextual_prefix(authority: Column, document: Column, citation: Column, text: Column) -> Column:
    return F.concat(F.lit("From "), authority, F.lit(" "), document, F.lit(" "), citation, F.lit(": "), text)


def defined_terms(text: Column) -> Column:
    """Map of lower-case term to definition; of several definitions the last holds."""
    terms = F.regexp_extract_all(text, F.lit(DEFINED_TERM), 1)
    meanings = F.regexp_extract_all(text, F.lit(DEFINED_TERM), 2)
    pairs = F.zip_with(terms, meanings, lambda t, m: F.struct(F.lower(t).alias("key"), F.trim(m).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def cross_refs(text: Column) -> Column:
    """Distinct references, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CROSS_REFERENCE), 1))


def answer_citations(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({SECTION_REFERENCE})"), 1))


def describe_factor(feature: Column, contribution: Column, labels: dict[str, str] | None = None) -> Column:
    """(feature, contribution, direction, readable)."""
    table = F.create_map(*[F.lit(x) for pair in (labels or FEATURE_LABELS).items() for x in pair])
    return F.struct(
        feature.alias("feature"),
        F.round(contribution, 6).alias("contribution"),
        F.when(contribution > 0, "up").otherwise("down").alias("direction"),
        F.coalesce(F.try_element_at(table, feature), feature).alias("readable"),
    )


def context_block(chunks: Column, limit: int = 4000) -> Column:
    """Numbered passages, each cut to ``limit`` characters, of an array of (citation, authority, content_with_prefix)."""
    parts = F.transform(
        chunks,
        lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c["citation"], F.lit(" ("), c["authority"], F.lit(")\n"), F.substring(c["content_with_prefix"], 1, limit)),
    )
    return F.array_join(parts, "\n\n")


def retrieval_query(area: Column, score: Column, factors: Column, n: int = 3) -> Column:
    """A search query for an area from its score and leading factors."""
    names = F.array_join(F.transform(F.slice(factors, 1, n), lambda f: f["readable"]), ", ")
    return F.concat(
        F.lit(QUERY_WORDS["area"]), area, F.lit(QUERY_WORDS["score"]), F.format_string("%.2f", score), F.lit(QUERY_WORDS["factors"]), names,
        F.lit(QUERY_WORDS["question"]),
    )


def summary_prompt(area: Column, week: Column, score: Column, decile: Column, factors: Column, forecast: Column, chunks: Column, n: int = 3) -> Column:
    """A prompt for a short summary: factors, the first four forecast weeks and the last, passages of 600 characters."""
    factor_lines = F.transform(
        F.slice(factors, 1, n),
        lambda f: F.concat(F.lit("  - "), f["readable"], F.when(f["direction"] == "up", PROMPT_WORDS["up"]).otherwise(PROMPT_WORDS["down"]), F.lit(PROMPT_WORDS["contribution"]), F.format_string("%+.4f", f["contribution"]), F.lit(")")),
    )
    week_line = lambda mark, r: F.concat(F.lit(mark), r["forecast_week"].cast("string"), F.lit(": "), F.format_string("%.3f", r["p50"]))
    weeks = F.concat(
        F.transform(F.slice(forecast, 1, 4), lambda r: week_line("  - ", r)),
        F.when(F.size(forecast) > 4, F.array(week_line(PROMPT_WORDS["last_week"], F.element_at(forecast, -1)))).otherwise(F.array().cast("array<string>")),
    )
    passages = F.transform(chunks, lambda c: F.concat(F.lit("\n["), c["citation"], F.lit("]\n"), F.substring(c["content"], 1, 600)))
    some = lambda cond, head, lines: F.when(cond, F.concat(F.array(F.lit(""), F.lit(head)), lines)).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        F.array(
            F.concat(F.lit(PROMPT_WORDS["area"]), area),
            F.concat(F.lit(PROMPT_WORDS["week"]), week.cast("string")),
            F.concat(F.lit(PROMPT_WORDS["score"]), F.format_string("%.3f", score), F.lit(PROMPT_WORDS["decile"]), decile.cast("string"), F.lit(PROMPT_WORDS["of_ten"])),
            F.lit(""),
            F.lit(PROMPT_WORDS["factors"]),
        ),
        factor_lines,
        some(F.size(forecast) > 0, PROMPT_WORDS["forecast"], weeks),
        some(F.size(chunks) > 0, PROMPT_WORDS["passages"], passages),
        F.array(F.lit(""), F.lit(PROMPT_WORDS["task"])),
    )
    return F.array_join(lines, "\n")
