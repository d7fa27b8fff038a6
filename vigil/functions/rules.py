"""Ordered rule tables and the CASE chains they compile to: the first matching rule wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import plain, rx, trim

# Patterns, labels and their order must be those of the classified posts.
NOISE = ("донат", "спасибо", r"pay\.cloudtips", "новый канал", "подписаться", "мы в max")
META = ("президент", "минобороны", "перемирие", "украин")
HINTS = ("бпла", "пво", "отбой", "фиксац", "ограничения на ивп", "тревога", "опасност", "внимани")
EVENT_RULES = (
    ("фиксаци(?:я|и).*бпла", "fixation", True),
    ("бпла.*фиксаци(?:я|и)", "fixation", True),
    (r"множественн\w*\s+фиксаци", "fixation", False),
    (r"от\s*\d+\s*бпла", "fixation", False),
    ("отбой.*(опасност|внимани).*(бпла)", "cleared", False),
    ("внимани[ея].*(бпла)", "attention", False),
    (r"приготов\w+.*волн\w+.*бпла", "mass_warning", True),
    ("волн[еа].*бпла", "mass_warning", False),
    ("тревога.*(бпла)", "mass_warning", False),
    (r"угроз[аы]\s+атак[аи].*(бпла)", "danger", False),
    ("опасност[ьи].*(бпла)", "danger", False),
    ("работа пво", "pvo_work", False),
    ("сбит(ие|о).*(бпла)", "impact", False),
    ("меры безопасности", "safety_measures", False),
    ("(ракетн|реактивн).*(опасност)", "rocket_threat", False),
    ("ограничения на ивп", "airspace_restriction", False),
)
ZONES = ((r"тылов(ые|ых)\s+регион", "rear"), (r"прифронтов(ые|ых)\s+регион", "front"), (r"приграничн(ые|ых)\s+регион", "border"))
SEVERITY = (("сбит|реактив", "critical"), ("опасност|тревог", "danger"), ("внимани", "attention"))
FOOTERS = ("^❗️Радар", r"^🌐\s*Обход", r"^🔵\s*Подписаться", r"^📲\s*Мы в MAX", "^https?://")
COUNTS = (r"от\s+(\d+)\s+бпла", r"(\d+)\s+цел(?:ь|и|ей)", r"свыше\s+(\d+)\s+сбит")
REPEATED = ("повторн", "сохраняется")
DIRECTION, YOUR_DIRECTION = r"в\s+направлении\s+([^\n.]+)", r"в\s+вашем\s+направлении"
# End of fixed values.


def any_of(low: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a text in lower case holds any of the patterns; patterns without operators are looked for as they stand."""
    words = [p.replace("\\.", ".") for p in patterns if not any(x in p.replace("\\.", "") for x in "\\^$()[]?*+|")]
    rest = [p for p in patterns if p.replace("\\.", ".") not in words]
    found = [low.contains(w) for w in words] + ([low.rlike(plain("|".join(f"(?:{p})" for p in rest)))] if rest else [])
    return reduce(lambda x, y: x | y, found)


def first_match(low: Column, rules: tuple[tuple, ...], otherwise: Column | None = None) -> Column:
    """The label of the first rule (pattern, label[, dot matches line ends]) that a text in lower case matches."""
    chain = reduce(lambda w, r: w.when(low.rlike(plain(r[0], len(r) > 2 and r[2])), r[1]), rules, F.when(F.lit(False), F.lit(None).cast("string")))
    return chain.otherwise(F.lit(None) if otherwise is None else otherwise)


def _kind(trimmed: Column, low: Column) -> Column:
    return F.when(trimmed == "", "noise").when(any_of(low, NOISE), "noise").when(any_of(low, META), "meta").when(any_of(low, HINTS), "event").otherwise("noise")


def content_kind(text: Column) -> Column:
    return _kind(trim(text), F.lower(text))


def event_type(text: Column) -> Column:
    return first_match(F.lower(text), EVENT_RULES)


def severity(text: Column, kind: Column) -> Column:
    return F.when(kind == "cleared", "info").otherwise(first_match(F.lower(text), SEVERITY, F.lit("info")))


def macro_zone(text: Column) -> Column:
    return first_match(F.lower(text), ZONES)


def repeat_flag(text: Column) -> Column:
    return any_of(F.lower(text), REPEATED)


def count_of(text: Column) -> Column:
    """The first positive number of the ordered patterns, each at its first place only."""
    low = F.lower(text)
    found = [F.try_to_number(F.nullif(F.regexp_extract(low, plain(p), 1), F.lit("")), F.lit("9" * 18)).cast("long") for p in COUNTS]
    return F.coalesce(*(F.when(n > 0, n) for n in found))


def direction(text: Column) -> Column:
    named = F.regexp_extract(text, rx(DIRECTION), 1)
    return F.when(named != "", trim(named)).when(text.rlike(rx(YOUR_DIRECTION)), "в вашем направлении")


def strip_footer(text: Column) -> Column:
    """Trimmed lines that are neither empty nor a footer; carriage returns go wherever they stand."""
    lines = F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), trim)
    footer = rx("|".join(f"(?:{p})" for p in FOOTERS))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(footer)), "\n")


def classify(posts: DataFrame, text: str) -> DataFrame:
    """posts with kind, reason, event_type, severity, repeat, n, direction, macro_zone of each post.

    Body and lower case are columns, computed once; the type rules run on posts that hint at an event only, and what
    describes an event on events only. The result comes out of an array of one row, so that a filter on it stays above: below
    the columns it would compute the body anew for each of its patterns.
    """
    names = [F.col(f"`{c}`") for c in posts.columns]
    body, low, type_ = F.col("_body"), F.col("_low"), F.col("_type")
    rows = posts.select("*", strip_footer(F.col(text)).alias("_body"))
    rows = rows.select("*", F.lower("_body").alias("_low")).select("*", _kind(trim(body), low).alias("_kind"))
    rows = rows.select("*", F.when(F.col("_kind") == "event", first_match(low, EVENT_RULES)).alias("_type"))
    only = lambda c: F.when(type_.isNotNull(), c)
    kind = F.col("_kind")
    found = F.struct(
        F.when(type_.isNotNull(), "event").when(kind == "event", "noise").otherwise(kind).alias("kind"),
        F.when(kind == "meta", "meta_content").when(kind == "noise", "noise_content").when(type_.isNull(), "event_type_not_detected").alias("reason"),
        type_.alias("event_type"), only(F.when(type_ == "cleared", "info").otherwise(first_match(low, SEVERITY, F.lit("info")))).alias("severity"),
        only(any_of(low, REPEATED)).alias("repeat"), only(count_of(body)).alias("n"), only(direction(body)).alias("direction"), only(first_match(low, ZONES)).alias("macro_zone"),
    )
    return rows.select(*names, F.inline(F.array(found)))
