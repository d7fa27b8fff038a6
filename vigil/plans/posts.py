"""Synthetic alert posts from the events table, by one expression per column that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Sentence templates; {k} is a number, {r} a region, {s} another region. Own sentences that touch every rule.
TEMPLATES = (
    "Фиксация {k} БПЛА, {r}",
    "БПЛА над лесом.\nПовторная фиксация, {r}",
    "Множественные фиксации, пво работает, {r}",
    "До вечера от {k} БПЛА в направлении Калуги. {r}",
    "Отбой опасности по БПЛА, {r}",
    "Внимание! Возможны БПЛА, {r} и {s}",
    "Готовимся к волне БПЛА, {r}",
    "Воздушная тревога, БПЛА в вашем направлении. {r}",
    "Угроза атаки БПЛА, {r}, {s}",
    "Опасность по БПЛА сохраняется. Приграничные регионы: {r}",
    "Работа ПВО, {r}\nг. Орёл, аэропорт Брянск",
    "Сбито {k} БПЛА, {r}\nсвыше {k} сбито за ночь",
    "Меры безопасности усилены, пво готово. {r}",
    "Реактивная опасность, {r}, {k} цели",
    "Ограничения на ИВП, {r}\nСухиничский район",
    "Спасибо за донат, {r}",
    "Минобороны сообщает: {r}",
    "Внимание, спокойная ночь. {r}",
    "Опасность по БПЛА, {r}\n❗️Радар рядом\n🌐 Обход блокировок\nhttps://example.org/x",
    "Тыловые регионы: опасность БПЛА, {r}\nКалуга, Тула\n🔵 Подписаться",
    " Прифронтовых регионов касается тревога: БПЛА, {r} ",
    "   ",
    "Внимание БПЛА на Жиздринский район, {r}\r\n📲 Мы в MAX",
    "Опасность\r по БПЛА\r, {r}",
)
#: (code, name, full name): the inline region dictionary.
REGIONS = (
    ("40", "Калужская", "Калужская обл"), ("57", "Орловская", "Орловская обл"), ("31", "Белгородская", "Белгородская обл"), ("46", "Курская", "Курская обл"),
    ("02", "Башкортостан", "Респ Башкортостан"), ("22", "Алтайский", "Алтайский край"), ("04", "Алтай", "Респ Алтай"), ("71", "Тульская", "Тульская обл"),
)
MENTIONS = ("Калужская область", "в Орловской области", "БЕЛГОРОДСКАЯ ОБЛ", "Курскую область", "Республика Башкортостан", "Алтайский край", "Алтай", "тульских", "неизвестно где", "(Калужскую), Курской")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(index: str, values: tuple[str, ...]) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {_quoted(v)}" for i, v in enumerate(values)) + " END"


def columns(number: str) -> dict[str, str]:
    """Column expressions over events; number: the engine's expression for props.k."""
    text = _case(f"event_id % {len(TEMPLATES)}", TEMPLATES)
    first, second = _case(f"user_id % {len(MENTIONS)}", MENTIONS), _case(f"(user_id + 3) % {len(MENTIONS)}", MENTIONS)
    return {
        "post_id": "event_id",
        "channel_key": "concat('ch', CAST(user_id % 7 AS VARCHAR(9)))",
        "message_id": "event_id",
        "posted_at": "ts",
        "raw_text": f"replace(replace(replace({text}, '{{k}}', {number}), '{{r}}', {first}), '{{s}}', {second})",
    }


_SPARK, _DUCK = columns("get_json_object(props, '$.k')"), columns("json_extract_string(props, '$.k')")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are dealt out by id before their texts are made: patterns cost far more than reading, a file of few row groups is
    read by few tasks, and what is found in a post then meets the post without another shuffle. The number of partitions is
    given, as by their bytes they would be joined to few."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id")
    return events.selectExpr(*(f"{v} AS {k}" for k, v in _SPARK.items()))


def posts_sql() -> str:
    return "SELECT " + ", ".join(f"{v} AS {k}" for k, v in _DUCK.items()) + " FROM events"


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per channel and day, in both layouts of exports."""
    return posts(spark, sf_dir).selectExpr(*EXPORT.values()).groupBy("file").agg(_joined())


EXPORT = {
    "file": "concat(channel_key, '-', CAST(post_id % 11 AS VARCHAR(9))) AS file",
    "post_id": "post_id",
    "part": "concat(CASE WHEN post_id % 11 < 5 THEN concat('Канал ', channel_key, ', [01.02.2024 10:1', CAST(post_id % 9 AS VARCHAR(9)), ']\n') ELSE '' END, raw_text) AS part",
}


def exports_sql() -> str:
    inner = ", ".join(EXPORT.values())
    return f"SELECT file, string_agg(part, chr(10) || chr(10) ORDER BY post_id) AS text FROM (SELECT {inner} FROM ({posts_sql()})) GROUP BY file"


def _joined():
    from pyspark.sql import functions as F

    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("post_id", "part"))), lambda x: x["part"]), "\n\n").alias("text")


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, n, f, i) for i, (c, n, f) in enumerate(REGIONS)], "code string, name string, full_name string, ord int")


def regions_sql() -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({_quoted(c)}, {_quoted(n)}, {_quoted(f)}, {i})" for i, (c, n, f) in enumerate(REGIONS)) + ") t(code, name, full_name, ord)"
