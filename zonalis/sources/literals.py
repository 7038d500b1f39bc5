"""Small tables of known values: regions, their totals and their larger towns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Name -> (longitude, latitude, population); the first town is the region's centre.
TOWNS: dict[str, dict[str, tuple[float, float, int]]] = {
    "moscow": {
        "Москва": (37.6173, 55.7558, 12655050),
        "Балашиха": (37.9384, 55.7964, 507366),
        "Подольск": (37.5447, 55.4297, 308130),
        "Химки": (37.4448, 55.8970, 259550),
        "Мытищи": (37.7295, 55.9117, 235504),
        "Люберцы": (37.9534, 55.6760, 205769),
        "Электросталь": (38.4445, 55.7847, 156261),
        "Коломна": (38.7544, 55.0794, 140129),
        "Серпухов": (37.4216, 54.9156, 125817),
    },
    "krasnodar": {
        "Краснодар": (38.9753, 45.0355, 948827),
        "Сочи": (39.7233, 43.5853, 466078),
        "Новороссийск": (37.7615, 44.7239, 275795),
        "Армавир": (41.1289, 44.9892, 186725),
        "Анапа": (37.3158, 44.8946, 92047),
        "Ейск": (38.2766, 46.7104, 82888),
        "Геленджик": (38.0699, 44.5622, 75730),
        "Туапсе": (39.0779, 44.0974, 62269),
        "Тихорецк": (40.1283, 45.8536, 56474),
    },
    "yakutia": {
        "Якутск": (129.7322, 62.0355, 355443),
        "Нерюнгри": (124.7283, 56.6589, 57009),
        "Мирный": (113.9881, 62.5350, 35311),
        "Алдан": (125.3914, 58.6017, 20131),
        "Вилюйск": (121.6450, 63.7475, 11095),
        "Покровск": (129.1486, 61.4856, 9620),
    },
}
# Region -> indicator -> (unit, total).
TOTALS: dict[str, dict[str, tuple[str, float]]] = {
    "moscow": {"shipping": ("bn RUB", 209.0), "agriculture": ("mn RUB", 85692.0)},
    "krasnodar": {"shipping": ("bn RUB", 59.7), "agriculture": ("mn RUB", 186744.8)},
    "yakutia": {"shipping": ("bn RUB", 11.2), "agriculture": ("mn RUB", 25431.3)},
}
# The two indicators' codes.
CODES = {"shipping": "Y477090007", "agriculture": "Y477120029"}
#: Other keys that regions go by.
ALIASES = {"mo": "moscow", "kk": "krasnodar", "ya": "yakutia"}


def towns(spark: SparkSession, region: str | None = None) -> DataFrame:
    """(region, place_id, name, lon, lat, population)."""
    rows = [(r, k, name, *v[:2], float(v[2])) for r, t in TOWNS.items() if region in (None, r) or ALIASES.get(region) == r for k, (name, v) in enumerate(t.items())]
    return spark.createDataFrame(rows, "region string, place_id int, name string, lon double, lat double, population double")


def totals(spark: SparkSession, indicator: str = "shipping") -> DataFrame:
    """(region, indicator, unit, x_total)."""
    return spark.createDataFrame([(r, indicator, *t[indicator]) for r, t in TOTALS.items()], "region string, indicator string, unit string, x_total double")
