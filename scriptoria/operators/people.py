"""Cited people: demographic buckets and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Half-open year ranges and their names, in order.
PERIODS = [
    (-800, -500, "Antiquity (Archaic)"), (-500, -300, "Classical Antiquity"), (-300, 500, "Hellenistic/Roman"), (500, 1400, "Medieval"),
    (1400, 1600, "Renaissance"), (1600, 1789, "Early Modern"), (1789, 1848, "Revolutionary Era"), (1848, 1914, "Long 19th Century"),
    (1914, 1945, "World Wars Era"), (1945, 2000, "Contemporary"),
]
# Country names as written, lower case, and as reported.
COUNTRIES = {
    "argentina": "Argentina", "france": "France", "francia": "France", "germany": "Germany", "alemania": "Germany", "prusia": "Germany", "austria": "Austria",
    "england": "United Kingdom", "inglaterra": "United Kingdom", "reino unido": "United Kingdom", "ireland": "Ireland", "irlanda": "Ireland", "italy": "Italy",
    "italia": "Italy", "spain": "Spain", "espania": "Spain", "españa": "Spain", "usa": "United States", "estados unidos": "United States", "russia": "Russia",
    "rusia": "Russia", "poland": "Poland", "polonia": "Poland", "greece": "Greece", "grecia": "Greece", "switzerland": "Switzerland", "suiza": "Switzerland",
    "czech": "Czech Republic", "praga": "Czech Republic", "cuba": "Cuba", "mexico": "Mexico", "méxico": "Mexico", "uruguay": "Uruguay", "chile": "Chile",
    "brasil": "Brazil", "brazil": "Brazil", "venezuela": "Venezuela", "peru": "Peru", "perú": "Peru", "colombia": "Colombia", "japan": "Japan", "japón": "Japan",
    "china": "China", "israel": "Israel", "netherlands": "Netherlands", "países bajos": "Netherlands", "belgium": "Belgium", "bélgica": "Belgium",
    "portugal": "Portugal", "hungary": "Hungary", "hungría": "Hungary", "romania": "Romania", "rumanía": "Romania", "denmark": "Denmark", "dinamarca": "Denmark",
    "sweden": "Sweden", "suecia": "Sweden", "norway": "Norway", "noruega": "Norway",
}
# The region of each country; any other is Other/Unknown.
REGIONS = {
    "Argentina": "Latin America", "Mexico": "Latin America", "Cuba": "Latin America", "Uruguay": "Latin America", "Chile": "Latin America", "Brazil": "Latin America",
    "Venezuela": "Latin America", "Peru": "Latin America", "Colombia": "Latin America", "France": "Western Europe", "Germany": "Western Europe",
    "United Kingdom": "Western Europe", "Italy": "Western Europe", "Spain": "Western Europe", "Austria": "Western Europe", "Switzerland": "Western Europe",
    "Netherlands": "Western Europe", "Belgium": "Western Europe", "Ireland": "Western Europe", "Portugal": "Western Europe", "Greece": "Southern Europe / Classical",
    "United States": "North America", "Russia": "Eastern Europe", "Poland": "Eastern Europe", "Czech Republic": "Eastern Europe", "Hungary": "Eastern Europe",
    "Romania": "Eastern Europe", "Israel": "Middle East", "Japan": "Asia", "China": "Asia", "Denmark": "Scandinavia", "Sweden": "Scandinavia", "Norway": "Scandinavia",
}


def period(year: Column) -> Column:
    """The period of a year, lower bound included; Unknown outside all, or of a null year."""
    out = F
    for lo, hi, name in PERIODS:
        out = out.when((year >= lo) & (year < hi), name)
    return out.otherwise("Unknown")


def country(raw: Column) -> Column:
    """A country as reported; a name that isn't in the list stays as it is."""
    known = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(raw))), F.trim(raw))


def region(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in REGIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, name), F.lit("Other/Unknown"))


def prosopography(persons: DataFrame, places: DataFrame) -> DataFrame:
    """Persons with years, country, region and period, from (id, name, birth, death, place, wikidata) and (id, country) of places."""
    from scriptoria.functions.text import year

    p = persons.join(places.select(F.col("id").alias("place"), F.col("country").alias("raw")), "place", "left")
    p = p.withColumns({"birth_year": year(F.col("birth")), "death_year": year(F.col("death")), "country": country(F.col("raw"))})
    return p.select("id", "name", "birth_year", "death_year", "country", region(F.col("country")).alias("region"), period(F.col("birth_year")).alias("period"), "wikidata")


def bucketed(cited: DataFrame, people: DataFrame, key: str, person: str, bucket: str) -> DataFrame:
    """(key, bucket): a row is in a bucket if any person it cites is; a null bucket is none. `people` is keyed by id."""
    b = people.select(F.col("id").alias(person), F.col(bucket).alias("bucket")).filter("bucket IS NOT NULL")
    return cited.join(b, person).select(key, "bucket").distinct()


def profile(cited: DataFrame, people: DataFrame, key: str, person: str, home: str) -> DataFrame:
    """(dim, bucket, n_figures, n_rows): different persons cited and rows that cite them, by period, region and origin.

    Origin is home, Foreign, or Unknown origin. One pass over the citations; a row counts once per bucket.
    """
    origin = F.when(F.col("country").isNull(), "Unknown origin").when(F.col("country") == home, home).otherwise("Foreign")
    dims = F.array(*[F.struct(F.lit(d).alias("dim"), c.alias("bucket")) for d, c in (("period", F.col("period")), ("region", F.col("region")), ("origin", origin))])
    all_ = cited.join(people.withColumnRenamed("id", person), person).select(key, person, F.explode(dims).alias("d")).select("d.dim", "d.bucket", key, person).filter("bucket IS NOT NULL")
    rows = all_.select("dim", "bucket", key).distinct().groupBy("dim", "bucket").agg(F.count("*").alias("n_rows"))
    figures = all_.select("dim", "bucket", person).distinct().groupBy("dim", "bucket").agg(F.count("*").alias("n_figures"))
    return figures.join(rows, ["dim", "bucket"]).select("dim", "bucket", "n_figures", "n_rows")
