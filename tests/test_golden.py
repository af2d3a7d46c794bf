"""Published results that can be recomputed from published rows."""

import pytest
from pyspark.sql import functions as F

from scriptoria.operators import evaluation, pairs

# Labels given by hand and labels predicted, of 39 published rows in their order.
ROWS = [
    ("ideology", "humanism ideology intelectual circunstance history philosophy paradoxa decay"),
    ("ideology intelectual", "ideology intelectual philosophy theory paradoxa"),
    ("langpower circunstance", "circunstance intelectual sitio langpower ideology"),
    ("ideology", "ideology langpower paradoxa irony"),
    ("intelectual theory", "ideology intelectual circunstance polcult sitio theory history paradoxa"),
    ("langpower polcult", "polcult langpower paradoxa psychoanalysis resistance"),
    ("langpower", "langpower history reading writing paradoxa rethoric resistance"),
    ("langpower", "ideology langpower representacionalism rethoric"),
    ("polcult error", "intelectual langpower error literature reading treason paradoxa resistance truth"),
    ("polcult langpower intelectual", "ideology intelectual polcult langpower literature paradoxa literary_genre representacionalism truth"),
    ("langpower history", "langpower history paradoxa truth ideology"),
    ("langpower", "langpower polcult ideology paradoxa truth intelectual resistance"),
    ("langpower", "suplemento langpower psychoanalysis paradoxa irony transgression"),
    ("sitio polcult history", "sitio literature circunstance polcult transgression treason resistance paradoxa representacionalism literary_genre"),
    ("sitio intelectual", "intelectual sitio psychoanalysis paradoxa essay"),
    ("intelectual humanism", "intelectual ideology humanism polcult circunstance psychoanalysis paradoxa theory"),
    ("intelectual sitio", "intelectual circunstance sitio psychoanalysis writing transgression treason paradoxa"),
    ("langpower sitio", "sitio error langpower writing paradoxa structuralism literature resistance"),
    ("psychoanalysis", "psychoanalysis paradoxa literature"),
    ("circunstance", "circunstance truth intelectual"),
    ("error writing langpower", "writing literature error transgression blanchot paradoxa psychoanalysis treason resistance"),
    ("writing treason", "literature writing langpower treason transgression resistance"),
    ("langpower", "langpower writing literature representacionalism paradoxa resistance"),
    ("nietzsche langpower", "literature writing langpower rethoric representacionalism resistance nietzsche truth paradoxa"),
    ("literature", "literature sitio langpower resistance paradoxa writing"),
    ("literature error langpower structuralism transgression treason", "langpower literature writing transgression treason paradoxa resistance psychoanalysis blanchot structuralism"),
    ("literature circunstance paradoxa", "ideology literature paradoxa langpower polcult intelectual resistance writing"),
    ("literary_genre", "history rethoric literary_genre literature"),
    ("history literature", "history suplemento sitio ideology representacionalism irony"),
    ("reading", "ideology literature reading representacionalism rethoric resistance truth"),
    ("representacionalism literary_genre error", "ideology polcult history literature literary_genre representacionalism rethoric"),
    ("literary_genre", "literary_genre history ideology representacionalism rethoric irony"),
    ("rethoric structuralism", "history langpower literature rethoric structuralism theory"),
    ("writing", "literary_genre essay writing rethoric representacionalism truth"),
    ("writing", "literature literary_genre representacionalism rethoric ideology truth"),
    ("writing literature blanchot resistance", "literature resistance writing blanchot paradoxa representacionalism"),
    ("literature", "literature ideology resistance history new"),
    ("literature", "literature sitio polcult history langpower writing paradoxa resistance"),
    ("sitio", "langpower literature psychoanalysis writing blanchot paradoxa rethoric resistance"),
]
# What was published of them.
MICRO = (62, 194, 9, 0.242, 0.873, 0.379)
MEANS = (6.56, 1.82)
CLOSED = (157, 584, 0.3847)


@pytest.fixture(scope="module")
def published(spark):
    return spark.createDataFrame([(k, g.split(), p.split(), [1.0, 0.0]) for k, (g, p) in enumerate(ROWS)], "id long, gold array<string>, predicted array<string>, vec array<double>").cache()


def test_micro_scores(published):
    got = evaluation.micro(evaluation.matches(published, F.col("gold"), F.col("predicted"))).first()
    assert tuple(got) == MICRO
    means = published.agg(F.round(F.avg(F.size("predicted")), 2), F.round(F.avg(F.size("gold")), 2)).first()
    assert tuple(means) == MEANS


def test_recovery_of_labels(published):
    rows = published.withColumnsRenamed({"predicted": "closed", "gold": "labels"}).withColumn("open", F.array().cast("array<string>"))
    got = {r["layer"]: r for r in evaluation.recovery(pairs.label_counts(rows, "id", "labels")).collect()}["C-closed"]
    assert (got["n_x"], got["n_y"], round(got["delta"], 4)) == CLOSED
