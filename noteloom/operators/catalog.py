"""The catalogue of models: (name, capabilities), capabilities null where they are unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The capability that each purpose needs.
NEEDS = {"generation": "completion", "embedding": "embedding"}


def models_for(catalog: DataFrame, purpose: str) -> DataFrame:
    """(name, capabilities, place): models that serve the purpose, then those of unknown capabilities.

    If none is left, generation may use all models; embedding none. place orders by name within both kinds,
    without regard to case and with numbers by value. Of models with one name one row stays.
    """
    models = catalog.dropDuplicates(["name"])
    fits = F.coalesce(F.array_contains("capabilities", NEEDS[purpose]), F.lit(True))
    if purpose == "generation":
        some = models.agg(F.coalesce(F.bool_or(fits), F.lit(False)).alias("some"))
        models = models.crossJoin(F.broadcast(some)).filter(fits | ~F.col("some")).drop("some")  # one row
    else:
        models = models.filter(fits)
    # Digits to a fixed width, so that strings compare as numbers.
    pieces = F.transform(F.regexp_extract_all(F.lower("name"), F.lit(r"(\d+|\D+)"), F.lit(1)), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x))
    order = F.array_sort(F.collect_list(F.struct(F.col("capabilities").isNull().alias("unknown"), F.array_join(pieces, "").alias("key"), "name", "capabilities")))
    return models.agg(order.alias("m")).select(F.posexplode("m").alias("place", "m")).select("m.name", "m.capabilities", "place")
