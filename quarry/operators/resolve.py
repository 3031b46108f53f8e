"""Dataset entity resolution: candidate pairs, cheap tests before the judge, components, aliases.

The order of candidates plays no part: a pair is the same if it isn't known to be different and its normalised
titles agree (after aliases) or the judge says so.  Aliases lead from titles to the component's least id, so they
can't form a cycle; pairs the judge calls different are remembered, pairs it can't tell are not.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quarry.functions.scalars import normalize_title
from quarry.operators.components import connected_components
from quarry.operators.knn import topk_join, unordered
from quarry.operators.services import same_words_judge
from quarry.storage import materialise

_DETAILS = ("title", "description", "link")


def candidates(vectors: DataFrame, k: int = 10, at_least: float = 0.7) -> DataFrame:
    """``lo, hi, sim``: datasets among each other's k nearest, itself included, at that similarity or more."""
    return unordered(topk_join(vectors, vectors, k), at_least)


def resolve(pairs: DataFrame, datasets: DataFrame, judge: Callable[[dict, dict], bool | None] | None = None, aliases: DataFrame | None = None, different: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components ``id, component``; new aliases ``key, target``; new different pairs ``lo, hi``)."""
    spark, call = datasets.sparkSession, judge or same_words_judge
    aliases = aliases if aliases is not None else spark.createDataFrame([], "key string, target string")
    different = different if different is not None else spark.createDataFrame([], "lo string, hi string")
    title = datasets.select("id", *_DETAILS, normalize_title("title").alias("key")).join(aliases, "key", "left").withColumn("name", F.coalesce("target", "key"))
    side = lambda n: title.select(F.col("id").alias(n), "name", *_DETAILS).toDF(n, f"name_{n}", *[f"{c}_{n}" for c in _DETAILS])
    told = pairs.select("lo", "hi").join(side("lo"), "lo").join(side("hi"), "hi").join(different.select("lo", "hi"), ["lo", "hi"], "left_anti")
    told = materialise(told.withColumn("equal", (F.col("name_lo") != "") & (F.col("name_lo") == F.col("name_hi"))))
    named = told.filter("equal").select("lo", "hi")
    joined = connected_components(named, "lo", "hi")

    def ask(batches):
        for b in batches:
            out = [(r["lo"], r["hi"], call({c: r[f"{c}_lo"] for c in _DETAILS}, {c: r[f"{c}_hi"] for c in _DETAILS})) for r in b.to_dict("records")]
            yield pd.DataFrame(out, columns=["lo", "hi", "same"]).astype({"same": "boolean"})

    # pairs that titles already join need no judge
    of = lambda n: joined.select(F.col("id").alias(n), F.col("component").alias(f"c_{n}"))
    open_ = told.filter("not equal").join(of("lo"), "lo", "left").join(of("hi"), "hi", "left").filter("c_lo is null or c_hi is null or c_lo <> c_hi")
    judged = materialise(open_.select("lo", "hi", *[f"{c}_{n}" for n in ("lo", "hi") for c in _DETAILS]).mapInPandas(ask, "lo string, hi string, same boolean"))
    components = materialise(connected_components(named.unionByName(judged.filter("same").select("lo", "hi")), "lo", "hi"))
    merged = judged.filter("same").select(F.explode(F.array("lo", "hi")).alias("id")).distinct().join(components, "id").join(title.select("id", "key"), "id")
    new = merged.filter("key <> ''").groupBy("key").agg(F.min("component").alias("target"))
    return components, new, judged.filter("not same").select("lo", "hi")
