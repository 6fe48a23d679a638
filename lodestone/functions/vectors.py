"""Vector arithmetic over array columns, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Null where a vector is zero, null or of another length."""
    n = norm(a) * norm(b)
    return F.when((F.size(_d(a)) == F.size(_d(b))) & (n > 0), dot(a, b) / n)


def distance(a: Column | str, b: Column | str, metric: str = "cosine") -> Column:
    """cosine: 1 - similarity; l2: squared distance; ip: 1 - inner product."""
    if metric == "cosine":
        return 1 - cosine_similarity(a, b)
    if metric == "l2":
        return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    if metric == "ip":
        return 1 - dot(a, b)
    raise ValueError(f"unknown metric: {metric}")


def unit(a: Column | str) -> Column:
    """The vector over its length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(_d(a), lambda x: x / n)).otherwise(_d(a))


def dimension_stats(df: DataFrame, embedding: str = "embedding", exact: bool = True) -> DataFrame:
    """One row a dimension over the whole table: min, max, mean, population deviation and quartiles. exact=False takes the quartiles from sketches, for tables whose dimensions have more different values than one task can hold."""
    from lodestone.functions import sketches

    v = df.select(F.posexplode(_d(embedding)).alias("dim", "x"))
    names = (("q25", 0.25), ("median_x", 0.5), ("q75", 0.75))
    moments = [F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.avg("x").alias("mean_x"), F.stddev_pop("x").alias("std_x")]
    if exact:
        return v.groupBy("dim").agg(*moments, *[F.percentile("x", F.lit(q)).alias(n) for n, q in names])
    s = v.groupBy("dim").agg(*moments, F.kll_sketch_agg_double("x", F.lit(sketches.SIZE)).alias("__s"))
    return s.select(*[c for c in s.columns if c != "__s"], *[sketches.quantile("__s", q).alias(n) for n, q in names])


def normalise(df: DataFrame, method: str, embedding: str = "embedding", exact: bool = True) -> DataFrame:
    """df with the embedding normalised: unit, or min_max, z_score, robust by dimension with statistics of the whole table. A zero spread divides by 1. exact: as in dimension_stats."""
    if method == "unit":
        return df.withColumn(embedding, unit(embedding))
    pairs = {"min_max": ("min_x", F.col("max_x") - F.col("min_x")), "z_score": ("mean_x", F.col("std_x")), "robust": ("median_x", F.col("q75") - F.col("q25"))}
    if method not in pairs:
        raise ValueError(f"unknown method: {method}")
    centre, spread = pairs[method]
    stats = dimension_stats(df, embedding, exact).select(F.struct("dim", F.col(centre).alias("c"), F.when(spread == 0, 1.0).otherwise(spread).alias("s")).alias("st"))
    one = stats.agg(F.sort_array(F.collect_list("st")).alias("__stats"))  # one row, as long as a vector
    scaled = F.zip_with(_d(embedding), F.col("__stats"), lambda x, st: (x - st["c"]) / st["s"])
    return df.crossJoin(F.broadcast(one)).withColumn(embedding, scaled).drop("__stats")


def principal_components(df: DataFrame, k: int | float, embedding: str = "embedding", out: str = "projected") -> DataFrame:
    """df with centred vectors projected on the first k principal components; k below 1: on as few as explain that share of the variance. Unchanged if vectors have no more than k dimensions."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    first = df.select(F.size(embedding).alias("n")).where("n > 0").limit(1).collect()
    if not first or first[0]["n"] <= k:
        return df.withColumn(out, _d(embedding))
    means = dimension_stats(df, embedding).agg(F.sort_array(F.collect_list(F.struct("dim", F.col("mean_x").alias("c")))).alias("__m"))
    centred = df.crossJoin(F.broadcast(means)).withColumn("__v", array_to_vector(F.zip_with(_d(embedding), F.col("__m"), lambda x, m: x - m["c"]))).drop("__m")
    model = PCA(k=k if k >= 1 else first[0]["n"], inputCol="__v", outputCol="__p").fit(centred)
    kept = k if k >= 1 else 1 + sum(x < k for x in model.explainedVariance.toArray().cumsum()[:-1])
    return model.transform(centred).withColumn(out, F.slice(vector_to_array("__p"), 1, int(kept))).drop("__v", "__p")
