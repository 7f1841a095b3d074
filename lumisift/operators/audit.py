"""Consistency checks between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of a that b lacks."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def both_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return difference(a, b, key).withColumn("side", F.lit("left_only")).unionByName(difference(b, a, key).withColumn("side", F.lit("right_only")))


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """n_common, n_left_only, n_right_only, percent of the right side that is common; null percent if that is empty."""
    sides = a.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).union(b.select(key, F.lit(0), F.lit(1))).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    n = sides.agg(F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("n_common"), F.count_if(F.col("r") == 0).alias("n_left_only"), F.count_if(F.col("l") == 0).alias("n_right_only"))
    total = F.col("n_common") + F.col("n_right_only")
    return n.withColumn("percent", F.when(total > 0, F.round(F.col("n_common") * 100.0 / total, 1)))


def related_overlap(files: dict[str, DataFrame], keys: DataFrame, key: str = "query_id") -> DataFrame:
    """file, n_ids, n_common for each related table."""
    tagged = reduce(DataFrame.union, (df.select(F.lit(name).alias("file"), F.col(key)).distinct() for name, df in files.items()))
    known = keys.select(key).distinct().withColumn("known", F.lit(1))
    return tagged.join(known, key, "left").groupBy("file").agg(F.count("*").alias("n_ids"), F.count("known").alias("n_common"))


def match_flags(matches: DataFrame, crawled: DataFrame, files: DataFrame, suffix: str = ".jpg") -> DataFrame:
    """matches(origin_id, filename, score) with in_json and has_file: whether filename + suffix is a crawled image and a file. Null matches are left out."""
    own = matches.where("filename is not null").withColumn("file", F.concat("filename", F.lit(suffix)))
    out = own.join(crawled.select(F.col("image_id").alias("file"), F.lit(True).alias("j")).distinct(), "file", "left").join(files.select("file", F.lit(True).alias("f")).distinct(), "file", "left")
    return out.select("origin_id", "file", "score", F.col("j").isNotNull().alias("in_json"), F.col("f").isNotNull().alias("has_file"))


def issue() -> Column:
    """missing_both, missing_in_json, missing_file, or null."""
    j, f = F.col("in_json"), F.col("has_file")
    return F.when(~j & ~f, "missing_both").when(~j, "missing_in_json").when(~f, "missing_file")


def tallies(flags: DataFrame) -> DataFrame:
    j, f = F.col("in_json"), F.col("has_file")
    return flags.agg(F.count("*").alias("checked"), F.count_if(j).alias("found_in_json"), F.count_if(~j).alias("missing_in_json"), F.count_if(f).alias("file_exists"), F.count_if(~f).alias("file_missing"))


def count_mismatches(articles: DataFrame, matches: DataFrame) -> DataFrame:
    """article_id, n_origin, n_matched where an article has other numbers of images and of match entries."""
    n = matches.groupBy("article_id").agg(F.count("*").alias("n_matched"))
    own = articles.select("article_id", F.size("images").alias("n_origin")).join(n, "article_id", "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
    return own.where("n_origin <> n_matched")


def contained(ids: DataFrame, names: DataFrame, gram: int = 4) -> DataFrame:
    """Rows of ids(id) that some row of names(name) contains.

    An equi-join on short runs of characters finds candidates; a condition on every pair never runs alone.
    Ids shorter than a run are compared with all runs' beginnings of that length.
    """
    runs = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(n))))
    each = ids.where(F.length("id") >= gram).select("id").distinct().select("id", F.explode(runs("id", gram)).alias("run"))
    often = each.groupBy("run").agg(F.count("*").alias("n"))
    # of an id's runs the one that fewest ids have, so that a common beginning is no key
    long = each.join(often, "run").groupBy("id").agg(F.min_by("run", F.struct("n", "run")).alias("run"))
    hit = long.join(names.select("name", F.explode(runs("name", gram)).alias("run")), "run").where(F.contains("name", "id"))
    short = ids.where(F.length("id") < gram)
    cases = [hit.select("id")]
    for n in range(1, gram):
        own = short.where(F.length("id") == n)
        cases.append(own.join(names.select(F.explode(runs("name", n)).alias("id")).distinct(), "id", "left_semi").select("id"))
    return reduce(DataFrame.union, cases).distinct()


def similar_keys(wanted: DataFrame, keys: DataFrame, n: int = 5) -> DataFrame:
    """wanted(query_id) with the keys, of the first n, that contain it or that it contains."""
    first = F.broadcast(keys.select(F.col("query_id").alias("key")).orderBy("key").limit(n))  # n rows
    return wanted.join(first, F.contains("query_id", "key") | F.contains("key", "query_id")).select("query_id", "key")


def length_stats(rows: DataFrame, column: str) -> DataFrame:
    n = F.length(column)
    return rows.agg(F.count(column).alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"))


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows that a hash of key and seed draws: the same in every run."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)
