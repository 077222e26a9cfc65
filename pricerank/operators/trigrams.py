"""Many name searches at once by an index of n-grams.

contains() of functions/text.py is one pattern against every row. Here a table of queries meets a table of names through postings (gram, id): a row can match only if it holds every gram of the query's literal parts, so
the rarest grams of each query give its candidates, and ILIKE decides on them. The result is what all pairs would give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a gram; grams of a query that are intersected.
GRAM, RAREST = 3, 3


def grams(text: Column, sizes: Column) -> Column:
    """The distinct substrings of the lengths in the array `sizes`."""
    each = lambda n: F.when(F.char_length(text) >= n, F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda at: F.substr(text, at, n))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(sizes, each)))


def postings(df: DataFrame, column: str, key: str = "id") -> DataFrame:
    """gram, key: the grams of 1 to GRAM characters of each row's lower-cased text, and the empty gram. Rows with a null text have none."""
    found = grams(F.lower(column), F.sequence(F.lit(1), F.lit(GRAM)))
    return df.where(F.col(column).isNotNull()).select(F.explode(F.array_append(found, F.lit(""))).alias("gram"), key)


#: Stands before a character that a backslash takes literally; no character of texts.
MARK = "\uFFFF"


def _marked(query: Column) -> Column:
    """%query% with MARK for each backslash that begins an escape, read from the left."""
    return F.regexp_replace(F.concat(F.lit("%"), query, F.lit("%")), r"\\([\s\S])", MARK + "$1")


def pattern(query: Column) -> Column:
    """ilike_pattern() of functions/text.py as a column: backslashes that escape nothing are taken out."""
    return F.replace(F.regexp_replace(_marked(query), MARK + r"([%_\\])", r"\\$1"), F.lit(MARK), F.lit(""))


def literal_parts(query: Column) -> Column:
    """The parts of a query between its wildcards, lower-cased."""
    parts = F.split(_marked(F.lower(query)), f"(?<!{MARK})[%_]")
    return F.filter(F.transform(parts, lambda part: F.replace(part, F.lit(MARK), F.lit(""))), lambda part: part != "")


def query_grams(queries: DataFrame) -> DataFrame:
    """query_id, gram: of each literal part the grams of GRAM characters, or of its own length if it is shorter; the empty gram for a query without literals."""
    of_part = lambda part: grams(part, F.array(F.least(F.char_length(part), F.lit(GRAM))))
    found = F.array_distinct(F.flatten(F.transform(literal_parts(F.col("query")), of_part)))
    return queries.select("query_id", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))).alias("gram"))


def search_many(df: DataFrame, queries: DataFrame, column: str, key: str = "id", index: DataFrame | None = None) -> DataFrame:
    """query_id, key of all rows that contain a query (query_id, query), as contains() finds them. index: stored postings() of the same rows, else they are made.

    Queries are taken as they are, null ones find nothing, an empty one finds every text. Query ids are distinct; texts longer than a query costs are fine."""
    index = postings(df, column, key) if index is None else index
    asked = query_grams(queries.where("query IS NOT NULL"))
    # how many rows hold each gram that is asked for
    held = index.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("rows"))
    known = asked.join(held, "gram", "left")
    order = Window.partitionBy("query_id").orderBy(F.coalesce("rows", F.lit(0)), "gram")
    chosen = known.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= RAREST)
    chosen = chosen.withColumn("_grams", F.count("*").over(Window.partitionBy("query_id"))).where("rows IS NOT NULL")
    both = chosen.join(index, "gram").groupBy("query_id", key).agg(F.count("*").alias("_hits"), F.first("_grams").alias("_grams")).where("_hits = _grams")
    texts = df.select(F.col(key), F.col(column).alias("_text"))
    verified = both.select("query_id", key).join(queries, "query_id").join(texts, key)
    return verified.withColumn("_pattern", pattern(F.col("query"))).where(F.expr("_text ILIKE _pattern")).select("query_id", key)


def count_many(df: DataFrame, queries: DataFrame, column: str, key: str = "id") -> DataFrame:
    """query_id, n_hits and first_id (the least key) of what search_many() finds, for the queries that find a row.

    Equal texts are searched as one, and so are equal queries, so that copies cost a grouping and no pair of a query and a row is formed for them."""
    texts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_name")).agg(F.count("*").alias("_rows"), F.min(key).alias("_first"))
    asked = queries.where("query IS NOT NULL").groupBy("query").agg(F.min("query_id").alias("query_id"))
    found = search_many(texts, asked, "_name", "_first").join(texts.select("_first", "_rows"), "_first")
    counted = found.groupBy("query_id").agg(F.sum("_rows").alias("n_hits"), F.min("_first").alias("first_id"))
    # back to all queries of the text
    known = asked.join(counted, "query_id").select("query", "n_hits", "first_id")
    return queries.join(known, "query").select("query_id", "n_hits", "first_id")
