"""N-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as co
from ..functions.expression import quoted

#: Fixed values.
STOPWORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can't cannot could couldn't "
    "did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her here here's "
    "hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on "
    "once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs "
    "them themselves then there there's these they they'd they'll they're they've this those through to too under until up very was wasn't we we'd we'll we're "
    "we've were weren't what what's when when's where where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've your "
    "yours yourself yourselves"
).split()


def words(c: Column, stopwords: bool = False) -> Column:
    """Lower-case words of letters, digits and underscores; ``stopwords``: without the common English ones."""
    w = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s_]", " "), r"\s+"), lambda x: x != "")
    return F.filter(w, lambda x: ~x.isin(*STOPWORDS)) if stopwords else w


def ngrams(df: DataFrame, column: str, n: int = 2, stopwords: bool = False, top: int | None = 20, least: int = 1) -> DataFrame:
    """ngram, count, share (percent of all n-grams); most frequent first."""
    rows = df.select(words(quoted(column).cast("string"), stopwords).alias("w")).filter(F.size("w") >= n)
    grams = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))).alias("ngram"))
    counts = grams.groupBy("ngram").agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    out = counts.filter(F.col("count") >= least).crossJoin(F.broadcast(total))  # one row
    out = out.select("ngram", "count", co.half_up(F.col("count") * 100.0 / F.col("total"), 2).alias("share")).orderBy(F.desc("count"), "ngram")
    return out.limit(top) if top else out
