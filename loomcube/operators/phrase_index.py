"""A stored positional index of texts, and phrases looked up in it.

The index is a folder of Parquet files: ``postings`` (token, document, field, positions) and ``tokens`` (token, number
of documents), both in folders by the hash of the token. A lookup reads the folders of its tokens only. A folder's
postings lie in several files by document, so that a frequent token does not fill one task when it is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcube.functions.text import count_substring, normalise_hyphens, normalise_synonym, run_starts, runs
from loomcube.storage import discard, materialise

#: The words that an English stop filter takes out.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such",
    "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
#: Runs of letters, marks, digits and underscores, joined by an apostrophe or point between letters or by a point or comma between digits.
STANDARD = r"[\p{L}\p{M}\p{N}_]+(?:(?:(?<=\p{L})['’.](?=\p{L})|(?<=\p{N})[.,](?=\p{N}))[\p{L}\p{M}\p{N}_]+)*"
#: Runs of letters and digits.
SIMPLE = r"[\p{L}\p{N}]+"

#: Tokens after the first of their phrases up to which all other postings are left out before the joins.
LATER = 100_000


@dataclass(frozen=True)
class Analyzer:
    """How a text becomes tokens: their pattern, whether case counts, and words that are taken out but keep their place."""

    pattern: str = STANDARD
    case_sensitive: bool = True
    stop_words: tuple[str, ...] = STOP_WORDS

    def tokens(self, text: Column) -> Column:
        """``array<struct<token, position>>`` of a text, from 0; a null text has none."""
        words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), 0)
        if not self.case_sensitive:
            words = F.transform(words, F.lower)
        placed = F.transform(words, lambda w, i: F.struct(w.alias("token"), i.alias("position")))
        return F.filter(placed, lambda p: ~p["token"].isin(list(self.stop_words))) if self.stop_words else placed


def build(docs: DataFrame, path: str, fields: tuple[str, ...], analyzer: Analyzer = Analyzer(), buckets: int = 64, spread: int = 8) -> None:
    """Writes the index of ``fields`` of ``docs`` (``doc_id`` and the fields) to ``path``, in place of what is there.

    One exchange deals the sorted tokens of a field, a row a bucket, to ``buckets`` times ``spread`` files, or as many
    as there are shuffle partitions; where they arrive the positions of a token are put together. Rows without doc_id
    are left out; the positions of equal doc_ids come together, so documents should be the latest versions of their ids.
    """
    own = docs.filter("doc_id IS NOT NULL")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), analyzer.tokens(F.col(f)).alias("tokens")) for f in fields))).alias("f")
    spread = max(spread, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)
    bucketed = lambda e: F.struct(F.pmod(F.xxhash64(e["token"]), F.lit(buckets)).cast("int").alias("bucket"), e["token"].alias("token"), e["position"].alias("position"))
    placed = own.select("doc_id", each).select("doc_id", "f.field", F.sort_array(F.transform("f.tokens", bucketed)).alias("own")).withColumn("starts", run_starts("own", "bucket"))
    cut = lambda a, n: F.struct(F.get("own", a)["bucket"].alias("bucket"), *(F.transform(F.slice("own", a + 1, n), lambda e: e[c]).alias(f"{c}s") for c in ("token", "position")))
    packed = placed.select("doc_id", "field", F.explode(runs("own", "starts", cut)).alias("t")).select("doc_id", "field", "t.*")
    packed = packed.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int")).repartition(buckets * spread, "bucket", "part")
    group = lambda a, n: F.struct(F.get("tokens", a).alias("token"), F.slice("positions", a + 1, n).alias("positions"))
    dealt = packed.withColumn("starts", run_starts("tokens")).select("bucket", "part", "doc_id", "field", F.explode(runs("tokens", "starts", group)).alias("t"))
    dealt = dealt.select("bucket", "part", "t.token", "doc_id", "field", "t.positions")
    if own.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        dealt = dealt.groupBy("bucket", "part", "token", "doc_id", "field").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    dealt = dealt.select("token", "doc_id", "field", "positions", "bucket").sortWithinPartitions("bucket", "token", "doc_id")
    dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    stored = docs.sparkSession.read.parquet(f"{path}/postings")
    counts = stored.groupBy("bucket", "token", "field").agg(F.count("*").alias("n"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/tokens")
    docs.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def _read(spark: SparkSession, path: str, name: str, wanted: list[int]) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").filter(F.col("bucket").isin(wanted))


def find_phrases(phrases: DataFrame, path: str, fields: tuple[str, ...], analyzer: Analyzer = Analyzer()) -> DataFrame:
    """``phrase, doc_id, n``: how often the tokens of a phrase follow each other in a field of a document.

    ``phrases`` is ``phrase``, analysed as the texts were; a stop word within a phrase stands for any token there.
    A phrase starts from the places of its token in the fewest fields; then one token after the other, by rising
    number, keeps the places that have it at its distance. Each step is a join on token, document and field, so it
    does not gather what a frequent token has, and phrases with a token that no text has are never looked up. A
    phrase without tokens occurs nowhere. There are as many steps as the longest phrase has tokens.
    """
    spark = phrases.sparkSession
    buckets = spark.read.parquet(f"{path}/settings").first()["buckets"]
    own = phrases.select("phrase").distinct().select("phrase", F.explode(analyzer.tokens(F.col("phrase"))).alias("t"))
    own = own.select("phrase", "t.token", F.col("t.position").alias("offset")).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    own = materialise(own, "phrases")
    wanted = [r["bucket"] for r in own.select("bucket").distinct().collect()]
    count = _read(spark, path, "tokens", wanted).filter(F.col("field").isin(list(fields))).groupBy("token").agg(F.sum("n").alias("n"))
    known = own.select("phrase", "token", "offset").join(count, "token", "left")
    order = F.array_sort(F.collect_list(F.struct("n", "token", "offset")))
    plans = known.groupBy("phrase").agg(order.alias("steps"), F.bool_and(F.col("n").isNotNull()).alias("all")).filter("all").select("phrase", "steps")
    plans = materialise(plans, "phrase-steps")
    longest = plans.agg(F.max(F.size("steps")).alias("n")).first()["n"] or 0
    postings = _read(spark, path, "postings", wanted).filter(F.col("field").isin(list(fields))).select("token", "doc_id", "field", "positions")
    places = spark.createDataFrame([], "phrase string, doc_id long, field string, start int").join(plans, "phrase") if not longest else None
    later = plans.select(F.explode(F.slice("steps", F.lit(2), F.greatest(F.size("steps") - 1, F.lit(0)))).alias("s")).select("s.token").distinct()
    following = postings.join(F.broadcast(later), "token", "left_semi") if later.limit(LATER + 1).count() <= LATER else postings
    for k in range(longest):
        step = F.get("steps", F.lit(k))
        if places is None:
            at = plans.select("phrase", "steps", step["token"].alias("token"), step["offset"].alias("offset")).join(postings, "token")
            places = at.select("phrase", "steps", "doc_id", "field", F.explode("positions").alias("p"), "offset").select("phrase", "steps", "doc_id", "field", (F.col("p") - F.col("offset")).alias("start"))
        else:
            done = places.filter(F.size("steps") <= k)
            at = places.filter(F.size("steps") > k).select("*", step["token"].alias("token"), step["offset"].alias("offset")).join(following, ["token", "doc_id", "field"])
            places = done.unionByName(at.filter(F.array_contains("positions", F.col("start") + F.col("offset"))).select("phrase", "steps", "doc_id", "field", "start"))
    found = materialise(places.groupBy("phrase", "doc_id").agg(F.count("*").alias("n")), "phrase-hits")
    discard(own, plans)
    return found


def count_retrieved(docs: DataFrame, synonyms: DataFrame, path: str, fields: tuple[str, ...], analyzer: Analyzer = Analyzer()) -> DataFrame:
    """``doc_id, synonym, cnt``: raw occurrences of a synonym in the documents in which the index finds it as a phrase.

    The phrase decides which documents are looked at, as a search engine would; there the normalised synonym is
    counted as a substring of each field with normalised hyphens.
    """
    hits = find_phrases(synonyms.select(F.col("synonym").alias("phrase")), path, fields, analyzer).select("doc_id", F.col("phrase").alias("synonym"))
    clean = docs.select("doc_id", *(normalise_hyphens(F.coalesce(F.col(c), F.lit(""))).alias(f"f{i}") for i, c in enumerate(fields)))
    both = hits.withColumn("synonym", normalise_synonym(F.col("synonym"))).filter("synonym <> ''").distinct().join(clean, "doc_id")
    times = F.lit(0)
    for i in range(len(fields)):
        times = times + count_substring(F.col(f"f{i}"), F.col("synonym"))
    return both.select("doc_id", "synonym", times.cast("long").alias("cnt")).filter("cnt > 0")
