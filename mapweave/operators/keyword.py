"""Keyword signal by an inverted index: BM25 statistics per pool, and an exact top k without scoring every pair.

A pool is what a source may be matched with: all targets, or those that share a category key with it. Sources with the same
keys share a pool, so frequencies and lengths are counted once per pool, not per source.

Top k: every query term has a greatest possible contribution, the greatest weight in its postings. A source first meets the
postings of its strongest terms; the k-th best sum there is a threshold that no better candidate can stay below. Of the
terms in falling strength, those at the end whose contributions together stay below the threshold cannot make a candidate
by themselves: their postings, the longest ones, are never joined with the source. The sums over the other terms raise the
threshold once more, and only the few pairs that can still reach it look the left-out terms up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mapweave.params import GLOBAL_SCOPES, Params
from mapweave.sources.shared import saved
from mapweave.sources.tables import partitions

K1, LENGTH_PART = 1.5, 0.75
DIGITS = 9
#: Postings that the first round reads for each of the k wanted candidates; those of the strongest term in any case.
FIRST_READ = 200
#: Pairs that a task sums up at once, and parts of the targets out of which the k-th best sum is told.
PAIRS, PARTS = 1 << 20, 400
#: Sums in another order differ by less.
SLACK = 1e-6


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_counts(df: DataFrame, *key: str, among: DataFrame | None = None) -> DataFrame:
    """(key..., term, tf) of the `terms` of every row, counted inside the row; among: only terms of this table."""
    first = F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1)))
    runs = df.select(*key, F.sort_array(F.array_compact("terms")).alias("_t")).where(F.size("_t") > 0).withColumn("_at", first)
    entry = F.transform("_at", lambda at, j: F.struct(F.get("_t", at).alias("term"), (F.coalesce(F.get("_at", j + 1), F.size("_t")) - at).cast("long").alias("tf")))
    counts = runs.select(*key, F.inline(entry))
    return counts if among is None else counts.join(among, "term", "left_semi")


class Index:
    """Postings of the terms that some source asks for, weighted with the statistics of the pool.

    sources: atomic_id, terms, keys; targets: atomic_id, order_no, terms, keys (keys only in category scopes). Empty term
    lists never match. A source without keys has all targets as its pool. Tables kept: `sources` (s_no, pool), `targets`
    (t_no), `query` (s_no, pool, term, c: how often), `pools` (pool, n, avg_len), `postings` (term_no, t_no, w) and `heads` (term_no:
    a hash of pool and term, pool, term, df, most). A target has a row of postings for each pool it is in.
    """

    def __init__(self, sources: DataFrame, targets: DataFrame, p: Params):
        self.keyed = p.match_scope not in GLOBAL_SCOPES
        pool = F.to_json(F.array_sort("keys")) if self.keyed else F.lit("[]")
        keys = ["keys"] if self.keyed else []
        no = F.monotonically_increasing_id()
        self.sources = saved(sources.select("atomic_id", "terms", *keys, pool.alias("pool")).withColumn("s_no", no), "keyword-sources")
        length = F.size("terms").cast("long").alias("dl")
        profile = [F.coalesce(F.to_json("keys"), F.lit("")).alias("profile")] if self.keyed else []
        self.targets = saved(targets.select("atomic_id", "order_no", "terms", *keys, *profile, length).withColumn("t_no", no), "keyword-targets")
        self.query = saved(term_counts(self.sources, "s_no", "pool").withColumnRenamed("tf", "c"), "keyword-query")
        asked = self.query.select("pool", "term").distinct()
        counts = term_counts(self.targets, "t_no", "dl", *(["profile"] if self.keyed else []), among=asked.select("term").distinct())
        if self.keyed:
            members = saved(self._members(), "keyword-members")
            sized = self.targets.select("profile", "dl").join(members, "profile").groupBy("pool")
            found = counts.join(members, "profile").drop("profile").join(asked, ["pool", "term"], "left_semi")
        else:
            sized = self.targets.select(F.lit("[]").alias("pool"), "dl").groupBy("pool")
            found = counts.withColumn("pool", F.lit("[]"))
        self.pools = saved(sized.agg(F.count(F.lit(1)).alias("n"), (F.sum("dl") / F.count(F.lit(1))).alias("avg_len")), "keyword-pools")
        found = saved(found, "keyword-found")
        df = found.groupBy("pool", "term").agg(F.count(F.lit(1)).alias("df"))
        length = 1 - LENGTH_PART + LENGTH_PART * F.col("dl") / F.col("avg_len")
        weight = idf(F.col("n"), F.col("df")) * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * length)
        rows = found.join(df.join(self.pools, "pool"), ["pool", "term"])
        rows = saved(rows.select(F.xxhash64("pool", "term").alias("term_no"), "pool", "term", "t_no", weight.alias("w")), "postings")
        self.postings = rows.select("term_no", "t_no", "w")
        heads = rows.groupBy("term_no", "pool", "term").agg(F.count(F.lit(1)).alias("df"), F.max("w").alias("most"))
        self.heads = saved(heads, "posting-heads")
        if self.heads.select("term_no").distinct().count() < self.heads.count():
            raise ValueError("two terms have one hash")

    def _members(self) -> DataFrame:
        """(profile, pool): targets with the same keys are in the same pools, so their keys meet the pools once."""
        pools = self.sources.select("pool", "keys").dropDuplicates(["pool"])
        profiles = self.targets.select("profile", "keys").dropDuplicates(["profile"])
        by_key = profiles.select("profile", F.explode("keys").alias("key"))
        shared = pools.select("pool", F.explode("keys").alias("key")).join(by_key, "key").select("pool", "profile").distinct()
        if pools.where(F.size("keys") == 0).limit(1).count():
            shared = shared.unionByName(profiles.select(F.lit("[]").alias("pool"), "profile"))
        return shared

    def _sums(self, terms: DataFrame) -> DataFrame:
        """(s_no, t_no, raw) over the postings of query terms (s_no, term_no, c).

        Postings are dealt out by target first: where the terms are few enough to be sent to all tasks, pairs need no shuffle.
        The number of pairs is known before, so a task gets about PAIRS of them, however many there are.
        """
        pairs = terms.agg(F.sum("df")).first()[0] or 0
        asked = self.postings.join(terms.select("term_no").distinct(), "term_no", "left_semi")
        dealt = asked.repartition(max(partitions(self.postings.sparkSession), -(-pairs // PAIRS)), "t_no")
        return dealt.join(terms.select("s_no", "term_no", "c"), "term_no").groupBy("t_no", "s_no").agg(F.sum(F.col("c") * F.col("w")).alias("raw"))

    @staticmethod
    def _reached(sums: DataFrame, k: int) -> DataFrame:
        """(s_no, reached): a sum that k targets of a source reach, 0 where there are fewer. It is the k-th best of the best sums of
        PARTS parts of the targets, seldom below the k-th best of all, and no task sorts or keeps its pairs for it."""
        parts = sums.groupBy("s_no", F.pmod(F.xxhash64("t_no"), F.lit(max(PARTS, 50 * k))).alias("part")).agg(F.max("raw").alias("raw"))
        best = parts.groupBy("s_no").agg(F.sort_array(F.collect_list("raw"), asc=False).alias("best"))
        return best.select("s_no", F.coalesce(F.get("best", F.lit(k - 1)), F.lit(0.0)).alias("reached"))

    def top(self, k: int) -> DataFrame:
        """(source_id, candidate_id, order_no, raw_score, rank): the k best targets of the pool with a score above 0, ties by input order."""
        falling = Window.partitionBy("s_no").orderBy(F.desc("most"), "term")
        before, onward = falling.rowsBetween(Window.unboundedPreceding, -1), falling.rowsBetween(0, Window.unboundedFollowing)
        terms = self.query.join(self.heads, ["pool", "term"]).withColumn("most", F.col("c") * F.col("most"))
        terms = saved(terms.withColumns({"read": F.coalesce(F.sum("df").over(before), F.lit(0)), "onward": F.sum("most").over(onward)}), "query-terms")
        reached = self._reached(self._sums(terms.where((F.col("read") + F.col("df") <= FIRST_READ * k) | (F.col("read") == 0))), k)
        terms = saved(terms.join(reached, "s_no").withColumn("strong", F.col("onward") >= F.col("reached") - SLACK), "strong-terms")
        left = F.coalesce(F.max(F.when(~F.col("strong"), F.col("onward"))), F.lit(0.0))
        limits = terms.groupBy("s_no").agg(F.first("reached").alias("reached"), left.alias("left"))
        near = F.col("raw") + F.col("left") >= F.col("reached") - SLACK
        able = saved(self._sums(terms.where("strong")).join(limits, "s_no").where(near), "keyword-pairs")
        pairs = able.count()
        able = able.join(self._reached(able, k).withColumnRenamed("reached", "raised"), "s_no").withColumn("reached", F.greatest("reached", "raised"))
        able = able.where(near).select("s_no", "t_no", "raw")
        n = max(partitions(able.sparkSession), -(-pairs // (PAIRS // 4)))
        rest = able.join(terms.where(~F.col("strong")).select("s_no", "term_no", "c"), "s_no").repartition(n, "term_no", "t_no").join(self.postings, ["term_no", "t_no"])
        both = able.unionByName(rest.select("s_no", "t_no", (F.col("c") * F.col("w")).alias("raw")))
        raw = both.repartition(n, "t_no").groupBy("s_no", "t_no").agg(F.round(F.sum("raw"), DIGITS).alias("raw_score"))
        named = raw.where("raw_score > 0").join(self.targets.select("t_no", F.col("atomic_id").alias("candidate_id"), "order_no"), "t_no")
        rank = F.row_number().over(Window.partitionBy("s_no").orderBy(F.desc("raw_score"), "order_no", "candidate_id"))
        named = named.withColumn("rank", rank).where(F.col("rank") <= k)
        return named.join(self.sources.select("s_no", F.col("atomic_id").alias("source_id")), "s_no").select("source_id", "candidate_id", "order_no", "raw_score", "rank")

    def source_terms(self) -> DataFrame:
        """(atomic_id, term_list, term_weight, avg_len, keyword_best): what a source adds to the score of a pair, and its best raw score."""
        known = self.query.join(self.heads, ["pool", "term"]).join(self.pools, "pool")
        entry = F.struct("term", (F.col("c") * idf(F.col("n"), F.col("df"))).alias("w"))
        terms = known.groupBy("s_no").agg(F.sort_array(F.collect_list(entry)).alias("_t"))
        best = self.top(1).select(F.col("source_id").alias("atomic_id"), F.col("raw_score").alias("keyword_best"))
        out = self.sources.join(terms, "s_no", "left").join(self.pools.select("pool", "avg_len"), "pool", "left").join(best, "atomic_id", "left")
        return out.select("atomic_id", *_lists("_t", "w", "term_weight"), F.coalesce(F.when(F.col("avg_len") > 0, F.col("avg_len")), F.lit(1.0)).alias("avg_len"),
                          F.coalesce("keyword_best", F.lit(1.0)).alias("keyword_best"))

    def target_terms(self) -> DataFrame:
        """(atomic_id, term_list, term_tf, doc_len) of the targets: all that a pool's weights are made of."""
        terms = term_counts(self.targets, "t_no").groupBy("t_no").agg(F.sort_array(F.collect_list(F.struct("term", F.col("tf").cast("double").alias("w")))).alias("_t"))
        return self.targets.join(terms, "t_no", "left").select("atomic_id", *_lists("_t", "w", "term_tf"), F.col("dl").cast("double").alias("doc_len"))


def _lists(entries: str, value: str, name: str) -> list[Column]:
    found = F.col(entries)
    return [F.coalesce(found["term"], F.array().cast("array<string>")).alias("term_list"), F.coalesce(found[value], F.array().cast("array<double>")).alias(name)]


def with_keywords(sources: DataFrame, targets: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns of source_terms and target_terms; atomic_id must name a row."""
    index = Index(sources, targets, p)
    return saved(sources.join(index.source_terms(), "atomic_id"), "search"), saved(targets.join(index.target_terms(), "atomic_id"), "search")
