"""A kept inverted index: built by deltas, searched without reading a text.

Each build adds four tables under its number: the postings of fresh chunks (``tok, uid, tf, dl``),
the chunks gone before it (``uid``), changes of document frequencies (``tok, df``) and, last,
changes of the totals (``n, length``); a build without totals is not there yet. Postings and
frequencies lie in folders by a hash of the term, so a search reads the folders of its terms.
A posting counts unless its chunk went in a later build. ``compact`` merges all builds into
one that stands for those before it.

A build counts a chunk's terms where the chunk lies and moves postings once, to their folders. A
search moves the postings of its terms once, by chunk, whatever the number of queries: a
chunk's scores are summed where its postings meet.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.ranking import ranked
from tamarack.functions.text import tokenize
from tamarack.operators.retrieval import K1, MOST_TASKS, SCORES, B, small, tokens_of

FOLDERS = 64
_SCHEMA = {
    "postings": "tok string, uid string, tf long, dl int, build long, folder int",
    "gone": "uid string, build long",
    "terms": "tok string, df long, build long, folder int",
    "totals": "n long, length long, base boolean, build long",
}


def counted(tokens: Column) -> Column:
    """``tok, tf`` of each distinct token of an array: runs of the sorted one."""
    one = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  evaluated once
    begins = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s, b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("tok"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).cast("long").alias("tf")))
    none = F.array().cast("array<struct<tok:string,tf:bigint>>")
    return F.when(F.size(tokens) > 0, one(F.array_sort(tokens), lambda s: one(begins(s), lambda b: runs(s, b)))).otherwise(none)


class Postings:
    """The index under ``path``, a shared folder."""

    def __init__(self, spark: SparkSession, path: str, folders: int = FOLDERS):
        self.spark, self.path, self.folders = spark, path.rstrip("/"), folders

    def _folder(self, tok: str = "tok") -> Column:
        return F.pmod(F.xxhash64(tok), F.lit(self.folders)).cast("int")

    def builds(self) -> list[int]:
        """Numbers of the builds that count: the newest base and what came after it."""
        try:
            rows = self.spark.read.schema(_SCHEMA["totals"]).parquet(f"{self.path}/totals").select("build", "base").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        base = max((r["build"] for r in rows if r["base"]), default=0)
        return sorted({r["build"] for r in rows if r["build"] >= base})

    def _table(self, name: str, builds: list[int]) -> DataFrame:
        at = [f"{self.path}/{name}/build={k}" for k in builds]
        return self.spark.read.schema(_SCHEMA[name]).option("basePath", f"{self.path}/{name}").parquet(*at)

    def _write(self, build: int, name: str, rows: DataFrame) -> None:
        to = f"{self.path}/{name}/build={build}"
        if "folder" in rows.columns:
            rows.hint("rebalance", "folder").write.mode("overwrite").partitionBy("folder").parquet(to)
        else:
            rows.write.mode("overwrite").parquet(to)

    def add(self, fresh: DataFrame, gone: DataFrame | None = None) -> int:
        """One build more: chunks that come (``uid, file, document``) and that go (the same
        columns, as they were put in); its number.

        A chunk that changes goes and comes. What goes without having come is an error of the
        caller that totals would show. A build that failed is written again under its number.
        """
        build = max(self.builds(), default=0) + 1
        gone = fresh.limit(0) if gone is None else gone
        cut = tokens_of(fresh).select("uid", F.size("tokens").alias("dl"), F.explode(counted(F.col("tokens"))).alias("t"))
        self._write(build, "postings", cut.select("t.tok", "uid", "t.tf", "dl", self._folder("t.tok").alias("folder")))
        self._write(build, "gone", gone.select("uid").distinct())
        signed = tokens_of(fresh).withColumn("sign", F.lit(1)).unionByName(tokens_of(gone).withColumn("sign", F.lit(-1)))
        terms = signed.select("sign", F.explode(F.array_distinct("tokens")).alias("tok")).groupBy("tok").agg(F.sum("sign").alias("df"))
        self._write(build, "terms", terms.where("df <> 0").select("tok", "df", self._folder().alias("folder")))
        none = F.lit(0).cast("long")
        totals = signed.agg(F.coalesce(F.sum("sign"), none).alias("n"), F.coalesce(F.sum(F.col("sign") * F.size("tokens")), none).alias("length"))
        self._write(build, "totals", totals.select("n", "length", F.lit(False).alias("base")))
        return build

    def _alive(self, postings: DataFrame, builds: list[int]) -> DataFrame:
        """Postings whose chunk didn't go in a later build."""
        went = self._table("gone", builds).groupBy("uid").agg(F.max("build").alias("went"))
        return postings.join(went, "uid", "left").where(F.col("went").isNull() | (F.col("went") <= F.col("build"))).drop("went")

    def search(self, queries: DataFrame, limit: int = 10, k1: float = K1, b: float = B) -> DataFrame:
        """``query_id, uid, score, bm25_rank`` of ``queries`` (``query_id, query``): what a search of
        the texts that are in gives. No build is a ``LookupError``."""
        builds = self.builds()
        if not builds:
            raise LookupError(f"there is no index at {self.path} yet")
        asked = queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("tok")).groupBy("query_id", "tok").agg(F.count("*").alias("qtf"))
        terms = asked.select("tok").distinct().withColumn("folder", self._folder())
        folders = [r["folder"] for r in terms.select("folder").distinct().collect()]  # FOLDERS at most
        of = lambda name: self._table(name, builds).where(F.col("folder").isin(folders)).join(small(terms.select("tok")), "tok", "left_semi")
        totals = self._table("totals", builds).agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
        n, avgdl = totals["n"] or 0, (totals["length"] or 0) / max(totals["n"] or 0, 1)
        df = of("terms").groupBy("tok").agg(F.sum("df").alias("df"))
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = asked.join(df, "tok").select("query_id", "tok", (F.col("qtf") * idf).alias("w"))
        part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
        # postings, not their scores for each query, are shuffled; a task has SCORES scores at most
        n_asked = queries.select("query_id").distinct().count()
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), min(-(-n * n_asked // SCORES), MOST_TASKS))
        alive = self._alive(of("postings").repartition(tasks, "uid"), builds).where(F.lit(avgdl > 0))
        # rows that repeat a chunk of one build are one
        alive = alive.groupBy("uid", "tok", "dl", "build").agg(F.sum("tf").alias("tf"))
        scored = alive.join(small(weights), "tok").groupBy("query_id", "uid").agg(F.sum(part).alias("score"))
        return ranked(scored.where("score > 0").select("query_id", "uid", F.round("score", 6).alias("score")), limit, "bm25_rank")

    def compact(self) -> int:
        """All builds as one, without what went; its number."""
        builds = self.builds()
        build = max(builds, default=0) + 1
        if builds:
            self._write(build, "postings", self._alive(self._table("postings", builds), builds).drop("build"))
            terms = self._table("terms", builds).groupBy("tok", "folder").agg(F.sum("df").alias("df"))
            self._write(build, "terms", terms.where("df > 0"))
            self._write(build, "gone", self._table("gone", builds).select("uid").limit(0))
            totals = self._table("totals", builds).agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
            self._write(build, "totals", totals.select("n", "length", F.lit(True).alias("base")))
        return build
