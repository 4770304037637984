"""Cross-site boilerplate lines by distinct-site spread (JVM only).

For each line hash (128 bits) a HyperLogLog sketch of the sites that hold the
line is merged by aggregation.  A line whose estimate is well above
``min_sites`` is boilerplate, one well below is not; lines whose estimate lies
within ``margin`` of the threshold get an exact distinct count.  Boilerplate
lines go from every document but the first that holds them (smallest doc_id,
then text hash, then position), so no passage vanishes from the corpus.
Lines shorter than ``min_chars`` characters without surrounding blanks recur by
chance more easily and need ``SHORT_FACTOR`` times the sites; lines of blanks stay.

A line may hold a third of all rows: sketches and minima are added up before
the shuffle, and lines meet the tables of boilerplate on (line hash, salt).

Nulls: a null text has no line and stays null; a null source is a site of its
own; a null doc_id sorts first.  Repeated rows are treated alike.  An empty text
is one blank line and stays.  Texts of any length are handled line by line.  No rows: empty result.  Other columns pass
through ``cleaned`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from comparo.llm.common import saved, table

MIN_SITES, MIN_CHARS, SHORT_FACTOR, MARGIN, LG_K = 5, 20, 2, 0.1, 12
#: Tasks over which the rows of one line are dealt in joins.
SALTS = 16


def lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line that is not blank: doc_id, th (text hash), site, salt, pos, a, b (line hash), need (sites of boilerplate)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"),
                    F.coalesce(F.xxhash64(F.col("source")), F.lit(0)).alias("site"), F.split("text", "\n").alias("ls"))
    each = F.transform("ls", lambda x, i: F.struct(
        i.cast("int").alias("pos"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.char_length(F.trim(x)).alias("n")))
    need = F.when(F.col("s.n") >= min_chars, min_sites).otherwise(min_sites * SHORT_FACTOR).alias("need")
    return (d.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)).cast("int"))
            .select("doc_id", "th", "site", "salt", F.explode(F.filter(each, lambda s: s["n"] > 0)).alias("s"))
            .select("doc_id", "th", "site", "salt", "s.pos", "s.a", "s.b", need))


def salted(hashes: DataFrame) -> DataFrame:
    """Every row once for each salt."""
    return hashes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def boilerplate(ls: DataFrame, margin: float = MARGIN, lg_k: int = LG_K) -> DataFrame:
    """Line hashes (a, b) found at as many sites as they need."""
    spread = ls.groupBy("a", "b", "need").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("est"))
    spread = saved(spread.filter(F.col("est") >= F.col("need") * (1 - margin)), "line-spread")
    sure = F.col("est") > F.col("need") * (1 + margin)
    near = salted(spread.filter(~sure).select("a", "b"))
    exact = (ls.join(near, ["a", "b", "salt"]).select("a", "b", "need", "site").distinct()
             .groupBy("a", "b", "need").agg(F.count("*").alias("n")).filter(F.col("n") >= F.col("need")).select("a", "b"))
    return spread.filter(sure).select("a", "b").union(exact)


def removals(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, margin: float = MARGIN, lg_k: int = LG_K) -> DataFrame:
    """doc_id, th, gone: sorted positions of the lines that go, for documents that lose any."""
    ls = lines(docs, min_sites, min_chars)
    key = ["a", "b", "salt"]
    hits = saved(ls.join(salted(boilerplate(ls, margin, lg_k)), key).select("doc_id", "th", "pos", *key), "line-hits")
    rank = F.struct("doc_id", "th", "pos")
    first = hits.groupBy("a", "b").agg(F.min(rank).alias("first"))
    later = hits.join(salted(first), key).filter(rank > F.col("first"))
    return later.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, margin: float = MARGIN, lg_k: int = LG_K) -> DataFrame:
    """row (struct of all input columns), text without its boilerplate lines, n_lines, n_removed."""
    gone = removals(docs, min_sites, min_chars, margin, lg_k).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "gone")
    d = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    j = d.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    ls = F.split("text", "\n")
    # runs between removed positions: linear in lines and removals
    at = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size(ls)))
    kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda k: F.slice(
        ls, F.element_at(at, k) + 2, F.element_at(at, k + 1) - F.element_at(at, k) - 1)))
    return j.select("row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
                    F.coalesce(F.size(ls), F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))


def cleaned_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with their columns; text without boilerplate lines, n_chars (if there is one) to match."""
    c = cleaned(docs, **options)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("row").getField("n_chars") if "n_chars" in docs.columns else None)}
    return c.select(*[(new[n] if n in new else F.col("row").getField(n)).cast(docs.schema[n].dataType).alias(n) for n in docs.columns])


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"),
        F.greatest("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = f"""
WITH l AS (
  SELECT doc_id, xx.pos, xx.line, coalesce(source, '\\0 none') AS site
  FROM (SELECT doc_id, source, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {{'pos': i - 1, 'line': x}})) AS xx
        FROM documents WHERE text IS NOT NULL)
  WHERE length(trim(xx.line, ' ')) > 0),
b AS (SELECT line, min((doc_id, pos)) AS first FROM l GROUP BY line
      HAVING count(DISTINCT site) >= CASE WHEN length(trim(line, ' ')) >= {MIN_CHARS} THEN {MIN_SITES} ELSE {MIN_SITES * SHORT_FACTOR} END),
gone AS (SELECT l.doc_id, l.pos FROM l JOIN b USING (line) WHERE (l.doc_id, l.pos) > b.first),
g AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id),
k AS (SELECT d.doc_id, d.text, g.gone, string_split(d.text, chr(10)) AS ls FROM documents d LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN text ELSE array_to_string(
         list_transform(list_filter(range(len(ls)), lambda i: NOT list_contains(gone, i)), lambda i: ls[i + 1]), chr(10)) END) AS kept_sha256
FROM k
"""
