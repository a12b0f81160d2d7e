"""Ranked lexical search: the best documents for each item by a BM25 in whole numbers.

Postings ``(term, rid, t, top)`` are a stored DataFrame bucketed by term, frequent terms
dealt over several buckets, t being the share of the score that a term of weight one
gives the document.  Item terms are joined to them, each match is scored, and matches
are summed per item and document.

Summing every match of ``the`` would cost items times documents, so a safe bound comes
first.  Per item, a few documents that do well on its rare terms are scored whole; the
k-th of their scores is a floor under the k-th best of all.  The item's most frequent
terms whose largest possible sum stays below the floor cannot lift a document into the
result by themselves; only the *essential* others are joined.  Of what they find, the
documents that could reach the floor are scored whole.  The result is that of summing
everything."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: ASCII other than letters and digits separates terms, A-Z become a-z; all else stays.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Terms or item terms of no more rows than this are broadcast.
BROADCAST_ROWS = 1_000_000
#: A term of more postings than this is dealt over several buckets.
BUCKET_ROWS = 20_000
#: Documents scored whole first are found by terms that at most 1 in so many documents hold.
RARE = 32


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def term_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: frozenset[bytes] | None = None) -> DataFrame:
    """``(id, n, terms, tfs)`` per row: its number of terms, and its different terms (of
    ``vocabulary``, if one is given) with their counts."""
    known = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        want = known.value
        for b in batches:
            n, ends, terms, tfs = [], [0], [], []
            for text in b.column(1).to_pylist():
                words = terms_of(text)
                n.append(len(words))
                found = Counter(words)
                some = found.keys() if want is None else found.keys() & want
                terms.extend(some)
                tfs.extend(map(found.__getitem__, some))
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    return shared.map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")), run, "id long, n long, terms array<string>, tfs array<long>")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _impact(tf: str) -> str:
    return f"(1000000000 * {tf}) div (1000 * {tf} + 20 * m)"


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(item_id, rank, id, score)``: each item's ``k`` best rows of ``docs``.

    Nulls: a null text has no terms, so it is neither ranked nor counted; null ids are
    carried and come first among equal scores; rows of a null item are one item.  Rows of
    one item id are one item of all their terms.  Empty and very long texts are taken
    whole.  Equal scores rank by ascending id; repeated rows rank one after the other.
    Empty tables give no rows.  Other columns are ignored, whatever their names."""
    asked = term_counts(items, item_col, item_text_col).select(F.col("id").alias("item"), F.explode("terms").alias("term")).distinct()
    asked = shared.materialise(asked, "item-terms")
    terms = asked.select("term").distinct()
    vocabulary = None
    if terms.count() <= BROADCAST_ROWS:
        vocabulary = frozenset(r["term"].encode() for r in terms.collect())  # bounded by the line above
    forward = shared.materialise(term_counts(docs, id_col, text_col, vocabulary).withColumn("rid", F.monotonically_increasing_id()), "term-counts")
    total = forward.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    forward = forward.withColumn("m", F.expr(f"50 + cast((cast(50 * n AS DECIMAL(20,0)) * {total['docs']}BD) div {max(1, total['terms'])}BD AS LONG)"))

    posting = forward.select("rid", "m", F.expr(_impact("array_max(tfs)")).alias("top"), F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    posting = posting.select("rid", F.col("p.terms").alias("term"), F.expr(_impact("p.tfs")).alias("t"), "top")
    if vocabulary is None:
        posting = posting.join(terms, "term", "left_semi")
    stats = shared.materialise(posting.groupBy("term").agg(F.count("*").alias("df"), F.max("t").alias("most")), "term-stats")
    weight = F.floor(1000 * F.log((F.lit(2 * total["docs"] + 2).cast("double")) / (2 * F.col("df") + 1))).cast("long")
    query = shared.materialise(asked.join(stats, "term").withColumn("w", weight), "query")
    known = shared.join_unique(posting, stats.select("term", "df"), ["term"], stats.select("term", F.col("df").alias("rows")), ["rid"])
    dealt = known.select("term", "rid", "t", "top", F.pmod(F.xxhash64("rid"), F.ceil(F.col("df") / BUCKET_ROWS)).alias("part"))
    postings = shared.materialise(dealt.repartition("term", "part").sortWithinPartitions("term").drop("part"), "postings")

    seeds = _summed(postings, query.where(F.col("df") * RARE <= total["docs"]))
    hot = query.where(F.col("df") * RARE > total["docs"]).groupBy("item").agg(F.sum("w").alias("hot"))
    seeds = seeds.join(_small(hot), seeds["item"].eqNullSafe(hot["item"]), "left").select(seeds["item"], "rid", (F.col("s") + F.col("top") * F.coalesce("hot", F.lit(0))).alias("s"))
    first = Window.partitionBy("item").orderBy(F.desc("s"), "rid")
    seeds = seeds.withColumn("r", F.row_number().over(first)).where(F.col("r") <= 2 * k).select("item", "rid")
    whole = _whole(forward, seeds, query)
    last = Window.partitionBy("item").orderBy(F.desc("score"), "rid")
    floor = whole.withColumn("r", F.row_number().over(last)).where(F.col("r") <= k).where(F.col("r") == k).select("item", F.col("score").alias("floor"))
    floor = shared.materialise(floor, "floors")  # items of fewer seeds have none: all their terms are essential

    down = Window.partitionBy("item").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = query.join(_small(floor), query["item"].eqNullSafe(floor["item"]), "left").select(query["*"], F.coalesce("floor", F.lit(0)).alias("floor"))
    split = split.withColumn("essential", F.sum(F.col("w") * F.col("most")).over(down) >= F.col("floor"))
    split = shared.materialise(split, "essential")
    rest = split.groupBy("item").agg(
        F.max("floor").alias("floor"), F.coalesce(F.sum(F.when(~F.col("essential"), F.col("w"))), F.lit(0)).alias("rest_w"), F.coalesce(F.sum(F.when(~F.col("essential"), F.col("w") * F.col("most"))), F.lit(0)).alias("rest")
    )
    near = _summed(postings, split.where("essential").select("item", "term", "w"))
    near = near.join(_small(rest), near["item"].eqNullSafe(rest["item"])).where("s + least(rest, top * rest_w) >= floor").select(near["item"], "rid")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id"), "rid")
    ranked = _whole(forward, near, query).where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), "id", "score")


def _summed(postings: DataFrame, query: DataFrame) -> DataFrame:
    """``(item, rid, s, top)``: scores of the matches of ``query``'s terms, summed."""
    found = postings.join(_small(query.select("item", "term", "w")), "term")
    return found.groupBy("item", "rid").agg(F.sum(F.col("w") * F.col("t")).alias("s"), F.max("top").alias("top"))


def _whole(forward: DataFrame, pairs: DataFrame, query: DataFrame) -> DataFrame:
    """``(item, rid, id, score)`` of the pairs ``(item, rid)``, over all terms of the item."""
    rows = forward.join(pairs, "rid").select("item", "rid", "id", "m", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("item", "rid", "id", F.col("p.terms").alias("term"), F.expr(_impact("p.tfs")).alias("t"))
    query = query.select(F.col("item").alias("item_"), F.col("term").alias("term_"), "w")
    found = rows.join(_small(query), F.col("item").eqNullSafe(F.col("item_")) & (F.col("term") == F.col("term_")))
    return found.groupBy("item", "rid", "id").agg(F.sum(F.col("w") * F.col("t")).alias("score"))


#: DuckDB SQL of the query: every match summed.
ORACLE_SQL = r"""
WITH dt AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
total AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM dt),
it AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(k) AS k FROM (SELECT doc_id, len(w) AS k, unnest(w) AS term FROM dt) GROUP BY doc_id, term),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
weight AS (SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM it JOIN freq USING (term), total),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * k * n) // l))))) AS BIGINT) AS score
    FROM weight JOIN post USING (term), total GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scores WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 50
"""
