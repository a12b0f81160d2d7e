"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are combined as log odds:

* the text, by a multinomial model of hashed byte trigrams; the trigram counts per
  declared language come from one grouped aggregation over all rows,
* the declared language (a page's markup or a table's column),
* the address suffix (country-code domain),
* a prior of the host, smoothed hierarchically: host towards its parent domain,
  that towards all rows, all by grouped aggregation.

``und`` is a class of its own with uniform trigrams, so a text that no language
explains, or without evidence at all, is rejected."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
BUCKETS = 1 << 16
#: Pseudo-counts of a trigram; text evidence is tempered as trigrams overlap.
ALPHA, TEMPER = 0.01, 0.33
#: How reliable declared languages and address suffixes are taken to be.
DECLARED, SUFFIX = 0.95, 0.90
UNKNOWN_PRIOR = 0.01
HOST_WEIGHT, DOMAIN_WEIGHT = 20.0, 20.0
ACCEPT = 0.5
#: Host priors of at most so many hosts are broadcast, more are joined by shuffle.
BROADCAST_HOSTS = 50_000
#: Frequent words, as pseudo-text: what the model knows before it has seen rows.
SEEDS = {
    "de": "der die und das ist nicht mit ein eine zu den von sich auf für im dem des auch es werden aus er hat dass sie nach wird bei",
    "en": "the of and to in is that it for was on are with as be at this have from or by not but what all were when we there can",
    "es": "el la de que y en los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque",
    "fr": "le la de et les des en un du une que est pour qui dans par sur pas plus ne au ce il sont avec se son mais nous ou",
}
SUFFIX_LANGUAGE = {"de": "de", "at": "de", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "es": "es", "mx": "es", "ar": "es", "co": "es", "cl": "es", "pe": "es", "fr": "fr"}
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of every byte trigram of the lower-cased letters; others count as spaces."""
    raw = _FOLD[np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    raw = raw[keep].astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, dtype=np.int64)
    return ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)


def seed_counts() -> np.ndarray:
    out = np.zeros((len(LANGUAGES), BUCKETS))
    for i, lang in enumerate(LANGUAGES):
        out[i] = np.bincount(trigrams(SEEDS[lang]), minlength=BUCKETS)
    return out


def declared_language(c: Column) -> Column:
    """Primary subtag, lower case; null if it is no language of the model."""
    tag = F.lower(F.regexp_extract(F.trim(c.cast("string")), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(tag.isin(*LANGUAGES), tag)


def markup_language(html: Column) -> Column:
    """Value of ``lang`` in a page's html element."""
    return F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))


def domain_of(host: Column) -> Column:
    """Last two labels."""
    return F.regexp_extract(host, r"([^.]+(?:\.[^.]+)?)\.?$", 1)


def count_trigrams(rows: DataFrame) -> np.ndarray:
    """Counts per language of ``rows(text, declared)``, summed in the map tasks first;
    at most languages x buckets numbers reach the driver."""

    def run(batches):
        total = np.zeros((len(LANGUAGES), BUCKETS), dtype=np.int64)
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[LANGUAGES.index(lang)] += np.bincount(trigrams(text), minlength=BUCKETS)
        lang, bucket = np.nonzero(total)
        for i in range(0, len(lang), 20_000):
            part = lang[i : i + 20_000], bucket[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int32()), pa.array(total[part], pa.int64())], names=["l", "b", "n"])

    out = np.zeros((len(LANGUAGES), BUCKETS))
    for r in shared.map_batches(rows.where("declared IS NOT NULL"), run, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).collect():
        out[r["l"], r["b"]] = r["n"]
    return out


def log_likelihoods(counts: np.ndarray) -> np.ndarray:
    """Bucket x class, the last class uniform."""
    smooth = counts + seed_counts() + ALPHA
    table = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    return np.vstack([table, np.full(BUCKETS, -math.log(BUCKETS))]).T.astype(np.float32)


def identify(
    docs: DataFrame,
    text_col: str = "text",
    declared: Column | None = None,
    host: Column | None = None,
    suffix_host: Column | None = None,
) -> DataFrame:
    """``row, language, posterior, accepted, declared`` for every row of ``docs``
    (``row`` holds all its columns, see ``shared.annotate``).

    ``declared``, ``host`` and ``suffix_host`` are expressions over ``docs`` for the
    declared language, the host whose prior counts and the address with a suffix.
    A row is accepted if the best language has a posterior of ``ACCEPT`` or more.

    Nulls: missing evidence (null or empty) is no evidence; a text without letters
    has none of its own and is rejected, as language ``und``.  Ties go to the first
    language in alphabetical order.  Very long texts count whole.  Repeated rows get
    equal results; an empty table gives no rows; names of columns cannot clash."""
    spark = docs.sparkSession
    none = F.lit(None).cast("string")
    names = [f"c{i}" for i in range(len(docs.columns))]
    given = docs.select(
        F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)]).alias("row"),
        declared_language(declared if declared is not None else none).alias("declared"),
        F.coalesce(host.cast("string") if host is not None else none, F.lit("")).alias("host"),
        F.coalesce(F.lower(F.regexp_extract(suffix_host, r"\.([A-Za-z]{2})\.?$", 1)) if suffix_host is not None else none, F.lit("")).alias("suffix"),
    )
    at = docs.columns.index(text_col)
    counts = count_trigrams(given.select(F.col(f"row.c{at}").cast("string").alias("text"), "declared"))
    model = spark.sparkContext.broadcast(log_likelihoods(counts))  # BUCKETS x classes

    def run(batches):
        for b in batches:
            found = []
            for text in b.column(0).field(at).to_pylist():
                index = trigrams(text)
                per = model.value[index].sum(axis=0, dtype=np.float64) if len(index) else np.zeros(len(LANGUAGES) + 1)
                found.append((per * TEMPER).tolist() if len(index) else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.float64()))], names=["row", "declared", "host", "suffix", "text_ll"])

    kind = given.schema["row"].dataType.simpleString()
    seen = shared.map_batches(given, run, f"row {kind}, declared string, host string, suffix string, text_ll array<double>")
    prior = host_priors(given.select("host", "declared"))
    if prior.count() <= BROADCAST_HOSTS:
        with_prior = seen.join(F.broadcast(prior), "host", "left")
    else:  # rows of a large host, and those of none, are dealt over tasks by what they hold
        told_apart = [f"row.c{i}" for i, f in enumerate(docs.schema) if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
        sizes = shared.checkpoint(given.groupBy("host").agg(F.count("*").alias("rows")))
        with_prior = shared.join_unique(seen, shared.checkpoint(prior), ["host"], sizes, told_apart, "left")
    classes = [*LANGUAGES, UNKNOWN]
    spread = len(LANGUAGES) - 1

    def told(value: Column, lang: str, right: float) -> Column:
        if lang == UNKNOWN:
            return F.when(value.isNull(), F.lit(0.0)).otherwise(math.log(1 / len(LANGUAGES)))
        return F.when(value.isNull(), F.lit(0.0)).when(value == lang, math.log(right)).otherwise(math.log((1 - right) / spread))

    by_suffix = F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv])
    points = with_prior.withColumn("sl", F.element_at(by_suffix, F.col("suffix")))
    scores = F.array(*[
        F.coalesce(F.element_at("text_ll", i + 1), F.lit(0.0))
        + told(F.col("declared"), lang, DECLARED)
        + told(F.col("sl"), lang, SUFFIX)
        + (F.lit(math.log(UNKNOWN_PRIOR)) if lang == UNKNOWN else F.log(F.lit(1 - UNKNOWN_PRIOR) * F.coalesce(F.element_at("prior", i + 1), F.lit(1 / len(LANGUAGES)))))
        for i, lang in enumerate(classes)
    ])
    points = points.withColumn("s", scores).withColumn("top", F.array_max("s"))
    points = points.withColumn("z", F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    best = F.when(F.col("text_ll").isNull(), UNKNOWN).otherwise(F.element_at(F.array(*map(F.lit, classes)), F.array_position("s", F.col("top")).cast("int")))
    points = points.select("row", best.alias("language"), F.when(F.col("text_ll").isNull(), 0.0).otherwise(1 / F.col("z")).alias("posterior"), "declared")
    return points.select("row", "language", "posterior", ((F.col("language") != UNKNOWN) & (F.col("posterior") >= ACCEPT)).alias("accepted"), "declared")


def host_priors(rows: DataFrame) -> DataFrame:
    """``(host, prior)``: per host the share of each language among declared rows,
    smoothed towards the parent domain's, which is smoothed towards that of all."""
    n = [F.sum(F.when(F.col("declared") == x, 1.0).otherwise(0.0)).alias(f"n{i}") for i, x in enumerate(LANGUAGES)]
    hosts = rows.where("host <> ''").groupBy("host").agg(*n).withColumn("domain", domain_of(F.col("host")))
    sums = [F.sum(f"n{i}").alias(f"d{i}") for i in range(len(LANGUAGES))]
    domains = hosts.groupBy("domain").agg(*sums)
    every = hosts.agg(*[F.sum(f"n{i}").alias(f"a{i}") for i in range(len(LANGUAGES))]).first()
    total = sum(x or 0.0 for x in every)
    base = [((x or 0.0) + 1) / (total + len(LANGUAGES)) for x in every]
    dn = sum((F.col(f"d{i}") for i in range(1, len(LANGUAGES))), F.col("d0"))
    hn = sum((F.col(f"n{i}") for i in range(1, len(LANGUAGES))), F.col("n0"))
    joined = hosts.join(domains, "domain")
    domain = [(F.col(f"d{i}") + DOMAIN_WEIGHT * b) / (dn + DOMAIN_WEIGHT) for i, b in enumerate(base)]
    return joined.select("host", F.array(*[(F.col(f"n{i}") + HOST_WEIGHT * d) / (hn + HOST_WEIGHT) for i, d in enumerate(domain)]).alias("prior"))


def identify_pages(pages: DataFrame, text_col: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``identify`` with a page's own evidence: markup language, host and suffix."""
    host = host_of(F.col(url_col))
    return identify(pages, text_col, markup_language(F.col(html_col)), host, host)


def identify_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``identify`` for documents: declared language and source where there are such
    columns; the source stands for the host, and for the suffix if it is an address."""
    lang = F.col(lang_col) if lang_col in docs.columns else None
    source = F.col(source_col) if source_col in docs.columns else None
    return identify(docs, text_col, lang, source, source)
