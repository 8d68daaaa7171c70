"""Language identification by Bayesian fusion of text, declared language, address suffix and host priors.

Text: log likelihood of letter trigrams under each language, trained here on a bounded sample (about ``TRAIN_ROWS`` rows of each declared
language with ``LEAST_ROWS`` or more, by hashed ids); the mean over the whole text counts as ``EVIDENCE`` trigrams at most, so no text outweighs everything by length alone.
Declared markup language and address suffix: their shares among texts of each language, by grouped aggregation over all rows, smoothed. Host
prior: the host's own shares of languages, smoothed with its suffix's, those with the corpus's (a hierarchy of Dirichlet means),
also by grouped aggregation. A row's own text is left out of all these counts, so what it says enters once. The posterior is the normalised product, where text in none of the languages (uniform trigrams, prior ``OTHER``) takes part; a page is accepted if it holds letters and its
best language has at least ``ACCEPT``.

A row's text is read once; what is shuffled are counts per (host, language), combined before, so a host with a third of all rows is no burden.
Host tables are broadcast only up to ``BROADCAST_HOSTS`` rows. Defined results: null and empty texts, and texts without letters, have no text
evidence and aren't accepted; null or unknown declared languages, suffixes and hosts are no evidence; repeated rows are judged each;
without any declared language nothing can be learned and no row is accepted; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, materialize, read_table, small_batches

#: Rows (about) of each declared language that are trained on, and rows in all that a declared language needs to be learned.
TRAIN_ROWS, SLOTS, LEAST_ROWS = 8_000, 1 << 15, 2
EVIDENCE, SMOOTH, HOST_WEIGHT, SUFFIX_WEIGHT, ACCEPT = 200, 0.5, 20.0, 50.0, 0.5
#: Prior of a text in none of the languages, whose trigrams are as likely in each slot.
OTHER = 0.01
BROADCAST_HOSTS = 500_000

_ALPHA: list[np.ndarray] = []


def trigrams(text: str | None) -> np.ndarray:
    """Slots of the trigrams around each letter; what isn't a letter counts as a space."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    code = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "replace"), "<u4")
    letter = _ALPHA[0][code]
    code = np.where(letter, code, 32).astype(np.uint64)
    mixed = code[:-2] * np.uint64(0x9E3779B1) + code[1:-1] * np.uint64(0x85EBCA77) + code[2:] * np.uint64(0xC2B2AE3D)
    mixed = mixed[letter[1:-1]]
    return (((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & np.uint64(SLOTS - 1)).astype(np.int64)


def fit_text(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (slot by language) from (text, declared), a bounded sample."""
    small_batches(sample.sparkSession)
    languages = sorted(r["declared"] for r in sample.select("declared").distinct().collect())
    if not languages:
        return [], np.zeros((SLOTS, 0))

    def count(batches):
        sums = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + np.bincount(trigrams(text), minlength=SLOTS)
        for lang, n in sums.items():
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([number[lang]] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "at", "n"])

    number = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((SLOTS, len(languages)))
    found = sample.select("text", "declared").mapInArrow(count, "lang int, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    lang, at, n = (c.to_numpy() for c in found.columns)  # at most slots x languages
    counts[at, lang] = n
    return languages, np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * SLOTS))


def text_scores(rows: DataFrame, languages: list[str], table: np.ndarray, kept: list[str]) -> DataFrame:
    """rows' kept columns with letters (their number), scores (by language) and text_lang."""
    sent = rows.sparkSession.sparkContext.broadcast(table.astype(np.float32))
    width = len(languages)

    def run(batches):
        let_go()
        own = sent.value
        for batch in batches:
            letters, scores, best = [], [], []
            for text in batch.column(len(kept)).to_pylist():
                at = trigrams(text)
                total = np.zeros(width)
                for k in range(0, len(at), 1 << 16):
                    total += own[at[k : k + (1 << 16)]].sum(axis=0, dtype=np.float64)
                score = total * (min(len(at), EVIDENCE) / max(1, len(at)))
                letters.append(len(at)), scores.append(score), best.append(languages[int(score.argmax())] if len(at) else None)
            columns = [*batch.columns[: len(kept)], pa.array(letters, pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array(best, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "letters", "scores", "text_lang"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*kept).dtypes)
    return rows.select(*kept, "text").mapInArrow(run, f"{schema}, letters long, scores array<double>, text_lang string")


def _shares(scored: DataFrame, column: str, languages: list[str]) -> DataFrame:
    """(column, counts): texts of each language by a value, nulls left out."""
    each = [F.count_if(F.col("text_lang") == lang).cast("double") for lang in languages]
    return scored.where(F.col(column).isNotNull()).groupBy(column).agg(F.array(*each).alias("counts"))


def language_id(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | str | None = "lang",
    host: Column | str | None = "source", suffix: Column | str | None = None, train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """One row per input row: id, text_hash, lang, posterior, text_lang, accepted. suffix defaults to the host's last label, if it has several."""
    spark = docs.sparkSession
    small_batches(spark)
    as_column = lambda c: F.lit(None).cast("string") if c is None else (F.col(c) if isinstance(c, str) else c)
    hosts = as_column(host).cast("string")
    own = F.when(hosts.contains("."), F.lower(F.element_at(F.split(hosts, r"\."), -1)))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.lower(F.trim(as_column(declared).cast("string"))).alias("declared"),
        hosts.alias("host"), (own if suffix is None else as_column(suffix).cast("string")).alias("suffix"), F.col(text_col).cast("string").alias("text"),
    )
    sample = rows.where("declared <> '' AND text IS NOT NULL")
    sizes = materialize(sample.groupBy("declared").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS), "language-sizes")
    # Each language's own share of hashed rows, so that a frequent one takes no rows from others.
    drawn = F.pmod(F.xxhash64("id", "text_hash"), F.lit(1_000_000_007)) < F.lit(1_000_000_007.0 * train_rows) / F.col("n")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_HOSTS else sizes
    sample = materialize(sample.join(sizes, "declared").where((F.col("n") <= train_rows) | drawn).select("text", "declared"), "language-sample")
    languages, table = fit_text(sample)
    if not languages:
        return rows.select("id", "text_hash", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_lang"), F.lit(False).alias("accepted"))
    scored = materialize(text_scores(rows, languages, table, ["id", "text_hash", "declared", "host", "suffix"]), "language-scores")
    corpus = scored.where("text_lang IS NOT NULL").groupBy("text_lang").agg(F.count("*").alias("n")).collect()
    totals = {r["text_lang"]: float(r["n"]) for r in corpus}
    everything = sum(totals.values())
    names = F.array(*[F.lit(lang) for lang in languages])
    of_lang = F.array(*[F.lit(totals.get(lang, 0.0)) for lang in languages])
    sum_of = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    itself = F.when(F.col("text_lang").isNull(), 0.0).otherwise(1.0)
    itself_in = lambda i: F.when(F.get(names, i) == F.col("text_lang"), 1.0).otherwise(0.0)

    def shares(counts, parent, weight: float):
        """Shares of languages among others' counts, smoothed with the parent's."""
        left = F.transform(counts, lambda x, i: F.greatest(x - itself_in(i), F.lit(0.0)))
        return F.transform(left, lambda x, i: (x + F.lit(weight) * F.get(parent, i)) / (sum_of(left) + weight))

    suffixes = _shares(scored, "suffix", languages)
    of_hosts = scored.where("host IS NOT NULL").groupBy("host").agg(F.min("suffix").alias("suffix")).join(_shares(scored, "host", languages), "host")
    of_hosts = of_hosts.withColumnRenamed("counts", "host_counts").join(suffixes.withColumnRenamed("counts", "host_suffix_counts"), "suffix", "left")
    out, kinds = scored, {}
    for extra, on in ((_shares(scored, "declared", languages), "declared"), (suffixes, "suffix"), (of_hosts.drop("suffix"), "host")):
        extra = materialize(extra.withColumnRenamed("counts", f"{on}_counts"), f"language-{on}")
        kinds[on] = extra.count()
        out = out.join(F.broadcast(extra) if kinds[on] <= BROADCAST_HOSTS else extra, on, "left")
    out = out.withColumn("base", F.transform(of_lang, lambda x, i: (x - itself_in(i) + 1.0) / (F.lit(everything + len(languages)) - itself)))
    none = F.array(*[F.lit(0.0)] * len(languages))
    base = F.col("base")
    prior = shares("host_counts", F.coalesce(shares("host_suffix_counts", base, SUFFIX_WEIGHT), base), HOST_WEIGHT)

    def evidence(column: str):
        """Log probabilities of the row's value in each language."""
        log = F.transform(f"{column}_counts", lambda x, i: F.log((F.greatest(x - itself_in(i), F.lit(0.0)) + 1.0) / (F.get(of_lang, i) - itself_in(i) + F.lit(kinds[column] + 1.0))))
        return F.coalesce(log, none)

    out = out.withColumns({"declared_log": evidence("declared"), "suffix_log": evidence("suffix"), "prior": F.coalesce(prior, base)})
    total = F.transform("scores", lambda x, i: x + F.get("declared_log", i) + F.get("suffix_log", i) + F.log(F.get("prior", i)))
    # In no language: uniform trigrams, and evidence as likely as among all texts.
    among = lambda c: F.log(sum_of(F.transform(c, lambda x, i: F.exp(x) * F.get(base, i))))
    other = F.least("letters", F.lit(EVIDENCE)) * F.lit(-float(np.log(SLOTS))) + F.log(F.lit(OTHER)) + among("declared_log") + among("suffix_log")
    out = out.withColumn("log", total).withColumn("top", F.array_max("log")).withColumn("other", other)
    out = out.withColumn("lang", F.element_at(names, F.array_position("log", F.col("top")).cast("int")))
    out = out.withColumn("posterior", F.lit(1.0) / (F.exp(F.col("other") - F.col("top")) + sum_of(F.transform("log", lambda x: F.exp(x - F.col("top"))))))
    return out.select("id", "text_hash", "lang", "posterior", "text_lang", ((F.col("letters") > 0) & (F.col("posterior") >= ACCEPT)).alias("accepted"))


def page_language(pages: DataFrame) -> DataFrame:
    """language_id over raw pages: the html element's lang attribute, the host and its suffix, and the tagless text."""
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    declared = F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-z]{2,3})", 1), F.lit(""))
    rows = pages.select("page_id", text.alias("text"), declared.alias("lang"), F.nullif(F.lower(F.regexp_extract("url", r"://([^/?#:]*)", 1)), F.lit("")).alias("host"))
    return language_id(rows, "page_id", "text", "lang", "host")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id(read_table(spark, sf_dir, "documents"))
    return out.drop("text_hash").withColumnsRenamed({"id": "doc_id", "accepted": "kept"})
