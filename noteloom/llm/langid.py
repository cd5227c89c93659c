"""Language identification by Bayesian fusion of text and address evidence.

The text's likelihood is a multinomial over hashed byte trigrams, learned from texts of known
language by grouped aggregation over the whole corpus. It is fused with the language declared in
the markup, the address suffix and a prior of the page's host, all of them learned by grouped
aggregation of the pages' own text posteriors: P(declared | language), P(suffix | language), and host
priors smoothed towards their domain's, and those towards the corpus's. A page's own posterior is
taken out of its host's counts. All learned tables but the host priors have a fixed bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, row_slices, utf8

BUCKETS = 1 << 15
LANGS_BOUND = 512
TAGS = re.compile(rb"<script\b.*?(?:</script\s*>|$)|<style\b.*?(?:</style\s*>|$)|<!--.*?(?:-->|$)|<[^<>]*>|&[#\w]+;", re.S | re.I)


def grams(data: np.ndarray) -> np.ndarray:
    """Hash buckets of the byte trigrams; A-Z are lower-cased and all white space and digits are alike."""
    d = LOWER[data].astype(np.uint64)
    d[d < 64] = 32
    g = (d[:-2] << np.uint64(16)) | (d[1:-1] << np.uint64(8)) | d[2:]
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of each bucket. docs: text, lang; null languages and texts are ignored. More than LANGS_BOUND languages are an error."""
    src = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in row_slices(batch, "text"):
                offsets, data = utf8(part.column(1))
                if len(data) < 3:
                    continue
                langs = part.column(0).dictionary_encode()
                code = langs.indices.to_numpy(zero_copy_only=False)
                g = grams(data)
                row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                inside = row[:-2] == row[2:]  # no trigram runs from one text into the next
                g, owner = g[inside], code[row[:-2][inside]]
                for k, name in enumerate(langs.dictionary.to_pylist()):
                    sums[name] = sums.get(name, 0) + np.bincount(g[owner == k], minlength=BUCKETS)
        for name, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(c[at])], names=["lang", "gram", "n"])

    n_langs = src.agg(F.count_distinct("lang")).first()[0]
    if n_langs > LANGS_BOUND:
        raise ValueError(f"{n_langs} languages, but their tables are sent to every task and hold at most {LANGS_BOUND}")
    counts = src.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counts.groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("c")).orderBy("lang").toArrow().to_pylist()  # at most LANGS_BOUND languages of BUCKETS entries
    table = np.full((len(got), BUCKETS), 0.5)
    for i, r in enumerate(got):
        for x in r["c"]:
            table[i, x["gram"]] += x["n"]
    return [r["lang"] for r in got], np.log(table / table.sum(1, keepdims=True)).astype(np.float32) if got else table


def evidence(pages: DataFrame, langs: list[str], logp: np.ndarray, temper: float) -> DataFrame:
    """page_id, url, host, domain, suffix, declared and the log-likelihood of each language (array)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1))
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    src = src.withColumn("host", host).withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    src = src.withColumn("declared", declared).select("page_id", "url", "host", "domain", "suffix", "declared", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "html", 2 << 20):
                out = []
                for x in part.column(6):
                    text = TAGS.sub(b" ", (x.as_py() or "").encode())
                    data = np.frombuffer(text, np.uint8)
                    g = grams(data) if len(data) > 2 else np.zeros(0, np.int64)
                    # Neighbouring trigrams overlap, so the sum of their logs is tempered.
                    out.append((logp[:, g].sum(1, dtype=np.float64) * temper).tolist())
                yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(out, pa.list_(pa.float64()))], names=[*part.schema.names[:6], "loglik"])

    return src.mapInArrow(run, "page_id long, url string, host string, domain string, suffix string, declared string, loglik array<double>")


def posterior(logs):
    """Normalised probabilities of an array of log weights."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, docs: DataFrame, host_weight: float = 4.0, domain_weight: float = 8.0, smooth: float = 1.0, temper: float = 0.3) -> DataFrame:
    """page_id, url, lang, probability, text_lang, declared, suffix, host for every row of ``pages`` (page_id, url, html).

    ``docs`` (text, lang) gives the languages; without any, lang is ``und`` and probability null. Null html
    or url is missing evidence and decides nothing: a page without both gets what is likeliest of all pages. A text of any length is used whole. Repeated rows each give a row and count as often. Ties go
    to the language first in alphabetical order. Other columns are ignored. An empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession)
    langs, logp = learn(docs)
    if not langs:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.lit("und").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit("und").alias("text_lang"), F.lit("").alias("declared"), F.lit("").alias("suffix"), F.lit("").alias("host"))
    L = len(langs)
    got = evidence(pages, langs, logp, temper).withColumn("p", posterior(F.col("loglik")))
    got = scratch.save("evidence", got)
    sums = [F.sum(F.get("p", F.lit(i))).alias(f"s{i}") for i in range(L)]
    whole = got.agg(*sums, F.count("*").alias("n")).first()
    prior = np.array([whole[i] or 0.0 for i in range(L)]) + smooth
    prior = (prior / prior.sum()).tolist()
    vector = lambda cols: F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in cols])
    names = [f"s{i}" for i in range(L)]

    def given(column: str) -> DataFrame:
        """log P(value | language) by value; empty values are no evidence."""
        t = got.filter(F.col(column) != "").groupBy(column).agg(*sums)
        totals = [max(whole[i] or 0.0, 0.0) for i in range(L)]
        return t.select(column, F.array(*[F.log((F.col(f"s{i}") + smooth / 2) / (totals[i] + smooth * 2)) for i in range(L)]).alias(f"log_{column}"))

    named = got.filter("host <> ''")  # pages without a host say nothing of each other
    domain = scratch.save("domain", named.groupBy("domain").agg(*sums).select("domain", vector(names).alias("d")))
    hosts = scratch.save("hosts", named.groupBy("domain", "host").agg(*sums).select("domain", "host", vector(names).alias("h")).join(domain, "domain"))
    declared, suffix = scratch.save("declared", given("declared")), scratch.save("suffix", given("suffix"))
    base = F.array(*[F.lit(x) for x in prior])
    rows = got.join(hosts.drop("domain"), "host", "left").join(declared, "declared", "left").join(suffix, "suffix", "left")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    zero = F.array(*[F.lit(0.0)] * L)
    less = lambda a: F.when(F.col(a).isNull(), zero).otherwise(F.zip_with(a, "p", lambda x, y: F.greatest(x - y, F.lit(0.0))))  # noqa: E731  without the page itself
    rows = rows.withColumn("d", less("d")).withColumn("h", less("h"))
    rows = rows.withColumn("dt", total("d")).withColumn("ht", total("h"))
    rows = rows.withColumn("dp", F.zip_with("d", base, lambda x, y: (x + domain_weight * y) / (F.col("dt") + domain_weight)))
    rows = rows.withColumn("hp", F.zip_with("h", "dp", lambda x, y: F.log((x + host_weight * y) / (F.col("ht") + host_weight))))
    parts = F.arrays_zip(F.col("loglik").alias("a"), F.col("hp").alias("b"), F.coalesce("log_declared", zero).alias("c"), F.coalesce("log_suffix", zero).alias("e"))
    rows = rows.withColumn("fused", posterior(F.transform(parts, lambda x: x["a"] + x["b"] + x["c"] + x["e"])))
    best = lambda a: F.get(F.array(*[F.lit(x) for x in langs]), (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    return rows.select("page_id", "url", best(F.col("fused")).alias("lang"), F.round(F.array_max("fused"), 6).alias("probability"), best(F.col("p")).alias("text_lang"), "declared", "suffix", "host")
