"""Language identification by Bayesian evidence fusion.

The posterior of a row's language multiplies

* the likelihood of its text under byte-trigram models, one for every language that any row is labelled
  with, fitted on some ``TRAIN_ROWS`` texts dealt evenly over the languages, ``LEAST_ROWS`` of each at least
  or all it has (``TRAIN_CHARS`` characters of each text); the log-likelihood is tempered, since
  neighbouring trigrams repeat each other;
* the likelihood of the language its markup declares (a confusion table over all rows);
* the likelihood of its address suffix (per suffix, smoothed towards all suffixes);
* a prior of its host, smoothed towards its domain and that towards all rows. A row's own vote is
  taken out of its host's counts, so a host of one page says nothing about that page.

All tables are sums of the rows' text posteriors, grouped before they are shuffled, over all rows.
Missing evidence counts as 1. A row is rejected if its text has no letter or no language reaches
``LEAST``.

Defined results: a null or empty text has no letters and is rejected, whatever else is declared;
null host, address or declared language are missing evidence; equal rows are judged alike; an empty
table gives an empty result; a host with a third of all rows is split by the skew join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from caselake.llm.arrow import released, slices, texts, unused
from caselake.session import materialise

TRAIN_ROWS, LEAST_ROWS, TRAIN_CHARS = 4000, 250, 2000
SLOTS = 1 << 18
TEMPER = 0.25
SMOOTHING = 5.0
LEAST = 0.5
CHUNK_BYTES = 1 << 22
LETTER = re.compile(r"[^\W\d_]")


def slots(data: bytes) -> np.ndarray:
    """A table slot for each byte trigram."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    grams = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((grams * np.uint32(0x9E3779B1)) >> np.uint32(14)).astype(np.int64)


def folded(text: str) -> bytes:
    """Lower case, single spaces, one at either end."""
    return b" " + b" ".join(text.lower().encode().split()) + b" "


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the log-probability of each trigram slot in them.

    Which languages there are is counted over all rows. Texts are drawn by a hash, so the sample doesn't
    follow the order of files, in a share of each language; a language's equal rows are drawn once.
    """
    labelled = docs.where("lang IS NOT NULL AND length(trim(text)) > 0").select(
        "lang", F.substring("text", 1, TRAIN_CHARS).alias("said"), F.xxhash64("doc_id", "text").alias("draw"))
    held = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(held) or ["und"]
    most = max(LEAST_ROWS, TRAIN_ROWS // len(langs))
    share = docs.sparkSession.createDataFrame([(g, int(min(1.0, most / n) * (1 << 30))) for g, n in held.items()], "lang string, share long")
    rows = labelled.join(F.broadcast(share), "lang").where(F.pmod("draw", F.lit(1 << 30)) < F.col("share")) \
        .dropDuplicates(["lang", "draw"]).select("lang", "said").collect()
    missed = set(held) - {r.lang for r in rows}
    if missed:  # many rows, all of them equal, with a hash beyond the share: one text of each
        rows += labelled.where(F.col("lang").isin(*missed)).groupBy("lang").agg(F.min("said").alias("said")).collect()
    counts = np.full((SLOTS, len(langs)), 0.05, np.float64)
    for i, lang in enumerate(langs):
        data = b"".join(folded(r.said) for r in rows if r.lang == lang)
        counts[:, i] += np.bincount(slots(data), minlength=SLOTS)
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def text_posteriors(rows: DataFrame, model: tuple[list[str], np.ndarray], keys: list[str]) -> DataFrame:
    """``keys`` of every row, its tempered log-likelihoods and its text posterior (null without letters)."""
    langs, table = model
    sent = rows.sparkSession.sparkContext.broadcast(table)  # SLOTS by the number of languages, whatever the input
    numbers = ArrayType(DoubleType())
    out = StructType([rows.schema[k] for k in keys] + [StructField("loglik", numbers), StructField("votes", numbers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            logs = []
            lettered = []
            for text in texts(batch.column("text")):
                data, total = folded(text), np.zeros(len(langs))
                for at in range(0, len(data), CHUNK_BYTES):  # chunks share two bytes: every trigram counts once
                    total += sent.value[slots(data[at:at + CHUNK_BYTES + 2])].sum(axis=0, dtype=np.float64)
                logs.append(total * TEMPER)
                lettered.append(bool(LETTER.search(text)))
            l = np.array(logs).reshape(-1, len(langs))
            p = np.exp(l - l.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keys] + [pa.array(l.tolist(), pa.list_(pa.float64())),
                 pa.array([v if ok else None for v, ok in zip(p.tolist(), lettered)], pa.list_(pa.float64()))],
                names=out.names)

    return rows.select(*keys, "text").mapInArrow(released(run), out)


def host_of(url: Column) -> Column:
    """The host name of an address; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels of a host name."""
    return F.regexp_extract(host, r"([^.]*\.?[^.]+)\.?$", 1)


def suffix_of(host: Column) -> Column:
    """The last label of a host name that has several."""
    return F.nullif(F.regexp_extract(host, r"\.([A-Za-z]{2,63})\.?$", 1), F.lit(""))


def declared_of(html: Column) -> Column:
    """The primary subtag of the language a page's markup declares."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})\b", 1)), F.lit(""))


def _summed(votes: DataFrame, by: str, n: int, name: str) -> DataFrame:
    """Votes per value of ``by`` as one array; grouped in the tasks before anything is shuffled."""
    sums = votes.where(F.col(by).isNotNull() & F.col("votes").isNotNull()).groupBy(by).agg(
        *[F.sum(F.col("votes")[i]).alias(f"v{i}") for i in range(n)])
    return sums.select(by, F.array(*[f"v{i}" for i in range(n)]).alias(name))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], keys: list[str]) -> DataFrame:
    """``keys`` plus lang, posterior, text_lang and kept for every row.

    ``rows`` has text, declared, host, domain and suffix (any of them null) beside the keys.
    """
    langs, _ = model
    n = len(langs)
    evidence = ["declared", "host", "domain", "suffix"]
    own = [k for k in keys if k not in evidence]
    base = materialise(text_posteriors(rows, model, own + evidence), "language")
    host = _summed(base, "host", n, "host_votes")
    domains = _summed(base, "domain", n, "domain_votes")
    suffixes = _summed(base, "suffix", n, "suffix_votes")
    # A declared language is one of the known ones or another: a table of n + 1 by n numbers.
    known = F.when(F.col("declared").isin(langs), F.col("declared")).when(F.col("declared").isNotNull(), "?")
    said = {r["known"]: np.array(r["v"]) for r in _summed(base.withColumn("known", known), "known", n, "v").collect()}
    totals = base.where("votes IS NOT NULL").agg(*[F.sum(F.col("votes")[i]) for i in range(n)]).first()
    total = np.array([v or 0.0 for v in totals])
    joined = base.join(host, "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
    confusion = np.array([said.get(d, np.zeros(n)) for d in [*langs, "?"]]) + 1.0
    confusion = np.log(confusion / confusion.sum(axis=0))
    prior = (total + 1.0) / (total.sum() + n)
    out = StructType([rows.schema[k] for k in keys] + [
        StructField("detected", StringType()), StructField("posterior", DoubleType()),
        StructField("text_lang", StringType()), StructField("kept", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            def table(name: str) -> np.ndarray:
                return np.array([v if v is not None else [0.0] * n for v in batch.column(name).to_pylist()]).reshape(-1, n)

            votes = table("votes")
            has = {c: np.array([v is not None for v in batch.column(c).to_pylist()]).reshape(-1, 1)
                   for c in ("host", "domain", "suffix", "votes")}
            others = total - votes
            general = (others + 1.0) / (others.sum(axis=1, keepdims=True) + n)
            domain = np.maximum(table("domain_votes") - votes * has["domain"], 0.0)
            p = (domain + SMOOTHING * general) / (domain.sum(axis=1, keepdims=True) + SMOOTHING)
            hosts = np.maximum(table("host_votes") - votes * has["host"], 0.0)
            p = (hosts + SMOOTHING * p) / (hosts.sum(axis=1, keepdims=True) + SMOOTHING)
            suffix = np.maximum(table("suffix_votes") - votes * has["suffix"], 0.0)
            share = suffix.sum(axis=1, keepdims=True) / max(total.sum(), 1.0)
            # P(suffix | language), smoothed towards the suffix's share of all rows
            given = (suffix + SMOOTHING * share) / (others + SMOOTHING)
            log = table("loglik") + np.log(p) + np.where(has["suffix"] & (share > 0), np.log(np.maximum(given, 1e-12)), 0.0)
            rows_of = {d: i for i, d in enumerate(langs)}
            for i, d in enumerate(batch.column("declared").to_pylist()):
                if d is not None:
                    log[i] += confusion[rows_of.get(d, n)]
            post = np.exp(log - log.max(axis=1, keepdims=True))
            post /= post.sum(axis=1, keepdims=True)
            best = post.argmax(axis=1)
            top = post[np.arange(len(best)), best]
            lettered = has["votes"][:, 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keys] + [
                    pa.array([langs[b] if ok else None for b, ok in zip(best, lettered)], pa.string()),
                    pa.array([round(float(t), 6) if ok else None for t, ok in zip(top, lettered)], pa.float64()),
                    pa.array([langs[b] if ok else None for b, ok in zip(votes.argmax(axis=1), lettered)], pa.string()),
                    pa.array([bool(ok and t >= LEAST) for t, ok in zip(top, lettered)], pa.bool_())],
                names=out.names)

    columns = list(dict.fromkeys([*keys, "declared", "host", "domain", "suffix", "loglik", "votes", "host_votes",
                                  "domain_votes", "suffix_votes"]))
    return joined.select(*columns).mapInArrow(released(run), out)


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents with their evidence: their lang column is what was declared, and the source is the host."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", "text", lang.alias("declared"), source.alias("host"), domain_of(source).alias("domain"),
                       suffix_of(source).alias("suffix"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages with their evidence; markup is taken out of the text by a plain rule, good enough for trigrams."""
    host = host_of(F.col("url"))
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    return pages.select("page_id", bare.alias("text"), declared_of(F.col("html")).alias("declared"), host.alias("host"),
                        domain_of(host).alias("domain"), suffix_of(host).alias("suffix"))


def known_language(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """The documents that are not rejected, with the columns they had.

    Verdicts are worked out on narrow rows; only the rejected ones, written with a known size, meet
    the texts again. A row is known by its id and a hash of its text.
    """
    key = [unused(docs, "key_id"), unused(docs, "key_text")]
    keyed = docs.withColumn(key[0], F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) \
        .withColumn(key[1], F.coalesce(F.xxhash64("text"), F.lit(0)))
    rows = document_rows(docs).withColumn(key[0], F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) \
        .withColumn(key[1], F.coalesce(F.xxhash64("text"), F.lit(0)))
    verdicts = identify(rows, model, key)
    rejected = materialise(verdicts.where(~F.col("kept")).groupBy(*key).agg(F.count("*").alias("n")).drop("n"), "rejected")
    return keyed.join(rejected, key, "left_anti").drop(*key)
