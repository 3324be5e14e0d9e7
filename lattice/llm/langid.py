"""Language identification by Bayesian fusion of evidence.

Evidence, for each language l: the text (naive Bayes over hashed character trigrams, its log-likelihood tempered
to at most _EFFECTIVE independent trigrams), the declared markup language, the suffix of the address and the host.
P(declared | l), P(suffix | l) and the host's prior come from one grouped aggregation each of the text's posteriors
over all rows. A host's prior is smoothed towards its domain's, a domain's towards the corpus's; a row's own
contribution is taken out of its host's counts first. One more class, "und", stands for text that no language explains (the same
for every trigram); a row is accepted if a language is likelier than it.

Languages are the labels, counted over all rows (the LANGUAGES commonest). Trigram tables are fitted on a bounded sample of texts
of each (SAMPLE, expected), all else is computed over every row. Only evidence travels: texts are scored where they lie, and rows of a hot host, suffix or declaration
find its counts by a broadcast of the few heavy keys.

Null or empty texts have no text evidence; with no other they are accepted under the commonest language, as nothing
speaks against them. Null hosts, suffixes and declarations are missing evidence. Repeated rows are scored each.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm.common import arrow_schema, given, lookup, ship, staged

SAMPLE = 500  # distinct texts of each language that the trigram tables are fitted on
LANGUAGES = 128  # classes at most: a column of 2**16 numbers each in every worker
_BITS = 16
_EFFECTIVE = 60.0
_KAPPA_HOST, _KAPPA_DOMAIN, _KAPPA_SUFFIX = 8.0, 20.0, 10.0
_UND_PRIOR = 0.01
_UND, _FLOOR = -12.0, -13.0  # log-likelihood of a trigram: in no language; in a language that never has it
_CHUNK = 1 << 20


@functools.lru_cache
def _fold() -> np.ndarray:
    """Code points to what trigrams are made of: letters in lower case, one class each for digits, spaces and the rest."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x3000):
        s = chr(c)
        low = s.lower()
        table[c] = ord(low) if s.isalpha() and len(low) == 1 else c if s.isalpha() else 1 if s.isdigit() else 2 if s.isspace() or c < 32 else 3 + c % 61 if c < 128 else 3
    return table


def _trigrams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, one after the other, and how many each has (a text is framed by spaces)."""
    counts = np.array([len(t) for t in texts])
    c = _fold()[np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), np.uint32)]
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - _BITS)
    starts = np.concatenate([[0], np.cumsum(counts + 2)[:-1]])
    keep = np.ones(len(c), bool)
    keep[starts + counts], keep[starts + counts + 1] = False, False
    return h[keep[:-2]] if len(c) > 2 else h[:0], counts


class TextModel:
    """log P(trigram | language), with the uniform class "und" last."""

    def __init__(self, langs: list[str], weights: np.ndarray):
        self.langs, self.weights = langs, weights

    @classmethod
    def of(cls, langs: list[str], counts: np.ndarray) -> TextModel:
        """From how often each trigram occurs in the sample: a row a trigram, a column a language."""
        w = np.full((1 << _BITS, len(langs) + 1), _UND, np.float32)
        n = counts + 0.02
        w[:, :-1] = np.where(counts > 0, np.maximum(np.log(n / n.sum(axis=0)), _FLOOR), _FLOOR)  # also where the sample is small
        return cls(langs, w)

    def score(self, texts: Sequence[str]) -> np.ndarray:
        """Tempered log-likelihoods, one row a text."""
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < _CHUNK):
                size += len(texts[end])
                end += 1
            h, n = _trigrams(texts[at:end])
            total = np.zeros((end - at, self.weights.shape[1]))
            full = n > 0
            if full.any():
                begin = (np.cumsum(n) - n)[full]
                for i in range(self.weights.shape[1]):  # one class at a time keeps what is gathered small
                    total[full, i] = np.add.reduceat(self.weights[:, i][h], begin, dtype=np.float64)
                total[full] *= np.minimum(1, _EFFECTIVE / n[full])[:, None]
            out.append(total)
            at = end
        return np.concatenate(out) if out else np.zeros((0, self.weights.shape[1]))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, languages: int = LANGUAGES) -> TextModel:
    """Fit on about `sample` distinct texts of each language, chosen by a hash of the text, so that copies count once.

    Which languages there are, and how many texts each has, is counted over all rows with a label and a text; of more labels than
    `languages` the commonest are classes. Trigrams are counted where the texts lie: the driver gets counts, never texts.
    """
    import pyarrow as pa

    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.select(F.col(text).alias("t"), F.lower(lang).alias("l")).where("t <> '' AND l <> ''")
    texts = rows.groupBy("l").agg(F.approx_count_distinct(F.xxhash64("t")).alias("n"))
    sizes = sorted((r[0], r[1]) for r in texts.orderBy(F.desc("n"), "l").limit(languages).collect())
    langs = [x for x, _ in sizes]
    counts = np.zeros((1 << _BITS, len(langs)))
    if not langs:
        return TextModel.of(langs, counts)
    shares = [(x, i, min(1 << 30, (sample << 30) // max(1, n))) for i, (x, n) in enumerate(sizes)]
    shares = F.broadcast(given(spark, shares, arrow_schema("l string, i int, below long")))
    chosen = rows.join(shares, "l").where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < F.col("below")).select("i", "t").distinct()

    def trigrams(batches):
        for b in batches:
            for i, t in zip(b[0].to_pylist(), b[1], strict=True):
                h, n = np.unique(_trigrams([t.as_py()])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i, np.int32)), pa.array(h.astype(np.int32)), pa.array(n.astype(np.int64))], names=["i", "h", "n"])

    found = chosen.mapInArrow(trigrams, "i int, h int, n long").groupBy("i", "h").agg(F.sum("n").alias("n")).toArrow()
    i, h, n = (found[c].to_numpy() for c in ("i", "h", "n"))
    counts[h, i] = n
    return TextModel.of(langs, counts)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\w+://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def domain_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]+\.[^.]+|[^.]+)$", 1)


def suffix_of(host: Column) -> Column:
    suffix = F.regexp_extract(host, r"\.([a-z]{2,})$", 1)
    return F.when(suffix != "", suffix)


def declared_in(html: Column) -> Column:
    tag = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return F.when(tag != "", tag)


def visible_text(html: Column) -> Column:
    """What is not markup. What is not closed runs to the end, and a tag to the next one, so no stretch is read twice."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[^<>]*>", " ")


def identify(spark: SparkSession, rows: DataFrame, model: TextModel) -> DataFrame:
    """rows: key columns, text, host, domain, suffix, declared. Result: the key columns, host, declared, text_lang, lang, confidence, accepted."""
    import pyarrow as pa

    ship(spark)
    if not model.langs:  # nothing is known about any language, so nothing speaks against a text
        named = [c for c in rows.columns if c not in ("text", "domain", "suffix")]
        und = F.lit("und")
        return rows.select(*named).select("*", und.alias("text_lang"), und.alias("lang"), F.lit(0.0).alias("confidence"), F.lit(True).alias("accepted"))
    evidence = ["text", "host", "domain", "suffix", "declared"]
    keys = [c for c in rows.columns if c not in evidence]
    langs, m = model.langs, len(model.langs)
    kept = [*keys, *evidence[1:]]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema)
    spread = spark.sparkContext.broadcast((model.langs, model.weights))  # 2**16 rows, a column a language

    def run(batches):
        own = TextModel(*spread.value)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ll = own.score(part[len(kept)].to_pylist()).astype(np.float64)
                flat = pa.array(ll.ravel())
                ends = pa.array(np.arange(0, ll.size + 1, m + 1, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*(part[i] for i in range(len(kept))), pa.ListArray.from_arrays(ends, flat)], names=[*kept, "ll"])

    scored = rows.select(*kept, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"{fields}, ll array<double>")
    scored = staged(spark, scored, "langid-scored")

    # The text's posterior under even priors: what a row adds to the counts of its host, suffix and declaration.
    top = F.array_max("ll")
    e = F.transform("ll", lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    scored = scored.withColumn("p", F.when(F.size("ll") > 0, F.transform(e, lambda x: x / total)))
    sums = lambda name: F.array(*[F.sum(F.col("p")[i]) for i in range(m)]).alias(name)
    n = F.count(F.lit(1)).alias("n")

    def counted(column: str, *more: Column) -> DataFrame:
        return staged(spark, scored.where(F.col(column).isNotNull()).groupBy(column).agg(sums("c"), n, *more), f"langid-{column}")

    hosts = counted("host", F.first("domain").alias("domain"))
    whole = scored.agg(sums("c")).first()[0]
    whole = [float(x or 0.0) + 1.0 for x in whole]
    base = [x / sum(whole) for x in whole]

    def smoothed(counts: Column, parent: Column, kappa: float) -> Column:
        size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, parent, lambda c, q: (c + kappa * q) / (size + kappa))

    vector = F.array(*[F.lit(x) for x in base])
    domains = hosts.where(F.col("domain").isNotNull()).groupBy("domain").agg(F.array(*[F.sum(F.col("c")[i]) for i in range(m)]).alias("dc"), F.count(F.lit(1)).alias("dn"))
    domains = staged(spark, domains.withColumn("dp", smoothed(F.col("dc"), vector, _KAPPA_DOMAIN)).select("domain", "dp", "dn"), "langid-domains")
    priors = staged(spark, lookup(hosts, domains, "domain", "dn").select("host", F.col("c").alias("host_c"), F.coalesce("dp", vector).alias("host_parent"), F.col("n").alias("host_n")), "langid-hosts")

    def likelihoods(column: str) -> DataFrame:
        """P(value | language), smoothed, and how many rows have the value."""
        counts = counted(column)
        sizes = counts.agg(*[F.sum(F.col("c")[i]) for i in range(m)], F.count(F.lit(1))).first()
        kinds = (sizes[m] or 0) + 1
        p = F.array(*[F.ln((F.col("c")[i] + F.lit(_KAPPA_SUFFIX / kinds)) / F.lit(float(sizes[i] or 0.0) + _KAPPA_SUFFIX)) for i in range(m)])
        return staged(spark, counts.select(column, p.alias(f"{column}_ll"), F.col("n").alias(f"{column}_n")), f"langid-p-{column}")

    found = lookup(scored, priors, "host", "host_n")
    for column in ("suffix", "declared"):
        found = lookup(found, likelihoods(column), column, f"{column}_n")

    own = F.zip_with(F.col("host_c"), F.slice("p", 1, m), lambda c, q: F.greatest(c - q, F.lit(0.0)))
    prior = F.when(F.col("host_c").isNotNull(), smoothed(own, F.col("host_parent"), _KAPPA_HOST)).otherwise(vector)
    none = F.array_repeat(F.lit(0.0), m)
    extra = lambda c: F.coalesce(F.col(f"{c}_ll"), none)
    # A value seen under every language alike says nothing: evidence counts against the mean of the languages.
    level = lambda v: F.transform(v, lambda x: x - F.aggregate(v, F.lit(0.0), lambda a, y: a + y) / F.lit(float(m)))
    parts = found.withColumn("prior", prior).withColumn("s", level(extra("suffix"))).withColumn("d", level(extra("declared")))
    logs = [F.ln(F.col("prior")[i]) + F.lit(float(np.log(1 - _UND_PRIOR))) + F.col("ll")[i] + F.col("s")[i] + F.col("d")[i] for i in range(m)]
    parts = parts.withColumn("post", F.array(*logs, F.lit(float(np.log(_UND_PRIOR))) + F.col("ll")[m]))
    best = F.array_max("post")
    at = F.array_position("post", best).cast("int")
    names = F.array(*[F.lit(x) for x in [*langs, "und"]])
    mass = F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    text_best = F.element_at(names, F.array_position("ll", F.array_max("ll")).cast("int"))
    return parts.select(*keys, "host", "declared", F.when(F.array_max("ll") < 0, text_best).alias("text_lang"), F.element_at(names, at).alias("lang"), F.round(1 / mass, 6).alias("confidence"), (at <= m).alias("accepted"))


def page_rows(pages: DataFrame) -> DataFrame:
    host = host_of(F.col("url"))
    return pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), visible_text(F.col("html")).alias("text"), host.alias("host"), domain_of(host).alias("domain"), suffix_of(host).alias("suffix"), declared_in(F.col("html")).alias("declared"))


def document_rows(docs: DataFrame, *keys: Column) -> DataFrame:
    """Documents have a source, which stands for the host, and no markup or address."""
    none = F.lit(None).cast("string")
    return docs.select(*keys, "text", F.col("source").alias("host"), none.alias("domain"), none.alias("suffix"), F.lower("lang").alias("declared"))


def accepted(spark: SparkSession, docs: DataFrame, model: TextModel) -> DataFrame:
    """The documents, all columns, without those that no language explains.

    Documents are told apart by 128 bits of their content. The rejected keys are staged; where they are few, Spark
    broadcasts them, else it joins by shuffle.
    """
    content = ("doc_id", "text", "lang", "source")
    keys = F.xxhash64(*content), F.xxhash64(F.lit("second"), *content)
    decided = identify(spark, document_rows(docs, keys[0].alias("key"), keys[1].alias("key2")), model)
    rejected = decided.where(~F.col("accepted")).select(F.col("key").alias("__rejected"), F.col("key2").alias("__rejected2")).distinct()
    rejected = staged(spark, rejected, "langid-rejected")
    return docs.join(rejected, (keys[0] == F.col("__rejected")) & (keys[1] == F.col("__rejected2")), "left_anti")
