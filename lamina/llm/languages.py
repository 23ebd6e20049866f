"""Language of web pages by Bayesian fusion of evidence.

A page's log odds add up: the text's likelihood by hashed byte trigrams, the language that its markup
declares, the one its address names (a path segment or the suffix of its host), and a prior of its
host. How far a declaration or an address can be believed, and how languages are spread over hosts, is
counted on all pages by grouped aggregation with the posteriors that text alone gives. A host's prior
is smoothed with its domain's, that with its suffix's, and that with the one of all pages; the page's
own share is taken out of each of the four first, so no evidence counts twice.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import bounded_batches, slices, stored, utf8

BUCKETS = 1 << 14
MOST_LANGUAGES = 256
#: Neighbouring trigrams repeat each other's evidence; a text's counts as that of so many at most.
TEMPER, MOST_GRAMS = 0.35, 400.0
#: Pages' worth of weight that a level's prior has from the level above, and of a doubt in declarations.
SMOOTHING = 4.0

#: Three-letter codes of languages that have one of two letters (fixed values).
CODES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "swe": "sv", "dan": "da", "nor": "no", "nob": "nb", "nno": "nn", "fin": "fi", "isl": "is", "ice": "is", "pol": "pl", "ces": "cs", "cze": "cs", "slk": "sk", "slo": "sk", "slv": "sl", "hrv": "hr", "srp": "sr", "bul": "bg", "ron": "ro", "rum": "ro", "hun": "hu", "ell": "el", "gre": "el", "tur": "tr", "rus": "ru", "ukr": "uk", "est": "et", "lav": "lv", "lit": "lt", "gle": "ga", "cym": "cy", "wel": "cy", "cat": "ca", "eus": "eu", "baq": "eu", "glg": "gl", "ara": "ar", "heb": "he", "fas": "fa", "per": "fa", "hin": "hi", "ben": "bn", "urd": "ur", "tam": "ta", "zho": "zh", "chi": "zh", "jpn": "ja", "kor": "ko", "vie": "vi", "tha": "th", "ind": "id"}
#: Labels below which names are given under a country's suffix (fixed values).
SECOND = frozenset(("ac", "co", "com", "edu", "gov", "net", "or", "org"))

_DROP = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_LANG = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})(?![a-z])""")
_URL = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?([^?#]*)")


def _grams(text: bytes) -> np.ndarray:
    b = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    return (((b[:-2] * np.uint32(0x9E37) + b[1:-1]) * np.uint32(0x85EB) + b[2:]) * np.uint32(0x9E3779B1) >> np.uint32(18)).astype(np.int64)


def code(tag: str) -> str:
    """The language of a tag such as de-AT or deu, of two letters where it has such a code."""
    first = tag.lower().split("-")[0].split("_")[0]
    return CODES.get(first, first)


def domain_of(labels: list[str]) -> str:
    """What a host's name is registered as: two labels, or three below a country's second-level label."""
    deep = len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SECOND
    return ".".join(labels[-3:] if deep else labels[-2:])


def visible(page: str) -> bytes:
    return markup.unescape(_DROP.sub(b" ", page.encode()).decode("utf-8", "replace")).encode()


def trigram_model(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each trigram bucket in each, from all labelled texts. What
    reaches the driver is BUCKETS numbers a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, np.zeros(BUCKETS, np.int64))
                found[lang] += np.bincount(_grams(text), minlength=BUCKETS)
            if len(found) > MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} languages")
        for lang, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    rows = bounded_batches(docs).where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), utf8(text_col).alias("text")).mapInArrow(count, "lang string, bucket int, n long")
    rows = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column(0).to_pylist()))
    counts = np.full((len(langs), BUCKETS), 0.5)
    at = {x: i for i, x in enumerate(langs)}
    for lang, bucket, n in zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True):
        counts[at[lang], bucket] += n
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def _evidence(pages: DataFrame, langs: list[str], model: np.ndarray, id_col: str) -> DataFrame:
    """id, host, domain, suffix, declared, named, n_grams and text (log likelihoods, tempered, the best at 0)."""
    kind = pages.schema["id"].dataType.simpleString()
    centred = model - model.mean(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                m = _URL.match(url)
                host, path = (m[1].lower().rstrip("."), m[2].lower()) if m else ("", "")
                labels = host.split(".") if host else []
                named = next((code(s) for s in path.split("/") if re.fullmatch(r"[a-z]{2,3}([-_][a-z]{2})?", s) and code(s) in langs), None)
                if named is None and labels and labels[-1] in langs:
                    named = labels[-1]
                d = _LANG.search(page)
                grams = _grams(visible(page))
                score = centred[:, grams].sum(axis=1) * TEMPER if len(grams) else np.zeros(len(langs))
                score *= min(1.0, MOST_GRAMS / max(1, len(grams)))
                out.append((host, domain_of(labels), labels[-1] if labels else "", code(d[1]) if d else None, named, len(grams), (score - score.max(initial=0)).tolist()))
            columns = list(zip(*out, strict=True))
            kinds = (*[pa.string()] * 5, pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["id", "host", "domain", "suffix", "declared", "named", "n_grams", "text"])

    return pages.select("id", "url", "html").mapInArrow(run, f"id {kind}, host string, domain string, suffix string, declared string, named string, n_grams long, text array<double>")


def _softmax(scores):
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def identify_languages(pages: DataFrame, langs: list[str], model: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Languages of all pages.

    Returns id_col, lang, confidence (its posterior), text_lang (the best by text alone), declared,
    named and host. One row for each input row. Nulls are empty: a page without text, declaration and
    address has its language from the prior alone. Ties go to the first language in order. An empty
    table gives an empty result; other columns of pages don't matter.
    """
    if not langs:
        raise ValueError("no language to choose from")
    n = len(langs)
    named = lambda c: F.array(*[F.lit(x) for x in langs])[c.cast("int")]
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(url_col, F.lit("")).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    rows = stored(_evidence(rows, langs, model, id_col).withColumn("p", _softmax(F.col("text"))), "page-evidence")
    sums = [F.sum(F.get("p", F.lit(k))).alias(f"p{k}") for k in range(n)]

    def believed(by: str) -> np.ndarray:
        """log P(says | language), says: each language, another, nothing."""
        says = F.when(F.col(by).isNull(), n + 1).otherwise(F.coalesce(F.array_position(F.array(*[F.lit(x) for x in langs]), F.col(by)).cast("int"), F.lit(0)) - 1)
        got = rows.select(F.when(says < 0, n).otherwise(says).alias("says"), "p").groupBy("says").agg(*sums).collect()  # n + 2 rows at most
        table = np.full((n + 2, n), SMOOTHING / (n + 2))
        for r in got:
            table[r["says"]] += [r[f"p{k}"] for k in range(n)]
        return np.log(table / table.sum(axis=0))

    def factor(by: str):
        table = believed(by)
        says = F.when(F.col(by).isNull(), n + 1).otherwise(F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in langs]), F.col(by)), F.lit(0)) - 1, F.lit(n)).cast("int"))
        return F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in table])[says.cast("int")]

    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    first = _softmax(add(add(F.col("text"), factor("declared")), factor("named")))
    rows = stored(rows.withColumn("said", add(add(F.col("text"), factor("declared")), factor("named"))).withColumn("p", first), "page-posteriors")
    hosts = stored(rows.groupBy("host", "domain", "suffix").agg(F.count("*").alias("n"), *sums), "hosts")
    above = [F.sum(f"p{k}").alias(f"p{k}") for k in range(n)]
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), *above)
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), *above)
    whole = suffixes.agg(F.sum("n").alias("n"), *above).collect()[0]  # one row

    def level(df: DataFrame, name: str, *keys: str) -> DataFrame:
        return df.select(*keys, F.struct(F.col("n"), F.array(*[f"p{k}" for k in range(n)]).alias("sum")).alias(f"of_{name}"))

    priors = level(hosts, "host", "host", "domain").join(level(domains, "domain", "domain", "suffix"), "domain").join(level(suffixes, "suffix", "suffix"), "suffix")
    priors = stored(priors.select("host", "of_host", "of_domain", "of_suffix"), "host-priors")
    joined = rows.join(priors, "host", "left")
    # what the other pages say: of all, then of the suffix smoothed with that, of the domain, of the host
    others = lambda total, own: F.greatest(total - own, F.lit(0.0))
    prior = F.zip_with(F.array(*[F.lit(float(whole[f"p{k}"] or 0.0)) for k in range(n)]), F.col("p"), lambda w, p: (others(w, p) + SMOOTHING / n) / ((whole["n"] or 0) - 1 + SMOOTHING))

    def below(prior, of: str):
        zipped = F.arrays_zip(F.col(f"{of}.sum").alias("sum"), F.col("p").alias("p"), prior.alias("up"))
        return F.transform(zipped, lambda x: (others(x["sum"], x["p"]) + SMOOTHING * x["up"]) / (F.col(f"{of}.n") - 1 + SMOOTHING))

    prior = below(below(below(prior, "of_suffix"), "of_domain"), "of_host")
    prior = F.transform(prior, lambda x: F.log(x))
    post = _softmax(add(F.col("said"), prior))
    out = joined.select("id", "host", "declared", "named", F.col("text").alias("t"), post.alias("post"))
    best = lambda c: F.array_position(c, F.array_max(c)) - 1
    return out.select(F.col("id").alias(id_col), named(best(F.col("post"))).alias("lang"), F.array_max("post").alias("confidence"), named(best(F.col("t"))).alias("text_lang"), "declared", "named", "host")
