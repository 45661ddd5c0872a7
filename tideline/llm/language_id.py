"""Language ID of web pages by Bayesian evidence fusion.

A page's posterior multiplies, by language:

* the text likelihood: a naive Bayes model of hashed byte trigrams of the visible text,
  tempered, as neighbouring trigrams are not independent;
* the likelihood of the declared markup language (``<html lang>``, content-language,
  ``og:locale``) and that of the address suffix (last label of the host): their tables
  are counted over all pages against the languages that the texts suggest;
* the host's prior: counts of the texts' languages by host, smoothed towards those of
  the host's domain, and these towards those of all pages.

All counts are grouped aggregations over all pages; a page's own vote is taken out of
each.  A host determines its domain and suffix, so their counts are joined host by host,
and a page joins its host's row alone.  Hosts, domains and suffixes with many rows are
joined by broadcast, so none is a hot task; the declared languages, two or three letters,
are broadcast whole.

Markup is read in one pass whose time is in proportion to the page.

The text model is fitted on a bounded sample of labelled texts: of each language the
``per_language`` rows of smallest hash of doc_id with up to ``max_chars`` characters.

Defined results: null html is empty, a null url has no host.  A page without text has an
even likelihood, so the other evidence decides.  Rows that repeat a page_id are pages
each; null page_ids come back null.  Texts without a language don't train; of rows that repeat a doc_id
and language the smallest text does.  Without
labelled text all pages are ``und``.  Other columns are not read.  Empty table: no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import HOT_KEYS, HOT_LEAST, cut, join_flagged, slices, smallest_hashes, text_col

BUCKETS = 1 << 15
SMOOTH = 0.5
TEMPER = 200.0
#: Weight, in pages, of the level above in the host's prior, and of even odds in the tables of declared languages and suffixes.
LEVEL_WEIGHT, TABLE_WEIGHT = 10.0, 2.0
UNKNOWN = "und"

HIDDEN = ("script", "style", "noscript", "template", "nav", "footer")
OPEN = re.compile(rf"<(!--|(?:{'|'.join(HIDDEN)})\b)?", re.I)
CLOSE = {"!--": re.compile("-->")} | {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in HIDDEN}
SIGNED = re.compile(r"<(html|meta)\b", re.I)
#: An attribute; a name is only tried at its beginning, so that no run of characters is read more than a few times.
ATTRIBUTE = re.compile(r"""(?<![^\s"'=<>/])([^\s"'=<>/]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
LANGUAGE = re.compile(r"[A-Za-z]{2,3}(?![A-Za-z])")
HOST = re.compile(r"^(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")


def visible(page: str) -> str:
    """The text outside tags, comments and hidden elements.  Comments and elements that don't end, and tags, end at the next ``>``; without one the rest is text."""
    out, at, endless = [], 0, set()
    while m := OPEN.search(page, at):
        out.append(page[at : m.start()])
        kind, end = (m.group(1) or "").lower(), -1
        if kind and kind not in endless:
            if close := CLOSE[kind].search(page, m.end()):
                end = close.end()
            else:
                endless.add(kind)  # nor does any later one end
        if end < 0:
            end = page.find(">", m.end()) + 1
            if not end:
                at = m.start()
                break
        out.append(" ")
        at = end
    out.append(page[at:])
    return entities.unescape("".join(out))


def declared(page: str) -> str | None:
    """The first language that an html or meta tag declares."""
    at = 0
    while m := SIGNED.search(page, at):
        end = page.find(">", m.end())
        tag = page[m.end() : end if end >= 0 else len(page)]
        values = {a.group(1).lower(): (a.group(2) or a.group(3) or a.group(4) or "").strip() for a in ATTRIBUTE.finditer(tag)}
        if m.group(1).lower() == "html":
            found = values.get("lang") or values.get("xml:lang")
        else:
            meant = {values.get(k, "").lower() for k in ("http-equiv", "name", "property")}
            found = values.get("content") if meant & {"content-language", "og:locale"} else None
        if found and (code := LANGUAGE.match(found)):
            return code.group().lower()
        if end < 0:
            return None
        at = end
    return None


def host_parts(url: str) -> tuple[str | None, str | None, str | None]:
    """Host, domain (its last two labels) and suffix (its last label)."""
    m = HOST.match(url)
    if not m:
        return None, None, None
    labels = [x for x in m.group(1).lower().split(".") if x]
    return (".".join(labels), ".".join(labels[-2:]), labels[-1]) if labels else (None, None, None)


def trigrams(text: str) -> np.ndarray:
    raw = np.frombuffer(" ".join(text.lower().split()).encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    h = (raw[:-2] * np.uint32(65599) + raw[1:-1]) * np.uint32(65599) + raw[2:]
    return ((h * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


@dataclass
class TextModel:
    langs: list[str]
    logs: np.ndarray  # BUCKETS, languages

    def evidence(self, text: str) -> np.ndarray:
        """Tempered log-likelihoods; zero without text."""
        t = trigrams(text)
        total = np.zeros(len(self.langs))
        for at in range(0, len(t), 1 << 16):
            total += self.logs[t[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return total / 3 * (TEMPER / (TEMPER + len(t)) if len(t) else 0.0)  # a byte is in three trigrams


def fit_texts(rows: list[tuple[str, str]]) -> TextModel:
    """rows (language, text)."""
    langs = sorted({r[0] for r in rows})
    counts = np.full((BUCKETS, len(langs)), SMOOTH)
    for lang, text in rows:
        counts[:, langs.index(lang)] += np.bincount(trigrams(text), minlength=BUCKETS)
    return TextModel(langs, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def fit(docs: DataFrame, per_language: int = 500, max_chars: int = 50_000) -> TextModel:
    """docs (doc_id, text, lang)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.char_length(text_col()) <= max_chars)).select("doc_id", F.col("lang").cast("string").alias("lang"))
    picked = smallest_hashes(known, "lang", per_language).select(F.col("doc_id").alias("id"), F.col("lang").alias("l")).distinct()
    texts = docs.select("doc_id", "lang", text_col().alias("text"))
    rows = texts.join(picked, (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("l"))).groupBy("l", "doc_id").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.l, r.doc_id, r.text))
    return fit_texts([(r.l, r.text) for r in rows])


def _parse(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in slices(batches, 256):
            pages = b.column("html").to_pylist()
            e = [model.evidence(visible(p)) for p in pages]
            best = [model.langs[int(np.argmax(x))] if x.any() else None for x in e]
            where = [host_parts(u) for u in b.column("url").to_pylist()]
            columns = [pa.array(x, pa.string()) for x in ([declared(p) for p in pages], *zip(*where, strict=True), best)] if pages else [pa.array([], pa.string())] * 5
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *columns, pa.array([x.tolist() for x in e], pa.list_(pa.float64()))], names=["page_id", "declared", "host", "domain", "suffix", "text_lang", "evidence"])

    return run


def _hosts(parsed: DataFrame, n_langs: int, total: int) -> DataFrame:
    """host, hot, and the votes, an array in the order of the languages, of the host, its domain and its suffix."""
    sums = [F.sum(f"v{k}").alias(f"v{k}") for k in range(n_langs)]
    votes = F.array(*(F.col(f"v{k}") for k in range(n_langs)))
    hosts = cut(parsed.where("host IS NOT NULL").groupBy("host", "domain", "suffix").agg(F.count("*").alias("pages"), *sums), "hosts")
    n_hosts = hosts.count()
    out = hosts.select("host", "domain", "suffix", "pages", votes.alias("host_votes"))
    for level in ("domain", "suffix"):
        hot = F.count("*") >= max(HOT_LEAST, -(-n_hosts // HOT_KEYS))
        above = cut(hosts.groupBy(level).agg(hot.alias("hot"), *sums).select(level, "hot", votes.alias(f"{level}_votes")), level)
        out = join_flagged(out, [level], above)
    hot = F.col("pages") >= max(HOT_LEAST, -(-total // HOT_KEYS))
    return cut(out.select("host", hot.alias("hot"), "host_votes", "domain_votes", "suffix_votes"), "host-votes")


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """pages (page_id, url, html) -> page_id, lang, confidence, text_lang, declared, host."""
    langs = model.langs
    kind = pages.schema["page_id"].dataType.simpleString()
    if not langs:
        return pages.select("page_id", F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("confidence"), *(F.lit(None).cast("string").alias(c) for c in ("text_lang", "declared", "host")))
    held = pages.sparkSession.sparkContext.broadcast(model)
    parsed = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), text_col("html").alias("html"))
    parsed = parsed.mapInArrow(_parse(held), f"page_id {kind}, declared string, host string, domain string, suffix string, text_lang string, evidence array<double>")
    parsed = cut(parsed.withColumns({f"v{k}": F.coalesce((F.col("text_lang") == x).cast("double"), F.lit(0.0)) for k, x in enumerate(langs)}), "pages")
    total, *every = parsed.agg(F.count("*"), *(F.coalesce(F.sum(f"v{k}"), F.lit(0.0)) for k in range(len(langs)))).first()
    none = F.array(*[F.lit(0.0)] * len(langs))
    votes = [F.sum(f"v{k}") for k in range(len(langs))]
    signs = parsed.where("declared IS NOT NULL").groupBy("declared").agg(F.array(*votes).alias("declared_votes"))
    hosts = _hosts(parsed, len(langs), total)
    at_home = join_flagged(parsed.where("host IS NOT NULL"), ["host"], hosts)
    out = at_home.unionByName(parsed.where("host IS NULL").withColumns({f"{k}_votes": none for k in ("host", "domain", "suffix")}))
    out = out.join(F.broadcast(signs), "declared", "left")
    out = out.withColumn("own", F.array(*(F.col(f"v{k}") for k in range(len(langs)))))
    # The order of the sums is fixed, so that a host's pages agree to the last bit.
    minus = lambda votes: F.zip_with(votes, F.col("own"), lambda v, o: F.greatest(v - o, F.lit(0.0)))
    sum_of = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    others = minus(F.array(*map(F.lit, every)))

    def smoothed(votes, above):
        return F.zip_with(votes, above, lambda v, p: (v + LEVEL_WEIGHT * p) / (sum_of(votes) + LEVEL_WEIGHT))

    def likelihood(sign: str):
        """By language, the log of the sign's share of the language's other pages; even odds without a sign."""
        share = F.zip_with(minus(F.col(f"{sign}_votes")), F.col("others"), lambda v, n: F.log((v + TABLE_WEIGHT / len(langs)) / (n + TABLE_WEIGHT)))
        return F.when(F.col(sign).isNull(), none).otherwise(share)

    out = out.withColumn("others", others)
    out = out.withColumn("all_prior", F.transform("others", lambda v: (v + 1.0) / (sum_of(F.col("others")) + len(langs))))
    out = out.withColumn("mine", minus(F.col("domain_votes"))).withColumn("domain_prior", smoothed(F.col("mine"), F.col("all_prior")))
    out = out.withColumn("mine", minus(F.col("host_votes"))).withColumn("prior", smoothed(F.col("mine"), F.col("domain_prior")))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    out = out.withColumn("z", plus(plus(F.col("evidence"), F.transform("prior", lambda p: F.log(p))), plus(likelihood("declared"), likelihood("suffix"))))
    top = F.array_max("z")
    out = out.withColumn("k", F.array_position("z", top)).withColumn("confidence", 1.0 / F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return out.select("page_id", F.element_at(F.array(*map(F.lit, langs)), F.col("k").cast("int")).alias("lang"), "confidence", "text_lang", "declared", "host")
