"""Tokens, chat format, classifier, language ID, decontamination and the pipeline."""

import hashlib
import os
import random
import time
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm import bpe, chat_format, decontaminate, language_id, pretokens, queries, token_counts, toxicity
from tideline.llm.common import cut, free, shared_dir, slices

PATTERN = public_tokenizers.PATTERN
RANKS, JSON = public_tokenizers.path(queries.ENCODE_FILE), public_tokenizers.path(queries.COUNT_FILE)
ODD = ["", "a <|endoftext|> b<|endoftext|>", "x" * 50_000 + "  y", " " * 20_000 + "a", "a" + " " * 20_000, "՘ ab 中文 😀🏽  \x1c\x85 a\xa0b", "don't 'S it''s <|endoftext|", "\n\n  \t a" * 3000, "a\r\n" * 2000 + " " * 9000, "　　 x"]


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# shared parts

def test_slices_bound_rows_and_bytes():
    texts = ["x" * n for n in (10, 3000, 1, 1, 5000, 0, 2)] + [None] * 9
    batch = pa.RecordBatch.from_pydict({"id": list(range(16)), "text": texts})
    got = list(slices(iter([batch]), 4, 3000))
    assert [t for b in got for t in b.column("text").to_pylist()] == texts and [b.num_rows for b in got] == [1, 1, 2, 1, 4, 4, 3]


def test_scratch_tables_can_be_freed(spark):
    table = cut(spark.range(3), "scratch")
    path = table._scratch.removeprefix("file://").removeprefix("file:")
    assert table.count() == 3 and os.path.exists(path)
    free(table)
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    sc = SimpleNamespace(applicationId="other", master="spark://host:7077", getConf=lambda: conf)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(sparkContext=sc, conf=conf))


# byte-level BPE

def test_bpe_agrees_with_the_library(spark, sf):
    enc = bpe.encoding(RANKS, PATTERN)
    for t in ODD:
        for limit in (64, pretokens.LIMIT):
            assert bpe.encode(t, enc, limit) == enc.encode_ordinary(t)
    rows = docs(spark, sf).select("doc_id", "text").collect()
    out = bpe.decode_documents(bpe.encode_documents(docs(spark, sf), RANKS, PATTERN, 100), RANKS, PATTERN)
    got = {r.doc_id: r for r in out.collect()}
    digest = {r.doc_id: r for r in bpe.digests(out).collect()}
    for r in rows:
        ids = enc.encode_ordinary(r.text)
        assert got[r.doc_id].ids == ids and bytes(got[r.doc_id].decoded) == r.text.encode()
        assert digest[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and digest[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


@pytest.mark.parametrize("limit", [100, pretokens.LIMIT])
def test_round_trip_digests(spark, limit):
    """The query's own path, over a whole table."""
    df = docs(spark, "/root/testdata/sf0.01")
    enc, texts = bpe.encoding(RANKS, PATTERN), {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    got = bpe.digests(bpe.round_trip(df, RANKS, PATTERN, limit)).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, raw = enc.encode_ordinary(texts[r.doc_id]), texts[r.doc_id].encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest())


def test_bpe_edge_rows(spark):
    df = spark.createDataFrame([(None, "a"), (1, None), (1, ""), (2, " " * 1_000_000 + "b")], "doc_id long, text string").withColumn("ids", F.lit(3))
    got = bpe.digests(bpe.decode_documents(bpe.encode_documents(df, RANKS, PATTERN), RANKS, PATTERN)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sum(r.n_tokens == 0 and r.ids_sha256 == r.decoded_sha256 == empty for r in got) == 2
    assert {r.decoded_sha256 for r in got if r.doc_id == 2} == {hashlib.sha256(b" " * 1_000_000 + b"b").hexdigest()}
    assert bpe.encode_documents(df.limit(0), RANKS, PATTERN).collect() == []


# token counts

def test_counts_agree_with_the_library(spark, sf):
    c = token_counts.counter(JSON, PATTERN)
    library = lambda t: len(c.tokenizer.encode(t, add_special_tokens=False).ids)
    for t in ODD:
        assert c.count(t) == library(t)
    text = {r.doc_id: r.text for r in docs(spark, sf).select("doc_id", "text").collect()}
    got = token_counts.count_tokens(docs(spark, sf), JSON, PATTERN).collect()
    assert len(got) == len(text) and all(r.n_tokens == library(text[r.doc_id]) and r.n_bytes == len(text[r.doc_id].encode()) for r in got)
    for token in random.Random(1).sample(sorted(c.whole), 500):
        assert library(token) == 1
    odd = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "word " * 200_000)], "doc_id long, text string").withColumns({"n_tokens": F.lit(5), "n_bytes": F.lit(6)})
    assert sorted((str(r.doc_id), r.n_tokens, r.n_bytes) for r in token_counts.count_tokens(odd, JSON, PATTERN).collect()) == sorted([("1", library("a b"), 3)] * 2 + [("None", library("a b"), 3), ("2", library("word " * 200_000), 1_000_000)])
    df = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert {r.n_tokens for r in token_counts.count_tokens(df, JSON, PATTERN).collect()} == {0}
    assert token_counts.count_tokens(df.limit(0), JSON, PATTERN).collect() == []


# chat format

def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["%", "25", "3C", "5B", "0A", "<", "|", "/s>", "s>", "[", "INST]", "/INST]", "\n", "é😀", "a", "<|end|>", "<|turn|>", "%2", "5B", "/I", "NST]"]
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem%0A", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for c in range(150) for t in range(rng.randint(1, 4))]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (-8, 0, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1))
    out = chat_format.format_conversations(df.select("conv_id", "turn", "role", "n", chat_format.text_part(F.col("text")).alias("parts")))
    got = {r.conv_id: r for r in chat_format.read_back(out).collect()}
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == turns and got[c].loss_text == "".join(t for r, t in turns if r == "assistant")
    plain = {r.conv_id: r for r in out.collect()}
    assert "<|end|>" not in plain[-7].formatted.replace("<|end|>\n", "") and "[INST]" not in plain[-7].formatted
    for r in plain.values():
        assert all(r.formatted[s.start + s.chars :].startswith("<|end|>") for s in r.loss)
    assert chat_format.format_conversations(df.select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts")).limit(0)).collect() == []


def test_chat_parts(spark):
    parts = """array(named_struct('kind','text','text','look %','ref',cast(null as string),'width',cast(null as int),'height',cast(null as int),'seconds',cast(null as double),'pages',cast(null as int)),
      named_struct('kind','image','text',null,'ref','a.png','width',100,'height',57,'seconds',null,'pages',null), named_struct('kind','text','text','25 x','ref',null,'width',null,'height',null,'seconds',null,'pages',null),
      named_struct('kind','audio','text',null,'ref','b.wav','width',null,'height',null,'seconds',1.5D,'pages',null), named_struct('kind','odd','text','gone','ref',null,'width',null,'height',null,'seconds',null,'pages',null))"""
    df = spark.sql(f"SELECT 1 AS conv_id, 0 AS turn, 'user' AS role, {parts} AS parts UNION ALL SELECT 1, 1, 'assistant', array(named_struct('kind','document','text',null,'ref','c.pdf','width',null,'height',null,'seconds',null,'pages',2)) UNION ALL SELECT 1, 2, 'user', null")
    r = chat_format.format_conversations(df).first()
    assert r.formatted == "<|turn|>user\nlook %25<|image|>25 x<|audio|><|end|>\n<|turn|>assistant\n<|document|><|end|>\n<|turn|>user\n<|end|>\n"
    assert [tuple(a) for a in r.attachments] == [(1, "image", "a.png", 12), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 1024)] and r.extra_tokens == 1071
    back = chat_format.read_back(chat_format.format_conversations(df)).first()
    assert back.turns[0].text == "look %<|image|>25 x<|audio|>" and (back.n_attachments, back.extra_tokens) == (3, 1071)
    parts = chat_format.read_parts(chat_format.format_conversations(df)).first()
    assert [tuple(t) for t in parts.turns] == [("user", ["look %", "25 x", ""], ["image", "audio"]), ("assistant", ["", ""], ["document"]), ("user", [""], [])]
    assert [k for t in parts.turns for k in t.kinds] == [a.kind for a in parts.attachments]


def test_placeholders_in_texts_stay_texts(spark):
    """Random parts: what looks like a placeholder in a text isn't read as one."""
    rng = random.Random(6)
    bits = ["<|image|>", "<", "|image|>", "%3C", "a", "<|end|>", "\n", "%", "|audio|>", "<|", "é"]
    blank = dict.fromkeys(("text", "ref", "width", "height", "seconds", "pages"))
    rows, want = [], {}
    for c in range(80):
        for t in range(rng.randint(1, 3)):
            texts, kinds = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 5)))], []
            parts = [blank | {"kind": "text", "text": texts[0]}]
            for _ in range(rng.randint(0, 3)):
                kinds.append(rng.choice(chat_format.KINDS))
                texts.append("".join(rng.choice(bits) for _ in range(rng.randint(0, 5))))
                parts += [blank | {"kind": kinds[-1], "ref": f"{c}-{t}"}, blank | {"kind": "text", "text": texts[-1]}]
            rows.append((c, t, "user", parts))
            want.setdefault(c, []).append(("user", texts, kinds))
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    got = {r.conv_id: r for r in chat_format.read_parts(chat_format.format_conversations(df)).collect()}
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == turns and [a.kind for a in got[c].attachments] == [k for t in turns for k in t[2]]


def test_chat_edge_rows(spark):
    """Null conversations are one turn each; repeated rows are turns; other columns don't matter."""
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (None, None, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"), (1, None, "user", "x" * 300_000)], "conv_id long, turn long, role string, text string")
    wide = df.withColumns({"n": F.lit(1), "alone": F.lit("z"), "media": F.lit(0), "at": F.lit(2)})
    out = chat_format.format_conversations(wide.select("conv_id", "turn", "role", "n", "alone", "media", "at", chat_format.text_part(F.col("text")).alias("parts")))
    got = chat_format.digests(chat_format.read_back(out)).collect()
    assert sorted((str(r.conv_id), r.n_turns, r.loss_chars) for r in got) == [("1", 3, 2), ("None", 1, 0), ("None", 1, 0), ("None", 1, 0)]


def test_chat_plan_has_no_python(spark, sf):
    plan = queries.op7_chat_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# SQL

@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]}) q").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(map(tuple, want))


# toxicity

def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op2_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "predicted", "toxic").toPandas()
    y, s = got.toxic.to_numpy(), got.score.to_numpy()
    rank = np.argsort(np.argsort(s))
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    assert auc > 0.93 and got.score.between(0, 1).all() and (got.predicted == (s >= 0.7)).all()
    clean = got[got.toxic == 0]
    assert clean.predicted.mean() < 0.03 and got[got.toxic == 1].predicted.mean() > 0.7


def test_repeated_ids_train_once(spark, monkeypatch):
    df = spark.createDataFrame([(1, t, "en") for t in "cabc"] + [(2, None, None), (2, "x", "de"), (3, "y", "de")], "doc_id long, text string, lang string")
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, langs, seed: sorted(zip(texts, labels, langs, strict=True)))
    assert toxicity.fit(df, spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")) == [("", 0, None), ("a", 1, "en")]
    monkeypatch.setattr(language_id, "fit_texts", sorted)
    assert language_id.fit(df) == [("de", "x"), ("de", "y"), ("en", "a")]


def test_toxicity_reads_the_text_alone(spark):
    model = toxicity.train(["you idiot", "fine day", "idiot again", "good words"] * 10, [1, 0, 1, 0] * 10, ["en"] * 40)
    df = spark.createDataFrame([(1, "what an idiot", "en"), (None, None, None), (1, "", "xx"), (2, "fine " * 100_000 + "idiot", "de")], "doc_id long, text string, lang string").withColumn("score", F.lit(9))
    got = toxicity.flag(toxicity.score(df, model), model).collect()
    by = {(r.doc_id, r.lang): r for r in got}
    assert by[1, "en"].predicted == by[2, "de"].predicted == 1 and by[None, None].predicted == by[1, "xx"].predicted == 0
    assert by[None, None].score == by[1, "xx"].score and len(got) == 4
    assert toxicity.score(df.drop("lang").limit(0), model).collect() == []
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none is None and {r.score for r in toxicity.score(df, none).collect()} == {0.0}


def test_forward_pass_against_plain_loops():
    """Convolution and pooling by loops over words, taps and filters."""
    model = toxicity.train(["you idiot", "fine day", "what a fine idiot", "no words here"] * 10, [1, 0, 1, 0] * 10, ["en"] * 40)
    rng, vocabulary = random.Random(8), ["you", "idiot", "fine", "day", "others", "no"]
    for n in (0, 1, 2, 3, 9, 40):
        ids = toxicity.Hasher()(" ".join(rng.choice(vocabulary) for _ in range(n)))
        buckets, want, tap = toxicity._buckets(ids), [], 0
        for width_no, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                sums = [sum(float(model.tables[t][buckets[t][at + j], tap + j, f]) for t in range(len(model.tables)) for j in range(width)) for at in range(n - width + 1)]
                want.append(max([0.0, *(s + float(model.bias[width_no, f]) for s in sums)]))
            tap += width
        assert np.allclose(model.pooled(ids), want, atol=1e-4)
        z = model.scale * (float(np.dot(want, model.weights)) + model.offset - model.shift) + np.log(0.7 / 0.3)
        assert abs(model.score(ids) - 1 / (1 + np.exp(-z))) < 1e-4


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    taps, wide = sum(toxicity.WIDTHS), len(toxicity.STEMS) * toxicity.PART
    p = {"e": rng.normal(0, 1, (len(toxicity.STEMS), toxicity.BUCKETS, toxicity.PART)), "f": rng.normal(0, 1, (taps, wide, toxicity.FILTERS)), "b": rng.normal(0, 0.1, (len(toxicity.WIDTHS), toxicity.FILTERS)), "w": rng.normal(0, 0.3, len(toxicity.WIDTHS) * toxicity.FILTERS), "o": rng.normal(0, 1, 1)}
    ids = toxicity.Hasher()("one two three two four one")
    buckets = toxicity._buckets(ids)

    def loss(label):
        x = np.concatenate([t[b] for t, b in zip(p["e"], buckets, strict=True)], axis=1)
        pooled, tap = [], 0
        for n, w in enumerate(toxicity.WIDTHS):
            z = sum(x[j : len(x) - w + 1 + j] @ p["f"][tap + j] for j in range(w)).max(axis=0) + p["b"][n]
            pooled.append(np.maximum(z, 0))
            tap += w
        logit = float(np.concatenate(pooled) @ p["w"] + p["o"][0])
        return np.log1p(np.exp(logit)) - label * logit

    for label in (0, 1):
        g, rows = {k: np.zeros_like(v) for k, v in p.items() if k != "e"}, {}
        toxicity._backward(p, ids, label, 1.0, g, rows)
        places = [("f", (0, 3, 1)), ("f", (2, 0, 5)), ("f", (5, 7, 2)), ("b", (1, 4)), ("b", (2, 0)), ("w", (3,)), ("w", (20,)), ("o", (0,))]
        places += [("e", (t, int(buckets[t][k]), c)) for t in range(len(buckets)) for k in (0, 1) for c in (0, toxicity.PART - 1)]
        for name, at in places:
            old, step = p[name][at], 1e-5
            p[name][at] = old + step
            up = loss(label)
            p[name][at] = old - step
            down = loss(label)
            p[name][at] = old
            mine = rows.get(at[:2], np.zeros(toxicity.PART))[at[2]] if name == "e" else g[name][at]
            assert abs(mine - (up - down) / (2 * step)) < 1e-3


def test_pooling_in_chunks_is_the_whole_maximum(monkeypatch):
    model = toxicity.train(["you idiot", "fine day"] * 10, [1, 0] * 10, ["en"] * 20)
    ids = toxicity.Hasher()(" ".join(f"w{n % 97}" for n in range(500)))
    whole = model.pooled(ids)
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    assert np.array_equal(model.pooled(ids), whole)


# language ID

def test_languages_of_pages(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_language_id(spark, sf).collect()
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert len(got) == pages.count() and np.mean([r.lang == r.declared for r in got]) > 0.98


def test_evidence_is_fused(spark, sf):
    model = language_id.fit(docs(spark, sf))
    body = lambda d: docs(spark, sf).where(F.col("lang") == d).orderBy(F.desc("n_chars")).first().text[:400]
    rows = [(n, "https://a.example.fr/x", f"<p>{body('fr')}</p>") for n in range(30)]
    rows += [(100, "https://a.example.fr/y", ""), (101, "https://b.example.fr/y", "<html><p>1</p>"), (102, None, None), (103, "https://a.example.fr/z", f'<html lang="fr-CA"><script>x</script><p>{body("en")}</p>'), (None, "x", f'<p>{body("de")}</p>')]
    got = {r.page_id: r for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lang", F.lit("zz")), model).collect()}
    assert len(got) == len(rows)
    assert got[100].lang == got[101].lang == "fr" and got[100].confidence > got[102].confidence
    assert got[103].lang == "en" and got[103].declared == "fr" and got[None].lang == "de"
    assert language_id.identify(spark.createDataFrame([], "page_id long, url string, html string"), model).collect() == []
    assert language_id.host_parts("http://u@A.b.Example.CO:80/x") == ("a.b.example.co", "example.co", "co") and language_id.host_parts("nothing") == (None, None, None)


def posterior_reference(pages, model):
    """Plain Python: text evidence, declared and suffix tables and the smoothed host prior, own vote out of each."""
    n = len(model.langs)
    rows = []
    for i, url, page in pages:
        e = model.evidence(language_id.visible(page or ""))
        rows.append((i, e, int(np.argmax(e)) if e.any() else None, language_id.declared(page or ""), *language_id.host_parts(url or "")))
    out = {}
    for i, e, own, sign, host, domain, suffix in rows:
        def count(column, value):
            c = np.zeros(n)
            for r in rows:
                if r[2] is not None and (column is None or r[column] == value):
                    c[r[2]] += 1
            if own is not None:
                c[own] -= 1
            return c

        others = count(None, None)
        prior = (others + 1) / (others.sum() + n)
        if host is not None:
            for column, value in ((5, domain), (4, host)):
                c = count(column, value)
                prior = (c + 10 * prior) / (c.sum() + 10)
        else:
            prior = (0 + 10 * prior) / 10
        z = e + np.log(prior)
        for column, value in ((3, sign), (6, suffix)):
            if value is not None:
                z = z + np.log((count(column, value) + 2 / n) / (others + 2))
        out[i] = (model.langs[int(np.argmax(z))], 1 / np.exp(z - z.max()).sum())
    return out


def test_posterior_against_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    model = language_id.fit(docs(spark, sf), 50)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()] + [(-1, None, None), (-2, "//h.example.de", ""), (-3, "//h.example.de", "<html lang=fr>"), (-4, "no host", '<meta content="es-ES" property="og:locale">')]
    want = posterior_reference(rows, model)
    got = language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.lang == want[r.page_id][0] and abs(r.confidence - want[r.page_id][1]) < 1e-9


@pytest.mark.parametrize("page", ["<meta content-language' " * 40_000, "<script>" * 100_000, "<!--" * 200_000, "<" * 400_000, "<html " + "a" * 800_000, "<meta a=\"" * 80_000, "<meta a= " * 80_000, "<html\n" + " " * 500_000, "</script " * 80_000 + "<script>", "<nav>" + "</nav " * 80_000, "&" * 400_000])
def test_markup_takes_time_in_proportion(page):
    began = time.process_time()
    language_id.visible(page)
    language_id.declared(page)
    assert time.process_time() - began < 4


def test_markup_is_read():
    assert language_id.visible('a<b x="1">c</b><!-- d > e -->f<SCRIPT>g<i></Script >h<style>i &amp; <!-- j').split() == ["a", "c", "f", "h", "i", "&", "<!--", "j"]
    assert language_id.visible("x < y") == "x < y" and language_id.visible("<nav>a</nav>b<footer>c") == " b c"
    cases = {"<HTML class=x LANG='pt-BR'>": "pt", "<html xml:lang=de>": "de", '<meta http-equiv="Content-Language" content="fr">': "fr", '<meta content="es_MX" property="og:locale">': "es", '<html data-lang="xx"><meta name=og:locale content=it': "it", "<html lang=english>": None, "lang=en": None}
    assert {k: language_id.declared(k) for k in cases} == cases


# decontamination

def test_leaks_are_the_contained_items(spark):
    sf = "/root/testdata/sf0.01"
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: " ".join(decontaminate.words(r.text)) for r in bench.collect()}
    texts = {r.doc_id: " ".join(decontaminate.words(r.text)) for r in docs(spark, sf).select("doc_id", "text").collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if f" {x} " in f" {t} "}
    for parameters in ({}, {"shard": 7, "pass_bytes": 1}, {"item_bytes": 900}):
        assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, sf), bench, **parameters).collect()} == want
    one, many = ({(r.doc_id, r.item_id): (round(r.score, 9), r.question_overlap) for r in decontaminate.leaks(docs(spark, sf), bench, item_bytes=n).collect()} for n in (1 << 30, 900))
    assert one == many  # groups of items share the statistics of all
    left = decontaminate.drop_leaks(docs(spark, sf), bench)
    assert left.columns == docs(spark, sf).columns and left.count() == len(texts) - len({d for d, _ in want})


@pytest.mark.parametrize("threshold", [0.2, 0.5])
def test_search_is_exact(threshold):
    rng = random.Random(3)
    vocabulary = [f"w{n}" for n in range(60)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14))) + "." for _ in range(50)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 120))] for _ in range(40)]
    for s in decontaminate.build(items, 20, 4):
        inverse = [{} for _ in s.items]
        for w, t in s.terms.items():
            for pairs in s.postings[t].values():
                for k, v in pairs:
                    inverse[k][w] = v
        stride = s.passage // 2
        want = set()
        for d, ws in enumerate(texts):
            for n in range(max(1, -(-len(ws) // stride) - 1)):
                inside = set(ws[n * stride : n * stride + s.passage])
                want |= {(d, n * stride, k) for k, m in enumerate(inverse) if sum(v for w, v in m.items() if w in inside) >= threshold - 1e-9}
        got = [x[:3] for x in decontaminate.search(s, texts, threshold)]
        assert len(got) == len(set(got)) and set(got) == want


def test_leak_edge_rows(spark):
    rows = spark.createDataFrame([(None, "Who came first? The old grey hen came first of all."), (1, None), (2, ""), (3, "the old grey hen came first of all"), (3, "x Who came first? The old grey hen came first of all. y")], "doc_id long, text string").withColumn("item_id", F.lit(5))
    bench = spark.createDataFrame([(9, "Who came first? The old grey hen came first of all."), (None, None), (10, "")], "item_id long, text string")
    assert sorted((str(r.doc_id), r.item_id) for r in decontaminate.leaks(rows, bench).collect()) == [("3", 9), ("None", 9)]
    assert decontaminate.leaks(rows, bench.limit(0)).collect() == [] and decontaminate.leaks(rows.limit(0), bench).collect() == []
    assert sorted((r.doc_id, r.text or "") for r in decontaminate.drop_leaks(rows, bench).collect()) == [(1, ""), (2, ""), (3, "the old grey hen came first of all")]


def test_long_documents_and_pages(spark, sf):
    """An item deep in a text of megabytes; pages of megabytes beside null ones."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()
    rng = random.Random(3)
    filler = " ".join(f"v{rng.randrange(9999)}" for _ in range(300_000))
    rows = spark.createDataFrame([(1, f"{filler} {item.text} {filler}"), (2, filler), (3, None), (1, "")], "doc_id long, text string").withColumns({"item": F.lit(1), "n": F.lit(2)})
    found = decontaminate.leaks(rows, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, item.item_id)]
    model = language_id.fit(docs(spark, sf), 20)
    text = docs(spark, sf).where("lang = 'de'").orderBy(F.desc("n_chars")).first().text
    pages = spark.createDataFrame([(1, "//a.de", f"<p>{text}</p>" * (3_000_000 // len(text))), (1, "//a.de", None), (1, "//a.de", None)], "page_id long, url string, html string").withColumns({"own": F.lit(1), "host": F.lit(2), "pages": F.lit(3)})
    assert [r.lang for r in language_id.identify(pages, model).collect()] == ["de"] * 3


# pipeline

def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline
    from test_dedup import near_reference

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "byte_bpe"]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    rows = {r.doc_id: r.text for r in docs(spark, sf).select("doc_id", "text").collect()}
    toxic = {r.doc_id for r in queries.op2_toxicity(spark, sf).where("flagged = 1").collect()}
    left = {i: t for i, t in rows.items() if i not in toxic}
    last = {t: i for i, t in sorted(left.items())}
    left = {i: t for i, t in left.items() if last[t] == i}
    ids = sorted(left)
    root = near_reference([left[i] for i in ids])
    left = {i: left[i] for n, i in enumerate(ids) if root[n] == n}
    items = [" ".join(decontaminate.words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(f" {x} " in f" {' '.join(decontaminate.words(t))} " for x in items)}
    assert set(got) == set(left)
    enc = bpe.encoding(RANKS, PATTERN)
    assert all(got[i].n_tokens == len(enc.encode_ordinary(t)) for i, t in left.items())


def test_stages_judge_each_row_by_its_own_text(spark, sf, tmp_path):
    """Null and repeated ids, null and empty texts, repeated rows; and empty tables."""
    import corpus_pipeline

    clean = [r.text for r in docs(spark, sf).where("lang = 'en'").orderBy("doc_id").limit(60).collect()]
    clean = [t for t in clean if len(t.split()) > 60][:6]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(None, clean[0]), (None, clean[1]), (None, f"{clean[2]} {item}"), (5, clean[3]), (5, clean[4]), (5, None), (6, ""), (7, clean[3]), (7, clean[3]), (8, f"{clean[5]} {item}"), (8, "a very short one")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], docs(spark, sf).schema)
    left, found = df, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, left = left, stage(spark, left, sf)
        if name != "toxicity":  # what the classifier makes of these isn't the matter here
            found[name] = sorted((str(r.doc_id), r.text or "") for r in left.collect())
        else:
            left = before
    assert found["exact_dedup"] == sorted([("None", clean[0]), ("None", clean[1]), ("None", f"{clean[2]} {item}"), ("5", clean[4]), ("6", ""), ("7", clean[3]), ("8", f"{clean[5]} {item}"), ("8", "a very short one")])
    assert found["simhash_near_dedup"] == found["exact_dedup"]
    assert found["decontamination"] == [x for x in found["exact_dedup"] if item not in x[1]]
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_the_columns(spark, sf):
    import corpus_pipeline

    clashing = ("id", "__id", "sha", "text_sha256", "found", "docs", "row", "score", "kept", "component_id", "l", "a.b")
    wide = docs(spark, sf).limit(30).withColumns({c: F.lit(c) for c in clashing})
    wide = wide.unionByName(wide)  # rows that repeat
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, wide, sf)
        assert left.columns == wide.columns and left.where("`a.b` <> 'a.b'").isEmpty()


def test_other_columns_may_have_any_name(spark, sf):
    wide = docs(spark, sf).withColumns({"id": F.lit(0), "l": F.lit("x"), "r": F.lit("y")})
    plain, other = language_id.fit(docs(spark, sf), 5), language_id.fit(wide, 5)
    assert plain.langs == other.langs and np.array_equal(plain.logs, other.logs)
