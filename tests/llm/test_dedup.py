"""Exact, near, line and suffix dedup against brute force, and their defined results."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tideline.llm import exact_dedup, line_dedup, queries, simhash, simhash_wide, suffix_dedup
from tideline.llm.common import cut, join_one
from tideline.llm.components import components

SCHEMA = "doc_id long, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


# exact

def exact_reference(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(-(2**63) if i is None else i)
    return {t: (max(g), len(g)) for t, g in groups.items()}


@pytest.mark.parametrize("page_bytes", [exact_dedup.PAGE_BYTES, 20_000])
def test_exact(spark, sf, page_bytes):
    rows = rows_of(docs(spark, sf))
    want = exact_reference(rows)
    text = dict(rows)
    got = exact_dedup.exact_dedup(docs(spark, sf), page_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        t = text[r.doc_id] or ""
        assert (r.keep_id, r.group_size) == want[t] and r.kept == (r.doc_id == r.keep_id) and r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("fan", [exact_dedup.FAN, 3])
def test_exact_hot_group_spans_pages(spark, fan):
    rows = [(n if n % 5 else None, "same text" if n % 3 else f"own {n}") for n in range(1, 601)]
    entries = cut(frame(spark, rows).select(F.xxhash64("text").alias("h"), F.lit(73).cast("long").alias("bytes")), "entries")
    index = exact_dedup.build_index(entries, 1000)
    assert index.longest > 27 and index.hot.count() == 1
    got = exact_dedup.exact_dedup(frame(spark, rows), 1000, fan).collect()
    assert len(got) == 600 and {(r.keep_id, r.group_size) for r in got if r.group_size > 1} == {(599, 400)}
    assert sum(r.kept for r in got if r.group_size > 1) == 1 and all(r.kept for r in got if r.group_size == 1)


def test_heads_of_colliding_texts_merge_in_a_tree(spark):
    """Two texts under one hash, over 20 pages of a bucket that begins at page 5."""
    rows = [(7, 5 + p, 5, c, 1000 - 10 * p + c, 1 + p, t) for p in range(20) for c, t in enumerate("xy" if p % 2 else "y")]
    heads = spark.createDataFrame(rows, "h long, page int, base int, chain int, head long, n long, head_text string")
    for fan in (64, 3, 2):
        got = {(r.page, r.chain): (r["head"], r.n, r.first) for r in exact_dedup.merge_heads(heads, 20, fan).collect()}
        want = {}
        for t in "xy":
            mine = [r for r in rows if r[6] == t]
            top = max(mine, key=lambda r: r[4])
            want |= {(r[1], r[3]): (top[4], sum(x[5] for x in mine), r is top) for r in mine}
        assert got == want


def test_exact_compares_bytes_where_hashes_collide():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": [5, 4, 3, 2], "h": [7] * 4, "page": pa.array([0] * 4, pa.int32()), "base": pa.array([0] * 4, pa.int32()), "many": [False] * 4, "text": ["x", "y", "x", "y"]})
    out = pa.Table.from_batches(list(exact_dedup._chains(iter([batch])))).to_pylist()
    assert [(r["id"], r["head"], r["n"], r["rank"]) for r in out] == [(5, 5, 2, 0), (3, 5, 2, 1), (4, 4, 2, 0), (2, 4, 2, 1)]


def directory_reference(cells, page_bytes):
    """Textbook insertion: buckets split one at a time, and the directory doubles when it must."""
    bits = len(cells).bit_length() - 1
    depth, slots = 0, [(0, 0)]  # of each slot: its bucket's depth and prefix
    size = lambda d, p: sum(cells[p << (bits - d) : (p + 1) << (bits - d)])
    while over := [b for b in dict.fromkeys(slots) if size(*b) > page_bytes and b[0] < bits]:
        d, p = over[0]
        if d == depth:
            depth, slots = depth + 1, [b for b in slots for _ in (0, 1)]
        slots = [(d + 1, s >> (depth - d - 1)) if b == (d, p) else b for s, b in enumerate(slots)]
    return depth, slots


def test_directory_doubles_until_buckets_fit():
    rng = np.random.default_rng(4)
    for cells in ([10] * 8, [0] * 16, [1000, 0, 0, 1, 0, 0, 0, 1], rng.integers(0, 30, 64).tolist(), [5]):
        for page_bytes in (1, 20, 45, 5000):
            d = exact_dedup.grow(np.array(cells), page_bytes)
            depth, slots = directory_reference(cells, page_bytes)
            assert d.depth == depth and [(d.local[b], d.prefix[b]) for b in d.slots] == slots
            assert sum(d.size) == sum(cells) and len(d.slots) == 2**depth


def test_a_large_histogram_takes_seconds():
    cells = np.random.default_rng(1).integers(0, 1000, 1 << 22)
    cells[77] = 10**9
    began = time.process_time()
    d = exact_dedup.grow(cells, int(cells.sum() // exact_dedup.MAX_PAGES))
    assert time.process_time() - began < 10 and d.size[np.arange(len(d.size)) != d.slots[77 >> (22 - d.depth)]].max() <= cells.sum() // exact_dedup.MAX_PAGES


def test_exact_edge_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (None, "a"), (5, None), (6, ""), (7, "b"), (7, "c")]
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert len(got) == 8 and {(r.keep_id, r.group_size) for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest()} == {(6, 2)}
    wide = frame(spark, rows).withColumns({"id": F.lit(1), "h": F.lit("x"), "kept": F.lit(0), "n": F.lit(2)})
    left = exact_dedup.drop_exact_duplicates(wide)
    assert left.columns == wide.columns and in_order((r.doc_id, r.text) for r in left.collect()) == in_order([(2, "a"), (6, ""), (7, "b"), (7, "c")])
    twice = exact_dedup.drop_exact_duplicates(frame(spark, [(3, "a"), (3, "a"), (1, "b")])).collect()
    assert in_order(map(tuple, twice)) == [(1, "b"), (3, "a")]
    assert exact_dedup.exact_dedup(frame(spark, [])).collect() == [] and exact_dedup.drop_exact_duplicates(frame(spark, [])).collect() == []


# SimHash

def fingerprint_reference(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_reference(ids, near):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if near(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(spark, sf):
    rows = rows_of(docs(spark, sf))
    prints = {i: fingerprint_reference(t) for i, t in rows}
    want = classes_reference(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = simhash.simhash_components(docs(spark, sf)).collect()
    assert len(got) == len(rows) and all(int(r.fingerprint, 16) == prints[r.doc_id] and r.component_id == want[r.doc_id] for r in got)


@pytest.mark.parametrize("list_rows, keyed, most", [(simhash.LIST_ROWS, 4, 4), (16, 4, 4), (simhash.LIST_ROWS, 1, 4), (50, 2, 6), (simhash.LIST_ROWS, 3, 5), (simhash.LIST_ROWS, 4, 2)])
def test_links_join_all_near_fingerprints(spark, list_rows, keyed, most):
    rng, prints = random.Random(1), set()
    for base in [rng.getrandbits(64) for _ in range(12)]:
        for _ in range(80):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x - (1 << 64) if x >> 63 else x)
    prints = sorted(prints)
    number = {f: n for n, f in enumerate(prints)}
    links = simhash.links(spark.createDataFrame([(f,) for f in prints], "fp long"), most, list_rows, keyed).collect()
    near = {frozenset((number[r.x], number[r.y])) for r in links}
    apart = lambda a, b: ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count()
    assert all(apart(*p) <= most for p in near)
    ids = list(range(len(prints)))
    assert classes_reference(ids, lambda a, b: frozenset((a, b)) in near) == classes_reference(ids, lambda a, b: apart(a, b) <= most)


def test_links_refuse_what_they_cannot_find(spark):
    for apart, keyed in ((5, 4), (8, 1), (4, 5), (-1, 4)):
        with pytest.raises(ValueError):
            simhash.links(spark.createDataFrame([], "fp long"), apart, keyed=keyed)


@pytest.mark.parametrize("chunk", [4, 5, 7, simhash.CHUNK])
def test_fingerprints_in_chunks(chunk):
    rng = random.Random(chunk)
    for n in [*range(12), 50, 200]:
        text = " \t".join(rng.choice(["A", "b", "cc", "É", "d\x1ce"]) for _ in range(n))
        assert simhash.fingerprint(text.encode(), chunk=chunk) % 2**64 == fingerprint_reference(text)


def test_simhash_edge_rows(spark):
    rows = [(4, None), (3, ""), (9, " \t"), (5, "one two"), (6, "ONE  two"), (None, "null id"), (7, "twice"), (7, "again quite other words here")]
    got = in_order((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(frame(spark, rows)).collect())
    assert len(got) == 8 and {c for i, f, c in got if f == "0" * 16} == {3}
    assert {c for i, _, c in got if i in (5, 6)} == {5} and {c for i, _, c in got if i == 7} == {7}
    assert sorted(r.doc_id or -1 for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()) == [-1, 3, 5, 7, 7]
    assert simhash.simhash_components(frame(spark, [])).collect() == []
    assert simhash.fingerprint(b"a b c d e " * 200_000) == simhash.fingerprint(b"a b c d e " * 200_000) != 0


def shingles_reference(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_reference(texts):
    """Index -> first index of its group: texts alike to 0.8 in their five-word shingles, directly or by others."""
    sets = [shingles_reference(t) for t in texts]
    return classes_reference(list(range(len(texts))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"edit{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("list_rows", [simhash_wide.LIST_ROWS, 20])
def test_near_copies_against_brute_force(spark, list_rows):
    """Groups of two to a hundred copies, some alike through others alone; copies alike to less than 0.8 stay."""
    rng = random.Random(5)
    rows = []
    for group, (size, edits) in enumerate([(2, 2), (2, 4), (5, 3), (100, 2), (3, 40), (4, 60), (1, 0), (1, 0)]):
        base = [f"g{group}w{rng.randrange(500)}" for _ in range(300)]
        rows += [(1000 * group + n, edited(rng, base, edits)) for n in range(size)]
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[0] % 7)
    ordered = sorted(rows)
    root = near_reference([t for _, t in ordered])
    want = {ordered[n][0] for n in root if root[n] == n}
    assert {r.doc_id for r in simhash_wide.drop_near_copies(frame(spark, rows), list_rows=list_rows).collect()} == want
    # 4 edits in each of two copies leave 0.76
    assert len(want) == 1 + 2 + 1 + 1 + 3 + 4 + 1 + 1


def test_near_copies_of_documents(spark, sf):
    rows = sorted(rows_of(docs(spark, sf)))
    root = near_reference([t for _, t in rows])
    want = {rows[n][0] for n in root if root[n] == n}
    got = {r.doc_id for r in simhash_wide.drop_near_copies(docs(spark, sf)).collect()}
    assert want <= got and len(got - want) <= 0.05 * (len(rows) - len(want))


def test_near_copies_of_one_template(spark):
    """Pairs alike to 0.82 among hundreds of texts alike to 0.71: no unlike text of a list may stand for a pair's link."""
    rng = random.Random(11)
    rows = []
    for pair in range(150):
        at = rng.sample(range(2, 300, 5), 8)
        for n in range(2):
            own = {*at[:2], *at[2 + n :: 2]}
            rows.append((2 * pair + n, " ".join(f"edit{pair}" if w in own else f"w{w}" for w in range(300))))
    root = near_reference([t for _, t in rows])
    want = {rows[n][0] for n in root if root[n] == n}
    assert 130 < len(want) < 170
    for block_bytes in (simhash_wide.BLOCK_BYTES, 40_000):
        got = {r.doc_id for r in simhash_wide.drop_near_copies(frame(spark, rows), block_bytes=block_bytes).collect()}
        assert got == want, block_bytes


@pytest.mark.parametrize("block_bytes", [simhash_wide.BLOCK_BYTES, 2_000])
def test_groups_are_joined_exactly(spark, block_bytes):
    rng = random.Random(4)
    members = []
    for g, size in enumerate([2, 16, 17, 90, 200]):
        base = rng.sample(range(10_000), 40)
        members += [(g, 1000 * g + n, frozenset(rng.sample(base, 31) + [10_000 + rng.randrange(3)])) for n in range(size)]
    members += [(9, 9000 + n, frozenset()) for n in range(20)]
    table = cut(spark.createDataFrame([(g, n, bytearray(np.array(sorted(s), np.uint64).tobytes())) for g, n, s in members], "g long, node long, shingles binary"), "test")
    ids, sets = [n for _, n, _ in members], {n: s for _, n, s in members}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])
    found = {(r.x, r.y) for r in simhash_wide.join_groups(table, 0.75, block_bytes).collect()}
    want = classes_reference(ids, lambda a, b: a // 1000 == b // 1000 and alike(a, b))
    assert all(alike(a, b) for a, b in found) and classes_reference(ids, lambda a, b: (min(a, b), max(a, b)) in found) == want
    assert 60 < len(set(want.values())) < len(ids) - 60


@pytest.mark.parametrize("apart", [0, 40, 70, 300])
def test_forest_joins_what_near_fingerprints_join(apart):
    rng = np.random.default_rng(apart)
    wide = rng.integers(0, 256, (6, 64), dtype=np.uint8)[rng.integers(0, 6, 200)]
    wide ^= np.packbits(rng.random((200, 512)) < 0.05, axis=1)
    x, y, tree = simhash_wide.forest(wide, apart)
    apart_of = np.bitwise_count(wide[:, None] ^ wide[None]).sum(-1, dtype=int)
    shared = (wide[:, None] == wide[None]).sum(-1)
    near = (apart_of <= apart) & (shared >= simhash_wide.SHARED)
    assert near[x, y].all() and len(x) < 200
    found = {frozenset(p) for p in zip(x.tolist(), y.tolist(), strict=True)}
    ids = list(range(200))
    want = classes_reference(ids, lambda a, b: near[a, b])
    assert classes_reference(ids, lambda a, b: frozenset((a, b)) in found) == want == dict(enumerate(tree.tolist()))


def test_compare_streams_partners_in_parts(spark, monkeypatch):
    rng = random.Random(2)
    sets = {n: np.unique(np.array([rng.randrange(60) for _ in range(rng.randint(0, 90))], np.uint64)) for n in range(60)}
    pairs = [(0, n) for n in range(1, 60)] + [(n, n + 1) for n in range(1, 59)]
    table = cut(spark.createDataFrame([(n, bytearray(s.tobytes())) for n, s in sets.items()], "node long, shingles binary"), "test")
    want = {(x, y) for x, y in pairs if len(set(sets[x]) & set(sets[y])) >= 0.5 * len(set(sets[x]) | set(sets[y]))}
    for partners in (256, 7):
        monkeypatch.setattr(simhash_wide, "PARTNERS", partners)
        got = simhash_wide.compare(cut(spark.createDataFrame(pairs, "x long, y long"), "test"), table, 0.5).collect()
        assert sorted((r.x, r.y) for r in got) == sorted(want) and want


def test_near_copies_edge_rows(spark):
    words = " ".join(f"w{n}" for n in range(80))
    rows = [(4, None), (3, ""), (9, " \t"), (5, "one two"), (6, "ONE  two"), (None, "null id"), (None, "another null id"), (7, words), (7, words), (7, "again quite other words here"), (8, f"{words} more")]
    clashing = frame(spark, rows).withColumns({c: F.lit(c) for c in ("id", "sha", "node", "key", "own", "wide", "__id")})
    left = simhash_wide.drop_near_copies(clashing)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["3", "5", "7", "7", "None", "None"] and left.columns == clashing.columns
    assert simhash_wide.drop_near_copies(frame(spark, [])).collect() == []
    long = " ".join(f"w{n % 70_001}" for n in range(400_000))
    rows = [(1, long), (2, f"{long} end"), (3, f"{long[: len(long) // 9]} cut"), (4, "")]
    assert sorted(r.doc_id for r in simhash_wide.drop_near_copies(frame(spark, rows)).collect()) == [1, 3, 4]


@pytest.mark.parametrize("few", [0, 10_000])
def test_components_of_paths_and_stars(spark, few):
    links = [(n, n + 1) for n in range(0, 40)] + [(100, n) for n in range(101, 140)] + [(200, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), few=few).collect()))
    assert all(got[n] == 0 for n in range(1, 41)) and all(got[n] == 100 for n in range(101, 140))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("few", [0, 10_000])
def test_join_with_a_hot_key(spark, few):
    rows = spark.createDataFrame([(n if n % 3 else 1, n) for n in range(600)] + [(-1, 0), (None, 0)], "k long, n long")
    lookup = spark.createDataFrame([(n, 2 * n) for n in range(700)] + [(None, 0)], "k long, m long")
    got = sorted(map(tuple, join_one(rows, "k", lookup, 602, few).select("k", "n", "m").collect()))
    assert got == sorted((k, n, 2 * k) for k, n in ((n if n % 3 else 1, n) for n in range(600)))


def test_a_null_text_repeats_an_empty_one(spark):
    rows = [(1, None), (1, ""), (1, "x"), (1, "x"), (2, "x"), (None, "y"), (None, "y"), (0, "")]
    left = exact_dedup.drop_exact_duplicates(frame(spark, rows).withColumn("sha", F.lit(0)))
    assert sorted((str(i), t or "") for i, t in rows_of(left)) == [("1", ""), ("2", "x"), ("None", "y")]


# lines

def lines_reference(rows, min_chars=20, min_docs=3):
    low = lambda k: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k.strip(" \t\n\x0b\x0c\r"))
    where = {}
    number = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(low(line)) >= min_chars:
                where.setdefault(low(line), set()).add(number(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(low(x)) < min_chars or len(where[low(x)]) < min_docs or max(where[low(x)]) == number(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def same_lines(df, rows, **parameters):
    assert in_order(map(tuple, line_dedup.line_dedup(df, **parameters).collect())) == in_order(lines_reference(rows, **parameters))


def test_lines(spark, sf):
    same_lines(docs(spark, sf).withColumn("key", F.lit(1)), rows_of(docs(spark, sf)))


@pytest.mark.parametrize("kinds", [2, 40])
def test_common_lines_over_many_partitions(spark, kinds):
    rng = random.Random(kinds)
    vocabulary = [f"line number {n}" for n in range(kinds)] + ["X", "é" * 4, "é" * 5]
    rows = [(n if n % 9 else None, "\n".join(rng.choice(vocabulary) + rng.choice(["", " ", "\t\r"]) for _ in range(rng.randint(0, 12)))) for n in range(400)]
    same_lines(frame(spark, rows), rows, min_chars=5)


def test_line_edge_rows(spark):
    line = "a" * 25
    rows = [(1, None), (2, ""), (2, f"{line}\nb"), (3, f"{line.upper()}\n"), (4, f"{line} "), (4, f"{line} "), (5, f"{line}\n{line}")]
    same_lines(frame(spark, rows), rows)
    assert line_dedup.line_dedup(frame(spark, [])).collect() == []


# suffixes

def suffix_reference(rows, length):
    seen, raw = {}, [(t or "").encode() for _, t in rows]
    for b in raw:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for (i, _), b in zip(rows, raw, strict=True):
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        out.append((i, len(b), [m.span() for m in re.finditer(b"\1+", bytes(mark))], bytes(x for x, m in zip(b, mark, strict=True) if not m)))
    return out


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefgh é"])
@pytest.mark.parametrize("limits", [{}, {"block": 100}, {"over": 200}])
def test_suffixes(spark, alphabet, limits):
    rng = random.Random(len(alphabet))
    some = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    pool = [some(rng.randint(5, 60)) for _ in range(6)]
    rows = [(n if n % 11 else None, "".join(rng.choice(pool) if rng.random() < 0.8 else some(rng.randint(1, 20)) for _ in range(rng.randint(0, 8)))) for n in range(50)] + [(100, None), (101, ""), (102, pool[0] * 3), (102, pool[0] * 3)]
    got = suffix_dedup.suffix_dedup(frame(spark, rows).withColumn("th", F.lit("x")), 24, 6, **limits).collect()
    assert in_order((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got) == in_order(suffix_reference(rows, 24))


@pytest.mark.parametrize("limits", [{}, {"block": 3000, "over": 5000}])
def test_suffixes_of_documents(spark, limits):
    """The operator's own 400 bytes, on a whole table."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = suffix_dedup.suffix_dedup(df, **limits).collect()
    want = suffix_reference(rows_of(df), 400)
    assert in_order((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got) == in_order(want)
    assert sum(b - a for _, _, spans, _ in want for a, b in spans) > 400_000


def test_planted_passages_by_the_query(spark, tmp_path):
    """op5's own columns: passages of over 50 words in several documents go whole from 400 bytes on and stay below; the other documents lose nothing."""
    rng = random.Random(31)
    some = lambda n: " ".join("".join(rng.choice("abcdefghilmnoprstué") for _ in range(rng.randint(2, 5))) for _ in range(n))
    rows, planted = [(n, some(rng.randint(0, 400))) for n in range(40)] + [(None, None), (40, "")], {}
    for size in (300, 398, 399, 400, 401, 450, 600):
        passage = some(51)
        passage += "a" * (size - 2 - len(passage.encode()))
        assert len(passage.split()) > 50 and len(passage.encode()) == size - 2
        for copy in range(rng.randint(2, 4)):
            # No copy has its neighbours' bytes before or after the passage.
            planted[i := 100 + len(planted)] = size
            rows.append((i, f"{some(rng.randint(0, 300))}{copy}|{passage}|{copy}{some(rng.randint(0, 300))}"))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_suffix_dedup(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = [(i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in suffix_reference(rows, 400)]
    assert in_order(tuple(r) for r in got) == in_order(want)
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in got if r.n_removed} == {i: (size, 1) for i, size in planted.items() if size >= 400}


def test_a_passage_of_many_documents_is_cut_in_bands(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(n, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90))) + passage[n % 3 * 40 :] + "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90)))) for n in range(200)]
    got = suffix_dedup.suffix_dedup(frame(spark, rows), 100, 16, over=2000).collect()
    assert in_order((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got) == in_order(suffix_reference(rows, 100))


def test_bands_keep_all_windows():
    rng = random.Random(5)
    for text in (rng.randbytes(3000), b"ab" * 900, bytes(rng.choice(b"ab") for _ in range(2000))):
        for p0, n, aoff, g, _ in suffix_dedup.contexts(text, 100, 16):
            raw = text[p0 : p0 + n + 99]
            for width in (*suffix_dedup.WIDTHS, 7):
                found = suffix_dedup.bands(raw, aoff, g, width, 100)
                assert [x for a, k, *_ in found for x in range(a, a + k)] == list(range(n)) and all(k <= width and o == aoff - a for a, k, o, *_ in found)


def test_suffix_scan_chunks_agree():
    text = random.Random(2).randbytes(9000)
    windows = lambda scan: sorted((p, g) for p0, n, _, g, _ in suffix_dedup.contexts(text, 400, 64, scan) for p in range(p0, p0 + n))
    assert windows(1 << 19) == windows(1000) and len(windows(1000)) == 8601


def test_suffix_order_is_sorted():
    rng = random.Random(4)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(30, 90))) for _ in range(20)]
    text = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    order = suffix_dedup.suffix_order(text, starts, ends - starts - 30 + 1, ends, 30)
    raw = text.tobytes()
    keys = [raw[i : i + 30] for i in order]
    assert keys == sorted(keys) and len(keys) == sum(len(p) - 29 for p in parts)


def test_suffix_edge_rows(spark):
    assert suffix_dedup.suffix_dedup(frame(spark, [])).collect() == []
    r = suffix_dedup.suffix_dedup(frame(spark, [(1, "x" * 401)])).first()
    assert [tuple(s) for s in r.spans] == [(0, 401)] and bytes(r.kept) == b""


# long texts, repeated rows, clashing columns

def test_very_long_texts(spark):
    """Texts of megabytes beside empty ones, in every dedup operator."""
    rng = random.Random(12)
    words = [f"w{n}" for n in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(500_000))
    rows = [(1, long), (2, long), (3, f"{long[:-1]}Z"), (4, None), (5, "short"), (5, "short")]
    df = frame(spark, rows).withColumns({"page": F.lit(1), "base": F.lit(2), "slot": F.lit(3), "g": F.lit(4), "key": F.lit("x")})
    want = exact_reference(rows)
    for r in exact_dedup.exact_dedup(df, 1 << 20).collect():
        text = {i: t for i, t in rows}[r.doc_id]
        assert (r.keep_id, r.group_size) == want[text or ""]
    prints = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.simhash_components(df).collect()}
    assert prints[1] == (fingerprint_reference(long), 1) and prints[2] == prints[1] and prints[3][1] == 1
    lines = "\n".join(f"{w} is a line of its own" for w in words * 30)
    same_lines(df.drop("text").withColumn("text", F.lit(lines)), [(i, lines) for i, _ in rows])
    got = {r.doc_id: ([tuple(s) for s in r.spans], len(r.kept)) for r in suffix_dedup.suffix_dedup(df).collect()}
    n = len(long)
    assert got[1] == got[2] == ([(0, n)], 0) and got[3] == ([(0, n - 1)], 1) and got[4] == ([], 0)
